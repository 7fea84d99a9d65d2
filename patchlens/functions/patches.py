"""Versions of a text as unified diffs: shortest edit scripts, placing and applying hunks, three-way merges.

Texts are cut at line feeds alone; a line keeps its line feed, so the last one may have none. Helpers on one value each:
operators/patching.py runs them over columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, count, repeat

CONTEXT, FUZZ = 3, 2
# The unified format and the console lines that status and console readers look for.
RANGE = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
UNENDED = "\\ No newline at end of file"
NOWHERE = -(1 << 60)


def cut(text: str) -> list[str]:
    """Lines with their line feeds."""
    lines = text.split("\n")
    return [line + "\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """Where a run of equal lines (maybe none) on some shortest script lies halfway: its start and end in a and b."""
    n, m = len(a), len(b)
    delta, most = n - m, (n + m + 1) // 2
    ahead, back = [NOWHERE] * (2 * most + 3), [NOWHERE] * (2 * most + 3)
    ahead[1] = back[1] = 0
    for d in range(most + 1):
        for reverse, own, other in ((False, ahead, back), (True, back, ahead)):
            for k in range(-d, d + 1, 2):
                down, right = own[k + 1], own[k - 1] + 1
                x = max(down if down - k <= m else NOWHERE, right if right <= n else NOWHERE)
                if x < 0:
                    own[k] = NOWHERE
                    continue
                x0, y = x, x - k
                if reverse:
                    while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[x] == b[y]:
                        x, y = x + 1, y + 1
                own[k] = x
                reach = d if reverse else d - 1
                if delta % 2 == (not reverse) and -reach <= delta - k <= reach and x + other[delta - k] >= n:
                    return (n - x, m - y, n - x0, m - (x0 - k)) if reverse else (x0, x0 - k, x, y)
    raise AssertionError("two scripts of half the length always meet")


def changed(a: list[int], b: list[int]) -> tuple[bytearray, bytearray]:
    """Which lines a shortest script deletes from a, and inserts from b; memory in proportion to the lines (Myers 1986)."""
    gone, new = bytearray(len(a)), bytearray(len(b))
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, n, j, m = open_.pop()
        while i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
        if i == n or j == m:
            gone[i:n], new[j:m] = b"\1" * (n - i), b"\1" * (m - j)
            continue
        x0, y0, x1, y1 = middle(a[i:n], b[j:m])
        open_ += [(i, i + x0, j, j + y0), (i + x1, n, j + y1, m)]
    return gone, new


def edits(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """Changes (from, to in old; from, to in new) of a shortest script, in order. Time: lines times differing lines.

    Lines that only one version has are on every script; they are left out of the search.
    """
    both = set(old) & set(new)
    gone, fresh = (bytearray(x not in both for x in lines) for lines in (old, new))
    a, b = ([x for x in lines if x in both] for lines in (old, new))
    # what both have is mostly the same in both, and nothing is left to search
    if a != b:
        number = {x: i for i, x in enumerate(both)}
        for marks, all_ in zip(changed([number[x] for x in a], [number[x] for x in b]), (gone, fresh), strict=True):
            places = [i for i, own in enumerate(all_) if not own]
            for place, mark in zip(places, marks, strict=True):
                all_[place] = mark
    # from one change to the next, with a line of neither kind behind the last
    gone, fresh = gone + b"\0", fresh + b"\0"
    out, i, j = [], 0, 0
    while True:
        n, m = gone.find(1, i), fresh.find(1, j)
        if n < 0 and m < 0:
            return out
        step = min(x for x in (n - i if n >= 0 else None, m - j if m >= 0 else None) if x is not None)
        i, j = i + step, j + step
        n, m = gone.find(0, i), fresh.find(0, j)
        out.append((i, n, j, m))
        i, j = n, m


def written(mark: str, lines: list[str]) -> str:
    """Lines behind a mark each; of a file's lines only the last can have no line feed."""
    if not lines:
        return ""
    return mark + mark.join(lines) + ("" if lines[-1].endswith("\n") else f"\n{UNENDED}\n")


def unified(old: str | None, new: str | None, name: str, context: int = CONTEXT) -> str:
    """The section of a patch that makes new from old, empty where they are equal; null is a file that is not there."""
    if old == new:
        return ""
    a, b = cut(old or ""), cut(new or "")
    groups: list[list[tuple[int, int, int, int]]] = []
    for change in edits(a, b):
        if groups and change[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(change)
        else:
            groups.append([change])
    out = [f"diff --git a/{name} b/{name}\n--- {'/dev/null' if old is None else f'a/{name}'}\n+++ {'/dev/null' if new is None else f'b/{name}'}\n"]
    for group in groups:
        start, end = max(0, group[0][0] - context), min(len(a), group[-1][1] + context)
        first, last = group[0][2] - (group[0][0] - start), group[-1][3] + (end - group[-1][1])
        span = lambda at, n: f"{at + (n > 0)}" + ("" if n == 1 else f",{n}")
        out.append(f"@@ -{span(start, end - start)} +{span(first, last - first)} @@\n")
        at = start
        for i, n, j, m in group:
            out += [written(" ", a[at:i]), written("-", a[i:n]), written("+", b[j:m])]
            at = n
        out.append(written(" ", a[at:end]))
    return "".join(out)


@dataclass
class Hunk:
    number: int
    start: int
    lines: list[tuple[str, str]] = field(default_factory=list)  # mark, line
    text: str = ""
    #: the line, from 1, where it went, or None; how far from where it was said to be; context lines left out
    line: int | None = None
    offset: int = 0
    fuzz: int = 0

    def old(self) -> list[str]:
        return [x for mark, x in self.lines if mark != "+"]

    def new(self) -> list[str]:
        return [x for mark, x in self.lines if mark != "-"]

    def around(self) -> tuple[int, int]:
        """Lines of context before the first and after the last change."""
        marks = "".join(mark for mark, _ in self.lines)
        return len(marks) - len(marks.lstrip(" ")), len(marks) - len(marks.rstrip(" "))


def sections(patch: str) -> Iterator[tuple[str, list[Hunk]]]:
    """(path, hunks) of each file of a patch, the leading a/ or b/ stripped; hunks shorter than they say end early."""
    lines = patch.split("\n")
    lines = lines[:-1] if not lines[-1] else lines
    path, hunks, k = "", [], 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if line.startswith("diff --git "):
            if hunks:
                yield path, hunks
            path, hunks = line.rpartition(" b/")[2], []
        elif line.startswith("--- ") and k < len(lines) and lines[k].startswith("+++ "):
            names = [x[4:].split("\t")[0] for x in (line, lines[k])]
            name = next((x for x in reversed(names) if x != "/dev/null"), path)
            name = name[2:] if name[:2] in ("a/", "b/") else name
            if hunks:
                yield path, hunks
                hunks = []
            path, k = name, k + 1
        elif m := RANGE.match(line):
            hunk = Hunk(len(hunks) + 1, int(m[1]))
            old, new = (1 if x is None else int(x) for x in (m[2], m[4]))
            first = k - 1
            own = hunk.lines
            while k < len(lines) and (old > 0 or new > 0):
                line = lines[k]
                mark = line[:1] or " "
                if mark == " ":
                    old, new = old - 1, new - 1
                    own.append((mark, line[1:] + "\n"))
                elif mark == "-":
                    old -= 1
                    own.append((mark, line[1:] + "\n"))
                elif mark == "+":
                    new -= 1
                    own.append((mark, line[1:] + "\n"))
                elif mark != "\\":
                    break
                elif hunk.lines:
                    hunk.lines[-1] = (hunk.lines[-1][0], hunk.lines[-1][1].rstrip("\n"))
                k += 1
            if k < len(lines) and lines[k].startswith("\\") and hunk.lines:
                hunk.lines[-1] = (hunk.lines[-1][0], hunk.lines[-1][1].rstrip("\n"))
                k += 1
            hunk.text = "\n".join(lines[first:k]) + "\n"
            hunks.append(hunk)
    if hunks:
        yield path, hunks


def loose(line: str) -> str:
    """A line with all white space alike."""
    return " ".join(line.split())


#: White space besides the space and the line feed.
ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
ODDER = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def alike(lines: list[str], spaces: bool) -> list[str]:
    """Lines as they are compared: as they are, or loose ones, made of the whole text at once."""
    if not spaces or not lines:
        return lines
    whole = "".join(lines)
    ended = whole.endswith("\n")
    for x in ODD if whole.isascii() else ODD + ODDER:
        if x in whole:
            whole = whole.replace(x, " ")
    while "  " in whole:
        whole = whole.replace("  ", " ")
    out = whole.replace(" \n", "\n").replace("\n ", "\n").strip(" ").split("\n")
    if ended:
        out.pop()
    # a line without a line feed that is not the last one, or an empty one that is
    return out if len(out) == len(lines) else [loose(x) for x in lines]


def coded(i: int) -> bytes:
    return bytes((128 | i >> 21, i >> 14 & 127, i >> 7 & 127, i & 127))


NEITHER, CODES = coded(0), [coded(i) for i in range(1, 4096)]


class Sought:
    """What the hunks of a file look for, made ready once for all texts that they are tried on.

    A line is four bytes of which only the first is over 127, so runs of lines are found as byte strings, by a search that
    is linear in the text.
    """

    def __init__(self, hunks: list[Hunk], spaces: bool) -> None:
        self.spaces, self.hunks = spaces, hunks
        old = [alike(h.old(), spaces) for h in hunks]
        self.code = dict(zip(dict.fromkeys(chain.from_iterable(old)), chain(CODES, map(coded, count(len(CODES) + 1)))))
        self.runs = [(b"".join(map(self.code.__getitem__, x)), *h.around(), len(h.new())) for h, x in zip(hunks, old, strict=True)]

    def text(self, same: list[str]) -> bytes | None:
        """Lines, as they are compared, as codes, or null if they have none of the hunks; lines of no hunk are all alike."""
        return None if self.code.keys().isdisjoint(same) else b"".join(map(self.code.get, same, repeat(NEITHER)))


def nearest(text: bytes, run: bytes, guess: int, least: int) -> int | None:
    """The place of a run nearest to guess and not before least; of two equally near the later."""
    if guess >= max(0, least) and text.startswith(run, 4 * guess):
        return guess
    after = text.find(run, 4 * max(guess, least, 0))
    before = text.rfind(run, 4 * max(0, least), 4 * max(0, guess) + len(run))
    found = [x // 4 for x in (after, before) if x >= 0]
    return min(found, key=lambda x: (abs(x - guess), -x), default=None)


def place(lines: list[str], hunks: list[Hunk], fuzz: int = FUZZ, spaces: bool = False, sought: Sought | None = None, same: list[str] | None = None, whole: bool = False) -> list[Hunk]:
    """Sets line, offset and fuzz of every hunk of a file, in order, each after the one before.

    A hunk is looked for with all its context first, then with one outermost line of context fewer, up to `fuzz`; nearest
    to where it should be, shifted as the hunk before was. With less context before than after, it can only be at the
    start if it says so; with less after than before, only at the end. sought, same: the hunks and the lines made ready.
    whole: the first hunk without a place is the last that is looked for.
    """
    sought = sought or Sought(hunks, spaces)
    text, shift, least, grown = sought.text(alike(lines, spaces) if same is None else same), 0, 0, 0
    for h, (old, before, after, fresh) in zip(hunks, sought.runs, strict=True):
        h.line, h.offset, h.fuzz = None, 0, 0
        size = len(old) // 4
        # an empty range names the line before it
        said = h.start - 1 if size else h.start
        guess, found = said + shift, None
        if not size:
            found = guess if least <= guess <= len(lines) and (lines or not said) else None
        elif text is not None and before == after and guess >= least and text.startswith(old, 4 * guess):
            found = guess
        elif text is not None:
            full = max(before, after)
            for h.fuzz in range(min(fuzz, full) + 1):
                head, tail = h.fuzz + before - full, h.fuzz + after - full
                run = old[4 * max(0, head) : len(old) - 4 * max(0, tail)]
                if not run:
                    continue
                long = len(run) // 4
                if head < 0 and h.start <= 1:
                    found = 0 if least == 0 and text.startswith(run) and (tail >= 0 or long == len(lines)) else None
                elif tail < 0:
                    at = len(lines) - long
                    found = at - max(0, head) if at >= max(0, least) and text.startswith(run, 4 * at) else None
                else:
                    at = nearest(text, run, guess + max(0, head), least)
                    found = None if at is None else at - max(0, head)
                if found is not None:
                    break
        if found is None:
            h.fuzz = 0
            if whole:
                break
        else:
            h.line, h.offset = found + 1 + grown, found - said
            shift, least = h.offset, max(0, found) + size
            grown += fresh - size
    return hunks


def turned(hunks: list[Hunk]) -> list[Hunk]:
    """The hunks that undo these."""
    return [Hunk(h.number, h.start, [({"+": "-", "-": "+"}.get(mark, mark), x) for mark, x in h.lines]) for h in hunks]


class Tries:
    """The hunks of one section, tried on any number of texts: what they look for is made ready once for each way to compare."""

    def __init__(self, path: str, hunks: list[Hunk]) -> None:
        self.path, self.hunks, self.ready = path, hunks, {}

    def sought(self, spaces: bool, back: bool = False) -> Sought:
        if (spaces, back) not in self.ready:
            self.ready[spaces, back] = Sought(turned(self.hunks) if back else self.hunks, spaces)
        return self.ready[spaces, back]

    def on(self, lines: list[str], fuzz: int, spaces: bool) -> tuple[int, bool]:
        """Places the hunks in the lines: how many have no place, and whether none has one and all were applied before."""
        same = alike(lines, spaces)
        place(lines, self.hunks, fuzz, spaces, self.sought(spaces), same)
        failed = sum(h.line is None for h in self.hunks)
        if not self.hunks or failed < len(self.hunks):
            return failed, False
        # the first hunk's own lines must be there, else there is no need to turn all of them
        if not set(alike(self.hunks[0].new(), spaces)).issubset(same):
            return failed, False
        back = self.sought(spaces, True)
        for h in back.hunks:
            h.line = None
        return failed, place(lines, back.hunks, 0, spaces, back, same, whole=True)[-1].line is not None


@dataclass
class Outcome:
    """What applying a patch to one file gave. text: null where the file is not there."""

    path: str
    hunks: list[Hunk]
    text: str | None
    rejects: str
    applied_before: bool = False

    @property
    def failed(self) -> list[int]:
        return [h.number for h in self.hunks if h.line is None]

    def said(self) -> str:
        """The console lines of it."""
        if self.text is None:
            return f"can't find file to patch at input line 1\n{len(self.hunks)} out of {len(self.hunks)} hunks ignored\n"
        out = [f"patching file {self.path}\n"]
        if self.applied_before:
            out.append("Reversed (or previously applied) patch detected!  Skipping patch.\n")
        for h in self.hunks:
            if h.line is None:
                out.append(f"Hunk #{h.number} FAILED at {max(1, h.start)}.\n")
            elif h.offset or h.fuzz:
                more = f" with fuzz {h.fuzz}" * (h.fuzz > 0) + f" (offset {h.offset} line{'s' * (abs(h.offset) != 1)})" * (h.offset != 0)
                out.append(f"Hunk #{h.number} succeeded at {h.line}{more}.\n")
        if self.failed:
            out.append(f"{len(self.failed)} out of {len(self.hunks)} hunks FAILED -- saving rejects to file {self.path}.rej\n")
        return "".join(out)


def spliced(lines: list[str], hunks: list[Hunk]) -> list[str]:
    """The lines after the hunks that have a place; lines matched loosely or left out as fuzz stay as they are."""
    out, at, grown = [], 0, 0
    for h in hunks:
        if h.line is None:
            continue
        i = h.line - 1 - grown
        grown += len(h.new()) - len(h.old())
        for mark, line in h.lines:
            if mark == "+":
                out += lines[at : max(at, i)]
                at = max(at, i)
                if out and not out[-1].endswith("\n"):
                    out[-1] += "\n"
                out.append(line)
            else:
                if mark == "-":
                    out += lines[at : max(at, i)]
                    at = i + 1
                i += 1
    return out + lines[at:]


def apply(text: str | None, path: str, hunks: list[Hunk], fuzz: int = FUZZ, spaces: bool = True) -> Outcome:
    """A file after the hunks of one section; what finds no place is in the rejects. No file, no rejects."""
    if text is None:
        made = len(hunks) == 1 and not hunks[0].old()
        return Outcome(path, [Hunk(h.number, h.start, h.lines, h.text, 1 if made else None) for h in hunks], "".join(hunks[0].new()) if made else None, "")
    lines = cut(text)
    before = Tries(path, hunks).on(lines, fuzz, spaces)[1]
    failed = [h for h in hunks if h.line is None]
    rejects = f"--- {path}\n+++ {path}\n" + "".join(h.text for h in failed) if failed else ""
    return Outcome(path, hunks, "".join(spliced(lines, hunks)), rejects, before)


def merge(base: list[str], ours: list[str], theirs: list[str], labels: tuple[str, str] = ("ours", "theirs")) -> tuple[list[str], int]:
    """The lines of a three-way merge and its number of conflicts.

    Changes whose places in base overlap or touch form a region. What only one side changed, or both alike, is taken; else
    both sides stand between conflict markers.
    """
    changes = sorted([(i, n, 0, j, m) for i, n, j, m in edits(base, ours)] + [(i, n, 1, j, m) for i, n, j, m in edits(base, theirs)])
    out, at, conflicts, k, shift = [], 0, 0, 0, [0, 0]
    ended = lambda lines: [x if x.endswith("\n") else x + "\n" for x in lines]
    while k < len(changes):
        start, end = changes[k][:2]
        before, sides = list(shift), set()
        while k < len(changes) and changes[k][0] <= end:
            i, n, side, j, m = changes[k]
            end, k = max(end, n), k + 1
            sides.add(side)
            shift[side] += (m - j) - (n - i)
        out += base[at:start]
        at = end
        parts = [side[start + b : end + a] for side, b, a in zip((ours, theirs), before, shift, strict=True)]
        if len(sides) == 1:
            out += parts[sides.pop()]
        elif parts[0] == parts[1]:
            out += parts[0]
        else:
            conflicts += 1
            out += [f"<<<<<<< {labels[0]}\n", *ended(parts[0]), "=======\n", *ended(parts[1]), f">>>>>>> {labels[1]}\n"]
    return out + base[at:], conflicts


def merged(base: str, ours: str, theirs: str, labels: tuple[str, str] = ("ours", "theirs")) -> tuple[str, int]:
    lines, conflicts = merge(cut(base), cut(ours), cut(theirs), labels)
    return "".join(lines), conflicts


def apply_merging(text: str, path: str, hunks: list[Hunk], labels: tuple[str, str], fuzz: int = FUZZ, spaces: bool = True) -> tuple[Outcome, int]:
    """As apply(), but a hunk without a place is merged, with the lines where it should be as ours: the outcome and its conflicts.

    Those lines begin where the hunk says, shifted as the hunk before it was, and reach no further than the next hunk
    that has a place.
    """
    found = apply(text, path, hunks, fuzz, spaces)
    if not found.failed or found.applied_before:
        return found, 0
    lines, whole, conflicts, at, shift, grown = cut(text), [], 0, 0, 0, 0
    starts: list[int | None] = []
    for h in hunks:
        starts.append(None if h.line is None else h.line - 1 - grown)
        grown += 0 if h.line is None else len(h.new()) - len(h.old())
    for k, h in enumerate(hunks):
        if h.line is not None:
            shift, end = h.offset, max(at, starts[k] + len(h.old()))
            whole += spliced(lines[at:end], [Hunk(h.number, h.start, h.lines, line=starts[k] - at + 1)])
            at = end
            continue
        after = next((x for x in starts[k + 1 :] if x is not None), len(lines))
        start = max(at, min(h.start - 1 + shift, after, len(lines)))
        end = max(start, min(start + len(h.old()), after, len(lines)))
        part, n = merge(h.old(), lines[start:end], h.new(), labels)
        whole += lines[at:start] + part
        conflicts, at = conflicts + n, end
    found.text = "".join(whole + lines[at:])
    return found, conflicts
