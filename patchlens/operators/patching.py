"""Patches over columns: making, trying, applying and merging them, in Arrow batches.

Every row is worked on by itself, so nothing is shuffled and a lost task is run again; functions/patches.py has the
helpers on single values. A null text is a file that is not there, a null patch has no hunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patches
from .arrow import computed

HUNK = "hunk int, line int, offset int, fuzz int, placed boolean"
TRIED = f"struct<path string, code int, output string, applied_before boolean, hunks array<struct<{HUNK}>>>"
APPLIED = "struct<text string, rejects string, total_hunks int, failed_hunks array<int>, code int, output string>"
FORWARDED = "struct<result string, tries int, failed_hunks int, text string>"
MERGED = "struct<text string, conflicts int>"


def differences(df: DataFrame, old: Column, new: Column, path: Column, name: str = "patch", context: int = patches.CONTEXT) -> DataFrame:
    """Adds the section of a patch that makes new from old by a shortest edit script; empty where they are equal."""
    return computed(df, name, "string", lambda a, b, p: patches.unified(a, b, p or "", context), old, new, path)


def combined(subject: Column, commit: Column, patch: Column) -> Column:
    """A commit's patch as it stands in a combined one; empty patches leave none."""
    return F.when(patch == "", "").otherwise(F.concat(F.lit("From "), commit, F.lit("\nSubject: [PATCH] "), subject, F.lit("\n\n---\n"), patch, F.lit("--\n\n")))


def code(outcome: patches.Outcome) -> int:
    """The exit code of a run: 0, or 1 where hunks failed, 2 where there is no file."""
    return 2 if outcome.text is None else int(bool(outcome.failed) and not outcome.applied_before)


def dry_run(df: DataFrame, text: Column, patch: Column, name: str = "tried", fuzz: int = patches.FUZZ, spaces: bool = False) -> DataFrame:
    """Adds an array with, for each section of the patch, the exit code and output of a run that changes nothing, and where
    each hunk goes: its line in the result, how far that is from where it says, and the context lines left out.

    All sections are of the one file `text`, each on top of what the ones before it gave.
    """

    def run(content: str | None, given: str | None) -> list[dict]:
        out = []
        for path, hunks in patches.sections(given or ""):
            done = patches.apply(content, path, hunks, fuzz, spaces)
            content = done.text
            rows = [{"hunk": h.number, "line": h.line, "offset": h.offset, "fuzz": h.fuzz, "placed": h.line is not None} for h in done.hunks]
            out.append({"path": path, "code": code(done), "output": done.said(), "applied_before": done.applied_before, "hunks": rows})
        return out

    return computed(df, name, f"array<{TRIED}>", run, text, patch)


def applied(df: DataFrame, text: Column, patch: Column, name: str = "applied", merge: bool = False, labels: tuple[str, str] = ("ours", "theirs"), fuzz: int = patches.FUZZ, spaces: bool = True) -> DataFrame:
    """Adds what the patch makes of the file: its text, rejected hunks, counts, exit code and output.

    merge: a hunk that finds no place is merged into the lines where it should be, with conflict markers where both differ;
    then nothing is rejected. Hunks are numbered over all sections.
    """

    def run(content: str | None, given: str | None) -> dict:
        rejects, failed, worst, said, total = [], [], 0, [], 0
        for path, hunks in patches.sections(given or ""):
            done = patches.apply_merging(content, path, hunks, labels, fuzz, spaces)[0] if merge and content is not None else patches.apply(content, path, hunks, fuzz, spaces)
            failed += [] if done.applied_before else [total + n for n in done.failed]
            total, worst, content = total + len(hunks), max(worst, code(done)), done.text if not done.applied_before else content
            said.append(done.said())
            rejects.append("" if merge or done.applied_before else done.rejects)
        return {"text": content, "rejects": "".join(rejects), "total_hunks": total, "failed_hunks": failed, "code": worst, "output": "".join(said)}

    return computed(df, name, APPLIED, run, text, patch)


def merged(df: DataFrame, base: Column, ours: Column, theirs: Column, name: str = "merged", labels: tuple[str, str] = ("ours", "theirs")) -> DataFrame:
    """Adds the three-way merge of two versions of a text and its number of conflicts; null texts are empty."""

    def run(a: str | None, b: str | None, c: str | None) -> dict:
        text, conflicts = patches.merged(a or "", b or "", c or "", labels)
        return {"text": text, "conflicts": conflicts}

    return computed(df, name, MERGED, run, base, ours, theirs)


#: How a patch is tried on another version, one after the other: context lines left out at most, white space alike or not.
TRIES = ((0, False), (patches.FUZZ, True))


def forwarded(df: DataFrame, text: Column, patch: Column, name: str = "forwarded", tries: tuple[tuple[int, bool], ...] = TRIES) -> DataFrame:
    """Adds the outcome of a patch on another version of its file: success, failure, or skipped where there is no file or no patch.

    Tries go from strict to tolerant and stop at the first that places every hunk; of failures the last counts. Each row has
    its own tries, so one that fails holds up no other.
    """
    return computed(df, name, FORWARDED, lambda content, given: outcome(content, prepared(given), tries), text, patch)


def forwarded_each(df: DataFrame, texts: Column, patch: Column, name: str = "forwarded", tries: tuple[tuple[int, bool], ...] = TRIES) -> DataFrame:
    """As forwarded(), on every one of an array of versions: an array of outcomes. The patch is read once for all of them."""

    def run(contents: list[str | None] | None, given: str | None) -> list[dict] | None:
        if contents is None:
            return None
        sections = prepared(given)
        return [outcome(x, sections, tries) for x in contents]

    return computed(df, name, f"array<{FORWARDED}>", run, texts, patch)


def prepared(patch: str | None) -> list[patches.Tries]:
    return [patches.Tries(path, hunks) for path, hunks in patches.sections(patch or "")]


def outcome(content: str | None, sections: list[patches.Tries], tries: tuple[tuple[int, bool], ...]) -> dict:
    """What trying the sections of a patch on one text gave."""
    if content is None or not sections:
        return {"result": "skipped", "tries": 0, "failed_hunks": 0, "text": None}
    lines = patches.cut(content)
    for number, (fuzz, spaces) in enumerate(tries, 1):
        after, failed = lines, 0
        for section in sections:
            missing, before = section.on(after, fuzz, spaces)
            if not before:
                failed += missing
                after = patches.spliced(after, section.hunks)
                if len(sections) > 1:
                    after = patches.cut("".join(after))
        if not failed:
            return {"result": "success", "tries": number, "failed_hunks": 0, "text": "".join(after)}
    return {"result": "failure", "tries": len(tries), "failed_hunks": failed, "text": None}
