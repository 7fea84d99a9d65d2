"""HTML as a stream of properly nested events: a tokenizer and a stack of open elements.

Attributes in either or no quotes, comments, character data of scripts and styles, void elements, end tags that are left
out, end tags without a start. Time and memory are in proportion to the text. What never ends (a comment, a script, a
tag) reaches to the end of the text; a "<" that begins no tag is text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

OPEN, CLOSE, TEXT = range(3)

# Element names and their nesting, as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements whose start ends an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Elements that nothing inside them closes but what closes them.
SCOPES = frozenset("button caption html object table td template th".split())
#: Starts that end an open element: the starts, the elements, and the elements beyond which they do not reach.
ENDED = (
    ("li", "li", "menu ol ul"), ("dd dt", "dd dt", "dl"), ("option", "option", "optgroup select"), ("optgroup", "optgroup", "select"),
    ("h1 h2 h3 h4 h5 h6", "h1 h2 h3 h4 h5 h6", "article aside blockquote div main section table"),
    ("td th", "td th", "table tr"), ("tr", "tr", "table tbody tfoot thead"), ("tbody tfoot thead", "tbody tfoot thead", "table"),
)
STARTS, ENDING, LIMITS = ({name: [k for k, rule in enumerate(ENDED) if name in rule[i].split()] for rule in ENDED for name in rule[i].split()} for i in range(3))

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']\S*+)))?""")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag, names in lower case; the first of equal names counts, one without a value is empty."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def tokens(source: str) -> Iterator[tuple[int, str, str]]:
    """(OPEN, name, attributes), (CLOSE, name, ""), (TEXT, raw text, ""); names in lower case, references not decoded."""
    at, begun, last = 0, 0, source.rfind(">")
    while (lt := source.find("<", at)) >= 0:
        after = source[lt + 1 : lt + 4]
        if lt < last and (m := TAG.match(source, lt)):
            end, token = m.end(), (CLOSE if m[1] else OPEN, m[2].lower(), "" if m[1] else m[3])
        elif after == "!--":
            end, token = source.find("-->", lt + 4), None
            end = len(source) if end < 0 else end + 3
        elif after[:1] in ("!", "?", "/") or after[:1].isalpha() and after[:1].isascii():
            end, token = source.find(">", lt) + 1 or len(source), None
        else:
            at = lt + 1
            continue
        if lt > begun:
            yield TEXT, source[begun:lt], ""
        at = begun = end
        if token is None:
            continue
        yield token
        kind, name, _ = token
        if kind == OPEN and name in RAW:
            ended = ENDS[name].search(source, at)
            upto = ended.start() if ended else len(source)
            if upto > at:
                yield TEXT, source[at:upto], name
            at = begun = upto
    if begun < len(source):
        yield TEXT, source[begun:], ""


def events(source: str) -> Iterator[tuple[int, str, str]]:
    """tokens() with every start ended in its place: void and left-open elements too, ends without a start gone."""
    stack: list[str] = []
    #: open elements by name, apart for each element of SCOPES
    scopes: list[dict[str, int]] = [{}]
    outer: dict[str, int] = {}
    #: for each rule of ENDED how many of its elements are open, apart for each of its limits
    open_ = [[0] for _ in ENDED]

    def push(name: str) -> None:
        scopes[-1][name] = scopes[-1].get(name, 0) + 1
        stack.append(name)
        if name in SCOPES:
            scopes.append({})
            outer[name] = outer.get(name, 0) + 1
        for k in ENDING.get(name, ()):
            open_[k][-1] += 1
        for k in LIMITS.get(name, ()):
            open_[k].append(0)

    def pop() -> tuple[int, str, str]:
        name = stack.pop()
        for k in LIMITS.get(name, ()):
            open_[k].pop()
        for k in ENDING.get(name, ()):
            open_[k][-1] -= 1
        if name in SCOPES:
            scopes.pop()
            outer[name] -= 1
        scopes[-1][name] -= 1
        return CLOSE, name, ""

    def until(*names: str) -> Iterator[tuple[int, str, str]]:
        while stack[-1] not in names:
            yield pop()
        yield pop()

    for kind, name, more in tokens(source):
        if kind == TEXT:
            if stack and stack[-1] == "head" and not name.isspace():
                yield pop()
            yield TEXT, name, more
        elif kind == CLOSE:
            if scopes[-1].get(name) or name in SCOPES and outer.get(name):
                yield from until(name)
            elif name == "br":
                yield OPEN, "br", ""
                yield CLOSE, "br", ""
        else:
            if name in ("html", "head", "body") and (scopes[-1].get(name) or outer.get(name)):
                continue
            if scopes[-1].get("head") and name not in HEAD:
                yield from until("head")
            if name in BLOCKS and scopes[-1].get("p"):
                yield from until("p")
            for k in STARTS.get(name, ()):
                if open_[k][-1]:
                    yield from until(*ENDED[k][1].split())
            yield OPEN, name, more
            if name in VOID:
                yield CLOSE, name, ""
            else:
                push(name)
    while stack:
        yield pop()


def words(parts: list[str]) -> str:
    """Text pieces as one line, character references decoded."""
    return " ".join(html.unescape("".join(parts)).split())


def metadata(source: str | None) -> dict:
    """What a page says about itself: title, headings, addresses of links, <time> stamps, rows of its tables (the text of
    the <th> and the texts of the <td>, of rows with either), and the first <strong> after the words "Commit date"."""
    found: dict = {"title": None, "headings": [], "links": [], "times": [], "rows": [], "spoken": None}
    opened: list[tuple[str, list[str]]] = []  # elements whose text is wanted, each with its pieces
    rows: list[tuple[list[str], list[str]]] = []  # rows that are open: texts of th and of td
    said = ""  # the end of the text so far
    for kind, name, more in events(source or ""):
        if kind == TEXT:
            if more not in ("script", "style"):
                for _, pieces in opened:
                    pieces.append(name)
                said = (said + name)[-200:] if name.strip() else said
        elif kind == OPEN:
            given = attributes(more) if more else {}
            if name == "a" and given.get("href"):
                found["links"].append(html.unescape(given["href"]))
            elif name == "time" and given.get("datetime"):
                found["times"].append(html.unescape(given["datetime"]))
            elif name == "tr":
                rows.append(([], []))
            if name in ("title", "h1", "h2", "th", "td") or name == "strong" and found["spoken"] is None and "Commit date" in said:
                opened.append((name, []))
        elif opened and opened[-1][0] == name:
            text = words(opened.pop()[1])
            if name == "title":
                found["title"] = text if found["title"] is None else found["title"]
            elif name in ("h1", "h2"):
                found["headings"].append(text)
            elif name == "strong":
                found["spoken"] = text
            elif rows:
                rows[-1][name == "td"].append(text)
        elif name == "tr" and rows:
            heads, cells = rows.pop()
            if heads or cells:
                found["rows"].append({"title": " ".join(heads), "cells": cells})
    return found
