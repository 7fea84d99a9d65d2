"""Unified diffs, conflict markers and console output as expressions over text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import bound, places, scanned
from .text import LINE_ENDS, ONE_END, lines, stripped, words_and_chars

#: What begins a section and a hunk, and what encloses a conflict.
HEADER = "diff --git"
HUNK = r"(?m)^@@ .* @@"
GREEDY, LAZY = r"^diff --git a/(.*) b/(.*)$", r"^diff --git a/(.*?) b/(.*)$"
CONFLICT = r"(?s)(<<<<<<<.*?=======.*?>>>>>>>)"


def sections(text: Column) -> Column:
    """Sections from each `diff --git` line on: array of (header, lines); what comes before the first is dropped."""

    def of(parts: Column) -> Column:
        def cut(heads: Column) -> Column:
            upto = lambda k: F.coalesce(F.get(heads, k + 1), F.size(parts) + 1)
            return F.transform(heads, lambda at, k: F.struct(F.element_at(parts, at).alias("header"), F.slice(parts, at, upto(k) - at).alias("lines")))

        return bound(places(parts, lambda line: line.startswith(HEADER)), cut)

    return bound(lines(text), of)


def section_count(text: Column) -> Column:
    """How many sections a text has, without cutting it."""
    # what is looked for comes first and what stands before it is looked at last: most characters are passed over at once
    return F.regexp_count(text, F.lit(rf"{HEADER}(?<![^{ONE_END}]{HEADER})"))


def target(header: Column, lazy: bool = True) -> Column:
    """The new path of a section, empty if its header is odd."""
    return F.regexp_extract(header, LAZY if lazy else GREEDY, 2)


def kept_by_suffix(found: Column, files: Column) -> Column:
    """Sections whose path some file ends with."""
    return F.filter(found, lambda s: F.exists(files, lambda f: (target(s["header"], False) != "") & f.endswith(target(s["header"], False))))


def kept_by_name(found: Column, files: Column) -> Column:
    return F.filter(found, lambda s: F.array_contains(files, target(s["header"])))


def kept_by_mention(found: Column, file: Column) -> Column:
    """Sections whose header line holds the file's name anywhere."""
    return F.filter(found, lambda s: F.contains(s["header"], file))


def patch_of(text: Column, file: Column) -> Column:
    """The first section whose path is the file's (both without leading characters of `ab/`), or empty."""
    bare = lambda c: F.ltrim(c, F.lit("ab/"))
    same = F.filter(sections(text), lambda s: bare(target(s["header"])) == bare(file))
    return F.coalesce(joined(F.slice(same, 1, 1)), F.lit(""))


def file_text(found: Column) -> Column:
    """Sections as a patch file: stripped, with one line end behind them."""
    return F.concat(stripped(joined(found)), F.lit("\n"))


def joined(found: Column) -> Column:
    return F.array_join(F.flatten(F.transform(found, lambda s: s["lines"])), "\n")


def from_hunks(text: Column) -> Column:
    """The text from the first line that begins a hunk, as it is, or empty: cut once, at the first match."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?s)(?:\A|{LINE_ENDS})(@@ .*)", 1)


def hunks_only(text: Column) -> Column:
    """The same with one kind of line end, and none at the end."""
    return bound(F.regexp_replace(from_hunks(text), LINE_ENDS, "\n"), lambda h: F.when(h.endswith("\n"), F.left(h, F.length(h) - 1)).otherwise(h))


def hunk_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(HUNK)).cast("bigint"), F.lit(0))


def line_counts(text: Column) -> Column:
    """(total, added, removed) of the hunk lines after the first `@@ `."""
    # the text begins with a line that is none of them, so every other one follows a line end
    count = lambda hunks, mark: F.regexp_count(hunks, F.lit(rf"[{ONE_END}]{mark}")).cast("bigint")
    return bound(from_hunks(text), lambda h: F.struct(count(h, "[+ -]").alias("total"), count(h, "[+]").alias("added"), count(h, "-").alias("removed")))


def grown(text: Column) -> Column:
    """Added less removed hunk lines: those of line_counts(), which are not all needed."""
    count = lambda hunks, mark: F.regexp_count(hunks, F.lit(rf"{mark}(?<=[{ONE_END}]{mark})")).cast("bigint")
    return bound(from_hunks(text), lambda h: count(h, "[+]") - count(h, "-"))


def conflicts(text: Column, version: Column, commit: Column) -> Column:
    """Conflict blocks, numbered from 1, with their sides under new labels and token estimates."""
    found = F.regexp_extract_all(text, F.lit(CONFLICT), F.lit(1))

    def side(parts: Column, mark: str) -> Column:
        own = F.filter(parts, lambda part: part.startswith(mark) & F.contains(part, F.lit("\n")))
        return F.array_join(F.transform(own, lambda part: F.substring(part, F.instr(part, "\n") + 1, F.length(part))), "\n")

    def one(block: Column, i: Column) -> Column:
        # a block begins with a mark, so every part is a line with a mark and the lines up to the next one
        parts = F.split(F.regexp_replace(block, LINE_ENDS, "\n"), r"\n(?=<<<<<<<|=======|>>>>>>>)", -1)
        whole = lambda p: F.concat(F.lit("<<<<<<< DOWNSTREAM (version "), version, F.lit(")\n"), side(p, "<<<<<<<"), F.lit("\n=======\n"), side(p, "======="), F.lit("\n>>>>>>> UPSTREAM PATCH (commit "), commit, F.lit(")"))
        record = lambda w: F.struct((i + 1).alias("hunk_number"), w.alias("merge_conflict"), words_and_chars(w).alias("merge_conflict_tokens"))
        return bound(bound(parts, whole), record)

    return F.transform(found, one)


def failed_files(output: Column) -> Column:
    """Files with a failed hunk, sorted: each failure counts for the file that was named last."""
    named = lambda line: F.nullif(F.trim(F.regexp_extract(line, "^(?:checking|patching) file (.+)", 1)), F.lit(""))
    failed = lambda line: F.contains(line, F.lit("FAILED")) & F.contains(F.lower(line), F.lit("hunk"))

    def of(parts: Column) -> Column:
        last = scanned(F.transform(parts, named), lambda a, b: F.coalesce(b, a))
        return F.array_sort(F.array_distinct(F.array_compact(F.zip_with(last, parts, lambda file, line: F.when(failed(line), file)))))

    return bound(lines(F.coalesce(output, F.lit(""))), of)


def missing_files(patch: Column, output: Column, rejects: Column) -> Column:
    """Old paths of a patch whose files were not found: only without reject files."""
    named = F.regexp_extract_all(patch, F.lit("diff --git a/(.*?) b/"), F.lit(1))
    return F.when((F.coalesce(F.size(rejects), F.lit(0)) <= 0) & F.contains(output, F.lit("can't find file to patch")), named).otherwise(F.array().cast("array<string>"))


def hunk_totals(output: Column) -> Column:
    """(total hunks, failed hunk numbers); without a total, the highest failed number."""
    failed = F.transform(F.regexp_extract_all(output, F.lit(r"Hunk #(\d+) FAILED"), F.lit(1)), lambda x: x.cast("int"))
    total = F.try_to_number(F.nullif(F.regexp_extract(output, r"(\d+) out of (\d+) hunks FAILED", 2), F.lit("")), F.lit("9999999999")).cast("int")
    return F.struct(F.coalesce(total, F.array_max(failed), F.lit(0)).alias("total_hunks"), failed.alias("failed_hunks"))


# what needs a grammar
RANGE = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")


def parse(text: str | None) -> tuple[str, str]:
    """(hunks of all files, error) of a unified diff: every hunk must have the lines that its header counts."""
    out: list[str] = []
    old = new = 0
    headed = False
    for number, line in enumerate((text or "").splitlines(), 1):
        if old > 0 or new > 0:
            if line[:1] in (" ", ""):
                old, new = old - 1, new - 1
            elif line[:1] == "-":
                old -= 1
            elif line[:1] == "+":
                new -= 1
            elif line[:1] != "\\":
                return "", f"line {number}: neither context nor change"
            if old < 0 or new < 0:
                return "", f"line {number}: a hunk is longer than its header says"
            out.append(line)
        elif found := RANGE.match(line):
            if not headed:
                return "", f"line {number}: a hunk without a file"
            old, new = (int(x) if x is not None else 1 for x in found.groups())
            out.append(line)
        elif line.startswith("@@"):
            return "", f"line {number}: a bad hunk header"
        elif line.startswith("\\") and out:
            out.append(line)
        elif line.startswith("+++ "):
            headed = True
    if old > 0 or new > 0:
        return "", "a hunk is shorter than its header says"
    return ("\n".join(out), "") if out else ("", "no hunks")


PARSED = T.StructType().add("hunks", "string").add("valid", "boolean").add("error", "string")


@F.pandas_udf(PARSED)
def parsed(texts: pd.Series) -> pd.DataFrame:
    """parse() of every value, in Arrow batches."""
    rows: Iterator[tuple[str, str]] = map(parse, texts)
    found = pd.DataFrame(rows, columns=["hunks", "error"])
    found.insert(1, "valid", found["error"] == "")
    return found
