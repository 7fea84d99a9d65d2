"""Places of regular-expression matches by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scan import bound, scanned

#: Code points of a piece in which a place is looked up.
CHUNK = 256
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def placed(text: Column, pattern: str, found: Column, rank: int, kind: str, keep: Column | None = None) -> Column:
    """Spans of a pattern's matches, in code points, end exclusive; linear in the number of matches.

    found: matches(text, pattern). keep: for each match whether it stays (null: all); others still hold their place.
    The texts between the matches are what split() leaves, so a match begins where all before it ends.
    """

    def of(sizes: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(sizes))
        ends = scanned(F.zip_with(gaps, sizes, lambda gap, size: gap + size), lambda a, b: a + b)
        return F.zip_with(ends, sizes, lambda end, size: F.struct((end - size).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")))

    spans = bound(F.transform(found, F.length), of)
    if keep is not None:
        spans = F.array_compact(F.zip_with(spans, keep, lambda span, stays: F.when(stays, span)))
    return F.when(F.size(found) > 0, spans).otherwise(F.array()).cast(SPAN)


def chunks(text: Column) -> Column:
    """A text as pieces of CHUNK code points."""
    return matches(text, f"(?s).{{1,{CHUNK}}}")


def between(parts: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text cut by chunks(): no look at what stands far before."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def duck_spans(pattern: str, rank: int, kind: str, keep: str = "true", text: str = "text") -> str:
    """The same as a DuckDB expression: a list of structs; keep: a condition on m (the match) and i (its number)."""
    quoted = pattern.replace("'", "''")
    # equal inputs give equal lists, so the parts are written out again rather than named
    every = f"regexp_extract_all({text}, '{quoted}')"
    gaps = f"string_split_regex({text}, '{quoted}')"
    start = f"list_sum(list_transform(({gaps})[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(({every})[1:i - 1], lambda g: length(g))), 0)::BIGINT"
    one = f"{{'start': {start}, 'rank': {rank}, 'kind': '{kind}', 'end': {start} + length(m)}}"
    return f"list_filter(list_transform({every}, lambda m, i: CASE WHEN {keep} THEN {one} END), lambda s: s IS NOT NULL)"


def duck_written(spans: str) -> str:
    return f"list_reduce(list_prepend('', list_transform({spans}, lambda s: s.kind || ':' || s.start || ':' || s['end'])), lambda a, b: CASE WHEN a = '' THEN b ELSE a || ',' || b END)"
