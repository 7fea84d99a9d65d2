"""Date expressions; text that is no date gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def naive(text: Column) -> Column:
    """ISO time without its zone."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(?:Z|[+-]\d\d:?\d\d)$", "")).cast("timestamp_ntz")


def aware(text: Column) -> Column:
    """ISO time with a zone (none: UTC) as an instant."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def commit_time(text: Column) -> Column:
    """`Mon Jan 01 10:00:00 2024 +0100`, or a date like 2024-01-01 10:00:00 +0100 anywhere inside."""
    inside = F.regexp_extract(text, r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d [+-]\d{4})", 1)
    return F.coalesce(
        F.try_to_timestamp(F.regexp_replace(F.substring(text, 5, 100), r"^([A-Z][a-z]{2}) +", "$1 "), F.lit("MMM d HH:mm:ss yyyy Z")),
        F.try_to_timestamp(inside, F.lit("yyyy-MM-dd HH:mm:ss Z")),
    )


def page_time(text: Column) -> Column:
    """`Jan 05, 2024 3:07PM`, else ISO; without zone."""
    spoken = F.try_to_timestamp(text, F.lit("MMM d, yyyy h:mma"))
    return F.coalesce(spoken.cast("timestamp_ntz"), naive(text))


def commit_row(label: Column, parity: bool = True) -> Column:
    """Whether a row's label names the committer; parity: any part of that word does, the empty one too."""
    low = F.lower(F.trim(label))
    return F.contains(F.lit("committer"), low) if parity else low == "committer"


def epoch(time: Column) -> Column:
    """Seconds since 1970, 0 without a time."""
    return F.coalesce(F.unix_timestamp(time), F.lit(0)).cast("bigint")
