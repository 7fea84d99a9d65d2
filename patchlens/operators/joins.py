"""Lookups and set operations as joins; the planner picks the strategy, and broadcasts what is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(ref: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the one that comes last."""
    fields = [c for c in ref.columns if c != key]
    return ref.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_r")).select(key, "_r.*")


def enrich(main: DataFrame, ref: DataFrame, key: str, order: str, fields: list[str], when: Column | None = None) -> DataFrame:
    """Fields of the reference's last row for a key, all together or none: where all are there and `when` holds."""
    found = last_wins(ref.select(key, order, *fields), key, order).drop(order)
    named = found.select(key, *(F.col(c).alias(f"_r_{c}") for c in fields))
    every = F.lit(True) if when is None else when
    for c in fields:
        every = every & F.coalesce(F.col(f"_r_{c}").cast("string") != "", F.lit(False))
    out = main.join(named, key, "left")
    return out.select(*main.columns, *(F.when(every, F.col(f"_r_{c}")).alias(c) for c in fields))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def unfinished(rows: DataFrame, groups: dict[str, DataFrame], key: str, parity: bool = True, left_out: str = "mismatch") -> DataFrame:
    """Rows whose key no group of an earlier run holds; parity: one group is not looked at, so its rows come again."""
    done = None
    for name, group in groups.items():
        if parity and name == left_out:
            continue
        done = group.select(key) if done is None else done.unionByName(group.select(key))
    return rows if done is None else rows.join(done.distinct(), key, "left_anti")


def rejects(failed: DataFrame, files: DataFrame) -> DataFrame:
    """Failed files with the reject files beside them."""
    return failed.join(files, F.concat(failed["file"], F.lit(".rej")) == files["path"])


def first_match(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


#: Versions that are paired at most: a table of versions is small by nature, and pairs are what is asked for.
VERSIONS = 10_000


def ordered_pairs(versions: DataFrame, by: str, most: int = VERSIONS) -> DataFrame:
    """All pairs of a later and an earlier version; more than `most` versions are refused rather than multiplied."""
    if versions.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} versions")
    a = versions.select(F.struct(*versions.columns).alias("a"))
    b = versions.select(F.struct(*versions.columns).alias("b"))
    return a.join(F.broadcast(b), F.col(f"a.{by}") > F.col(f"b.{by}"))


def same_counts(left: DataFrame, right: DataFrame, group: str, version: str) -> DataFrame:
    """Per group whether every version has as many rows on the right as the group has on the left.

    A group without rows on the left expects none; one without rows on the right has no version that could differ.
    """
    have = left.groupBy(group).agg(F.count("*").alias("expected"))
    each = right.groupBy(group, version).agg(F.count("*").alias("n"))
    same = F.col("n") == F.coalesce("expected", F.lit(0))
    known = F.col("n").isNotNull()
    listed = lambda c: F.sort_array(F.collect_list(F.when(known & c, F.col(version))))
    return each.join(have, group, "full").groupBy(group).agg(
        F.bool_and(~known | same).alias("matches"), F.coalesce(F.count_if(known & ~same), F.lit(0)).alias("mismatches"), listed(~same).alias("mismatch_versions"), listed(same).alias("matched_versions")
    )


def attach(rows: DataFrame, content: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """rows with the content's fields where all keys agree and none of a row's is null or empty; otherwise nulls."""
    own = content.dropDuplicates(keys).select(*keys, *fields)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.coalesce(F.col(k).cast("string") != "", F.lit(False))
    asked = rows.withColumn("_whole", whole)
    found = own.withColumn("_whole", F.lit(True))
    return asked.join(found, [*keys, "_whole"], "left").select(*rows.columns, *fields)


def all_rows(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
