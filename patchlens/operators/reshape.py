"""Unnesting, regrouping and pivoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, *path: str) -> DataFrame:
    """One row per element of nested arrays, one array field under the other; the last level's fields become columns."""
    for i, field in enumerate(path):
        df = df.select(F.explode(f"{path[i - 1]}.{field}" if i else field).alias(field))
    return df.select(f"{path[-1]}.*")


def with_parents(df: DataFrame, array: str, parents: list[str]) -> DataFrame:
    """Elements of an array, their fields first, then the parent's columns."""
    return df.select(F.explode(array).alias("_child"), *parents).select("_child.*", *parents)


def seen(rows: DataFrame, key: str, file: str, item: str, order: str) -> DataFrame:
    """The long form of regroup(): key, file, item (null for a file without any), each with the place where it was first seen.

    No row and no task holds all files of a key, however many it has; regroup() nests this for a report that asks for it.
    """
    return rows.groupBy(key, file, item).agg(F.min(order).alias("first_seen"))


def regroup(rows: DataFrame, key: str, file: str, item: str, order: str) -> DataFrame:
    """Per key its files in the order they were first seen, each with its distinct items in that order.

    What repeats is combined before anything is shuffled; then rows are dealt by key once, for both nestings. `files` is an
    array of (file, items).
    """
    first = seen(rows, key, file, item, order).withColumnRenamed("first_seen", "_o").repartition(key)
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col(item).isNotNull(), F.struct("_o", F.col(item).alias("v"))))), lambda s: s["v"])
    files = first.groupBy(key, file).agg(F.min("_o").alias("_o"), items.alias("items"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(file).alias("file"), "items"))), lambda s: F.struct(s["file"].alias("file"), s["items"].alias("items")))
    return files.groupBy(key).agg(F.min("_o").alias("first_seen"), listed.alias("files"))


def inverted(rows: DataFrame, file: str, date: str, order: str, fields: list[str]) -> DataFrame:
    """Per file its patches by date (none first), ties in the order of `order`."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(date).isNotNull().alias("_has"), F.col(date).alias("_d"), F.col(order).alias("_o"), F.struct(*fields).alias("p"))))
    return rows.groupBy(file).agg(F.transform(listed, lambda s: s["p"]).alias("patches"))


def attempts(df: DataFrame, array: str, keep: list[str], number: str = "attempt") -> DataFrame:
    """One row per attempt; an empty or missing list is one row of attempt 0, invalid (null) entries of a list are none."""
    kind = df.schema[array].dataType.elementType
    none = F.coalesce(F.size(array), F.lit(0)) <= 0
    listed = F.when(none, F.array(F.lit(None).cast(kind))).otherwise(F.filter(array, lambda a: a.isNotNull()))
    out = df.select(*keep, F.explode(listed).alias("_a"))
    return out.select(*keep, F.coalesce(F.col(f"_a.{number}"), F.lit(0)).alias("attempt_number"), F.col("_a"))


def edges(main: DataFrame, cross: DataFrame) -> DataFrame:
    """(src, tgt, status) of both kinds of attempts: the first needs a target and a result, the second two ends."""
    first = main.filter(F.col("tgt").isNotNull() & F.col("status").isNotNull())
    second = cross.filter(F.col("src").isNotNull() & F.col("tgt").isNotNull())
    return first.select("src", "tgt", "status").unionByName(second.select("src", "tgt", "status"))


def matrix(rows: DataFrame, row: str, column: str, value: str, names: list[str] | None = None) -> DataFrame:
    """Cells as a matrix; a missing one reads `-`. names: the columns, if known, which spares a pass."""
    wide = rows.groupBy(row).pivot(column, names).agg(F.first(F.col(value).cast("string")))
    return wide.na.fill("-")


def counted_list(value: str, count: str) -> Column:
    """`value (n), ...` by count, then value, as an aggregate of counted rows."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("c"), F.col(value).alias("v"))))
    return F.array_join(F.transform(listed, lambda s: F.concat(s["v"].cast("string"), F.lit(" ("), (-s["c"]).cast("string"), F.lit(")"))), ", ")
