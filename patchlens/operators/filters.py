"""Predicates over nested reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import naive


def qualifies(affected: Column, published: Column, after: Column, before: Column) -> Column:
    """Whether some affected element is of the platform, of a patch level ending in -01, in the range of dates."""
    when = naive(published).between(after, before)
    return F.coalesce(when & F.exists(affected, lambda a: a["package"]["name"].startswith("platform/") & a["ecosystem_specific"]["spl"].endswith("-01")), F.lit(False))


def named(id_: Column, aliases: Column, wanted: str) -> Column:
    return F.coalesce((id_ == wanted) | F.array_contains(aliases, wanted), F.lit(False))


def page(df: DataFrame, start: int, limit: int, *order: Column) -> DataFrame:
    """Rows from `start` on; limit 0 means no limit."""
    out = df.orderBy(*order).offset(start)
    return out.limit(limit) if limit else out


def role(versions: Column, allowed: list[str]) -> Column:
    """upstream if the first version names `next`; downstream if it is allowed and not 15; otherwise null."""
    first = F.try_element_at(versions, F.lit(1))
    return F.when(F.contains(first, F.lit("next")), "upstream").when((first != "15") & first.isin(allowed), "downstream")


def of_version(df: DataFrame, failures: str, version: str, keep: list[str]) -> DataFrame:
    """Rows with only the failures of a version; rows left without any go."""
    own = F.filter(failures, lambda f: f["downstream_version"] == version)
    return df.select(*keep, own.alias(failures)).filter(F.size(failures) > 0)


def alias_ids(df: DataFrame, aliases: str) -> DataFrame:
    """Distinct aliases that begin like a CVE number."""
    return df.select(F.explode(aliases).alias("cve")).filter(F.col("cve").rlike(r"^CVE-\d{4}-\d+")).distinct()


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.select(column).filter(F.col(column).startswith(prefix)).distinct()


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where none of the columns is null or empty."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return df


def without(df: DataFrame, array: str, *fields: str) -> DataFrame:
    """The array's elements without heavy fields."""
    return df.withColumn(array, F.transform(array, lambda x: x.dropFields(*fields)))


def relevant_files(df: DataFrame, key: str, affected: str, signatures: str) -> DataFrame:
    """Files that the signatures (a field path in an affected element) of a row name, sorted."""
    each = df.select(key, F.explode_outer(affected).alias("a")).select(key, F.explode_outer(f"a.{signatures}").alias("s"))
    return each.groupBy(key).agg(F.sort_array(F.collect_set("s.target.file")).alias("files"))


def flag(text: Column) -> Column:
    """Text as a flag: null is false, what is neither true nor false is true."""
    return F.when(text.isNull(), False).when(F.lower(text) == "true", True).when(F.lower(text) == "false", False).otherwise(True)


def number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def label(text: Column) -> Column:
    return F.coalesce(text, F.lit("nan"))
