"""Grouped counts, rates, funnels and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import percent, tri_state
from ..functions.text import stripped


def count_if(c: Column) -> Column:
    return F.coalesce(F.count_if(c), F.lit(0))


def success_matrix(rows: DataFrame, keys: list[str], status: str, good: str, bad: str) -> DataFrame:
    """Successes, failures and anything else per edge, and the rate of the first."""
    s = F.col(status)
    out = rows.groupBy(*keys).agg(count_if(s == good).alias("successes"), count_if(s == bad).alias("failures"), F.count("*").alias("total_attempts"))
    errors = F.col("total_attempts") - F.col("successes") - F.col("failures")
    return out.select(*keys, "successes", "failures", errors.alias("errors"), "total_attempts", percent(F.col("successes"), F.col("total_attempts")).alias("success_rate"))


def edge_counts(cells: DataFrame, src: str, tgt: str) -> DataFrame:
    return cells.agg(F.count("*").alias("edges"), F.countDistinct(src).alias("sources"), F.countDistinct(tgt).alias("targets"))


def by_source(rows: DataFrame, entity: str, source: str) -> DataFrame:
    """In how many sources an entity fails; the published total is that same number."""
    n = F.countDistinct(source)
    return rows.groupBy(entity).agg(n.alias("appears_in_num_reports"), n.alias("total_failures_across_all_inputs"))


def details(rows: DataFrame, entity: str, sets: list[str], listed: list[str] | None = None) -> DataFrame:
    """Distinct values of each column, sorted, and the number of rows; with `listed` the rows themselves, sorted."""
    out = [F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in sets] + [F.count("*").alias("n_rows")]
    if listed:
        out.append(F.sort_array(F.collect_list(F.struct(*listed))).alias("details"))
    return rows.groupBy(entity).agg(*out)


def shares(rows: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Rows of each key and their percentage of all."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))
    return counted.crossJoin(F.broadcast(total)).select(key, "n", percent(F.col("n"), F.col("_total"), digits).alias("percent"))


def cross_stats(counts: DataFrame, n: str, sources: str | None = None) -> DataFrame:
    """Over counts: how many, how many above one, the largest and the mean; with `sources` also how many are in several sources."""
    c = F.col(n)
    several = [] if sources is None else [count_if(F.col(sources) > 1).alias("in_several")]
    return counts.agg(
        F.count("*").alias("entities"), count_if(c > 1).alias("repeated"), F.coalesce(F.max(c), F.lit(0)).alias("most"),
        F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias("mean"), *several,
    )


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows, numbered: the numbering sees k rows only."""
    few = df.orderBy(*order).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def classified(rows: DataFrame, key: str, status: str, good: str, bad: str) -> DataFrame:
    """Successes, failures and all of a key, and the class that these make."""
    s = F.col(status)
    out = rows.groupBy(key).agg(count_if(s == good).alias("successes"), count_if(s == bad).alias("failures"), F.count("*").alias("total"))
    return out.withColumn("class", tri_state(F.col("successes"), F.col("failures"), F.col("total")))


def unique_versions(rows: DataFrame, version: str, parity: bool = True) -> DataFrame:
    """Distinct versions; parity: the counter that nothing was ever added to."""
    return rows.agg((F.lit(0).cast("bigint") if parity else F.countDistinct(version)).alias("unique_versions"))


def token_rollup(rows: DataFrame, section: str, tokens: Column) -> DataFrame:
    """Both token estimates summed by section."""
    t = rows.select(section, tokens.alias("t"))
    return t.groupBy(section).agg(F.coalesce(F.sum("t.word_based"), F.lit(0)).alias("word_based"), F.coalesce(F.sum("t.char_based"), F.lit(0)).alias("char_based"))


def token_average(rolled: DataFrame, n: Column) -> DataFrame:
    """Sums over a number, rounded; null for none."""
    return rolled.select(*(F.round(F.try_divide(F.col(c).cast("double"), n), 2).alias(c) if c in ("word_based", "char_based") else c for c in rolled.columns))


def accumulated(rows: DataFrame, section: str, tokens: str) -> DataFrame:
    """Sums of stored estimates (a struct whose `general` has both units) by section; what is missing counts 0."""
    unit = lambda u: F.coalesce(F.sum(f"{tokens}.general.{u}"), F.lit(0)).cast("bigint").alias(u)
    return rows.groupBy(section).agg(unit("word_based"), unit("char_based"))


def conflict_tokens(rows: DataFrame, key: str, tokens: str, parity: bool = True) -> DataFrame:
    """Tokens of a file's conflicts; parity: read from the level where they are not, so always 0."""
    n = F.lit(0).cast("bigint") if parity else F.coalesce(F.sum(f"{tokens}.word_based"), F.lit(0))
    return rows.groupBy(key).agg(n.alias("word_based"))


def distinct_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of keys; null is a value like others."""
    return rows.select(*keys).distinct().agg(F.count("*").alias("n"))


def overall_rate(rows: DataFrame, item: list[str], good: Column) -> DataFrame:
    """Distinct items, those with a success, and the rate of these; one row, zeros without any."""
    per = rows.groupBy(*item).agg(F.bool_or(good).alias("_good"))
    out = per.agg(F.count("*").alias("conflicts"), count_if(F.col("_good")).alias("successful"))
    return out.withColumn("success_rate", percent(F.col("successful"), F.col("conflicts")))


def rate_by_pair(rows: DataFrame, pair: list[str], item: list[str], good: Column) -> DataFrame:
    """Per pair the distinct items, those with a success, and the rate: one aggregation per item first."""
    per = rows.groupBy(*pair, *item).agg(F.bool_or(good).alias("_good"))
    out = per.groupBy(*pair).agg(F.count("*").alias("conflicts"), count_if(F.col("_good")).alias("successful"))
    return out.withColumn("success_rate", percent(F.col("successful"), F.col("conflicts")))


def top_errors(rows: DataFrame, message: str, k: int = 3) -> DataFrame:
    """The most frequent messages, of which noise is dropped after the first k are taken."""
    counted = rows.filter(F.col(message).isNotNull()).groupBy(message).agg(F.count("*").alias("n"))
    few = counted.orderBy(F.desc("n"), message).limit(k)
    return few.filter((F.trim(message) != "") & ~F.lower(message).rlike("skip|no llm"))


def rate_text(part: Column, whole: Column) -> Column:
    """100 * part / whole with two decimals and a sign; 0.00% of nothing."""
    return F.concat(F.format_string("%.2f", percent(part, whole)), F.lit("%"))


def applied(status: str = "detailed_status") -> Column:
    """Whether a detailed status tells of success; none tells of none."""
    return F.coalesce(F.contains(F.col(status), F.lit("Applied Successfully")), F.lit(False))


def funnel(fetched: DataFrame, applied_: DataFrame, repaired: DataFrame, failures: DataFrame) -> DataFrame:
    """One row of pipeline totals.

    fetched: one row a patch (failed); applied_: detailed_status, forwarded; repaired: detailed_status, status and token
    counts per file; failures: one row for each file without output. Both rates count patches that applied at once and
    files that were repaired, over the patches tried and over all. The failed total takes files from patches, so it may
    be negative, and rates may exceed 100 %.
    """
    ok = applied()
    one = fetched.agg(F.count("*").alias("total_patches"), count_if(F.col("failed")).alias("fetch_failures"))
    two = applied_.agg(F.count("*").alias("for_application"), count_if(ok).alias("applied_directly"), count_if(F.col("forwarded")).alias("forwarded"))
    three = repaired.agg(count_if(ok).alias("fixed"), count_if(~ok & (F.col("status") == "Rejected")).alias("fix_rejected"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    four = failures.agg(F.count("*").alias("generation_failures"))
    all_ = one.crossJoin(two).crossJoin(three).crossJoin(four)
    done = F.col("applied_directly") + F.col("fixed")
    return all_.select(
        "*", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), done.alias("successful"), (F.col("forwarded") - F.col("fixed")).alias("failed"),
        rate_text(done, F.col("for_application")).alias("application_rate"), rate_text(done, F.col("total_patches")).alias("pipeline_rate"),
    )


def breakdown(rejected: DataFrame, ungenerated: DataFrame) -> DataFrame:
    """Failed repairs under two names: files whose repair was rejected, and files without any; patch_file, project, error_message.

    rejected: rows with detailed_status, status and message_output; ungenerated: rows with error.
    """
    text = stripped(F.col("message_output"))
    one = rejected.filter(~applied() & (F.col("status") == "Rejected")).select(F.lit("LLM_patch_rejected").alias("error_type"), "patch_file", "project", text.alias("error_message"))
    two = ungenerated.select(F.lit("LLM_generation_failed").alias("error_type"), "patch_file", "project", F.coalesce("error", F.lit("LLM did not produce a usable patch.")).alias("error_message"))
    return one.unionByName(two)


def error_ends(rows: DataFrame, error: str, order: str) -> DataFrame:
    """Failures of each error, and the first and the last of them by `order`."""
    return rows.groupBy(F.coalesce(error, F.lit("Unknown Error")).alias("error_type")).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def by_error(rows: DataFrame, error: str, fields: list[str]) -> DataFrame:
    """Failures of each error, and what failed; no error reads Unknown Error. One list an error: for reports that are small by nature."""
    named = rows.withColumn("error_type", F.coalesce(F.col(error), F.lit("Unknown Error")))
    return named.groupBy("error_type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*fields))).alias("failed"))
