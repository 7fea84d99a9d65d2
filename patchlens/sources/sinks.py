"""Report sinks. Each writes a folder by Spark's committer: a failed task or job leaves nothing that a reader sees.

A report that is one large document is written as sorted parts: in the order of their names they are the document.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def json_document(df: DataFrame, path: str, root: str | None = None, compression: str = "none") -> None:
    """Rows as JSON lines; with a root, one object that holds them all (for reports that are small by nature)."""
    out = df if root is None else df.agg(F.collect_list(F.struct(*df.columns)).alias(root))
    out.write.mode("overwrite").option("compression", compression).json(path)


def document(df: DataFrame, path: str, root: str, *order: str) -> None:
    """One JSON object whose field `root` lists the rows by `order`, which tells all of them apart.

    A row is a line, and ranges of rows are written by tasks of their own: the first line opens the list, rows but the first
    begin with a comma, the last line closes it. Nothing holds more than a row.
    """
    keys = F.struct(*order)
    rows = df.select(keys.alias("_key"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("json"))
    first = rows.agg(F.min("_key").alias("_first"))
    lines = rows.crossJoin(F.broadcast(first)).select(F.lit(1).alias("_kind"), "_key", F.concat(F.when(F.col("_key") == F.col("_first"), " ").otherwise(","), "json").alias("value"))
    none = F.lit(None).cast(rows.schema["_key"].dataType)
    ends = df.sparkSession.createDataFrame([(0, f'{{"{root}": ['), (2, "]}")], "_kind int, value string").select("_kind", none.alias("_key"), "value")
    lines.unionByName(ends).repartitionByRange("_kind", "_key").sortWithinPartitions("_kind", "_key").select("value").write.mode("overwrite").text(path)


def by_date(df: DataFrame, path: str, date: str, order: str) -> None:
    """Sorted by date, rows without one first, ties in their order."""
    df.orderBy(F.col(date).asc_nulls_first(), order).write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("compression", compression).csv(path)


def by_suffix(df: DataFrame, path: str | None) -> str | None:
    """JSON or CSV as the path's suffix says; another one is only warned about, no path writes nothing."""
    if not path:
        return None
    kind = path.rpartition(".")[2].lower()
    if kind == "json":
        json_document(df, path)
    elif kind == "csv":
        csv(df, path)
    else:
        log.warning("no format for %s", path)
        return None
    return kind


def id_list(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def checkpoint(done: DataFrame, path: str) -> None:
    """Adds finished rows to the table that a later run leaves out."""
    done.write.mode("append").parquet(path)


def failures(entries: DataFrame, averages: DataFrame, path: str) -> bool:
    """The failures-only report beside a main one: rows and averages as two tables; nothing is written without failures."""
    if not entries.limit(1).count():
        return False
    json_document(entries, f"{path}/failures", compression="gzip")
    json_document(averages, f"{path}/summary")
    return True


def html_table(df: DataFrame, order: str) -> DataFrame:
    """A small table as one HTML text, in the order of a column that is not shown."""
    shown = [c for c in df.columns if c != order]
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<tr>"), *(x for c in shown for x in (F.lit("<td>"), escaped(c), F.lit("</td>"))), F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in shown) + "</tr>"
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r"))))
    return df.agg(F.concat(F.lit(f"<table>{head}"), F.array_join(F.transform(listed, lambda x: x["r"]), ""), F.lit("</table>")).alias("html"))


def heatmap_cells(cells: DataFrame) -> DataFrame:
    """What a heat map shows: the rate (a missing one is 0) and its label."""
    rate = F.coalesce(F.col("success_rate"), F.lit(0.0))
    return cells.select("*", rate.alias("shown"), F.concat(F.format_string("%.2f", rate), F.lit("% ("), F.col("total_attempts").cast("string"), F.lit(")")).alias("label"))
