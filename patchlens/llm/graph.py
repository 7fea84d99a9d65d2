"""Joins that a hot key cannot skew, and connected components of edges that stay distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import cut

#: Keys that are broadcast at most, and the least rows of a key for that. With the HOT keys of most rows taken out, no
#: key left has more than 1 / HOT of all rows.
HOT, LEAST = 1000, 100
#: Rows of a table that is broadcast whole, at most: some 20 MB.
WHOLE = 200_000


def hottest(df: DataFrame, rows: str, most: int = HOT) -> list[Row]:
    """The at most `most` rows of a table of keys with the most rows (a column that says how many), none below LEAST."""
    return [r for r in df.orderBy(F.desc(rows)).limit(most).collect() if r[rows] >= LEAST]


def lookup(left: DataFrame, right: DataFrame, key: str, hot: list[Row], how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and is cut; how: inner or left; hot: the hottest of right's rows.

    Rows of hot keys meet a broadcast of these; the others are shuffled. The keys are data of that broadcast and no
    literals, which plans would carry.
    """
    if not hot:
        return left.join(right, key, how)
    few = left.sparkSession.createDataFrame([tuple(r[c] for c in right.columns) for r in hot], right.schema)
    found = F.struct(*(c for c in right.columns if c != key)).alias("_hot")
    marked = left.join(F.broadcast(few.select(key, found)), key, "left")
    some = marked.filter("_hot IS NOT NULL").select(*left.columns, "_hot.*")
    return some.unionByName(marked.filter("_hot IS NULL").drop("_hot").join(right, key, how))


def near(table: DataFrame, most: int = WHOLE) -> DataFrame:
    """A table, which is cut, marked for broadcast if it has at most `most` rows."""
    return F.broadcast(table) if table.count() <= most else table


def apart(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """df, which is cut and has one row for each combination of values, with `name`, a 64-bit hash of these, made unique.

    Of rows that share a hash all but the first get another one; there are next to none, so they are collected.
    """
    twice = [r[name] for r in df.groupBy(name).agg(F.count("*").alias("_n")).filter("_n > 1").select(name).collect()]
    if not twice:
        return df
    shared = F.col(name).isin(twice)
    number = F.row_number().over(Window.partitionBy(name).orderBy(*values))
    again = df.filter(shared).withColumn("_n", number).withColumn(name, F.when(F.col("_n") > 1, F.xxhash64(name, "_n")).otherwise(F.col(name))).drop("_n")
    return cut(df.filter(~shared).unionByName(again))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to another; edges: src, dst (long), in any order, repeated or not.

    Each round every node joins the neighbour that a fresh hash puts first, if it comes before the node itself, and
    edges move to what their ends have joined. An expected constant share of the nodes that still have edges goes
    each round, however long the chains. At most the HOT nodes of most edges are collected; each round is cut through
    the checkpoint folder. The root is some node of the component, the same for all its nodes.
    """
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    left = cut(edges.filter("src <> dst").select(F.explode(ways).alias("e")).select("e.*").distinct())
    most = left.count()
    rounds: list[tuple[DataFrame, list[Row], int]] = []
    while most:
        turn = F.lit(len(rounds))
        order = lambda c, t=turn: F.struct(F.xxhash64(t, c).alias("h"), F.col(c).alias("v"))
        best = left.groupBy("src").agg(F.min(order("dst")).alias("best"), F.count("*").alias("links"))
        joined = cut(best.select(F.col("src").alias("node"), F.least("best", order("src"))["v"].alias("to"), "links"), most)
        hot = hottest(joined, "links")
        rounds.append((joined, hot, most))
        moved = left
        for end in ("src", "dst"):
            named = joined.select(F.col("node").alias(end), F.col("to").alias("_to"))
            moved = lookup(moved, named, end, [Row(**{end: r["node"], "_to": r["to"]}) for r in hot]).drop(end).withColumnRenamed("_to", end)
        left = cut(moved.filter("src <> dst").select("src", "dst").distinct(), most)
        most = left.count()
    # where a round sends a node, later rounds may send on; a node to which many are sent had as many edges
    roots: DataFrame | None = None
    for joined, hot, most in reversed(rounds):
        here = joined.select("node", F.col("to").alias("root"))
        if roots is not None:
            after = roots.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            few = []
            if hot:
                known = here.sparkSession.createDataFrame([(r["node"],) for r in hot], "root bigint")
                few = after.join(F.broadcast(known), "root", "left_semi").collect()
                # hot nodes that no later round knows stay where they are
                few += [Row(root=r["node"], _to=None) for r in hot if r["node"] not in {x["root"] for x in few}]
            here = lookup(here, after, "root", few, "left").select("node", F.coalesce("_to", "root").alias("root"))
        roots = cut(here, most)
    return roots if roots is not None else edges.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("root"))


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i], all at once; root[x] is the first node of the component of x, before and after."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]
