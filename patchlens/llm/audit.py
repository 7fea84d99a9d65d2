"""Interaction audit of filters: what each of them removes under every order, from one aggregate over all rows.

A row's mask has a bit for each filter that it fails. All that an order of filters does follows from the counts of rows
by part and mask, at most 2**filters cells a part, so the table is read once and no filter is ever applied in turn. The
orders are then visited by adjacent transpositions: one swap leads to the next, and only the two swapped steps are summed
again from the cells; the others keep their figures. Shapley values are summed along the same walk.

audit() is general: masks come as a column. documents() makes them for texts with the five filters below.

    A  fewer than 200 words
    B  distinct words are under half of the words
    C  over 3 of 100 characters are A-Z
    D  holds any of # $ % & * |
    E  equals the text of a row with a smaller doc_id

Null texts are empty; null parts are the empty part. A row without a doc_id is never smaller than another, fails E never
and has no labels; rows that share a doc_id all have its labels and do not fail E against each other; a doc_id labelled
more than once is good (toxic) if any of its labels says so. Equal rows count apart. Without rows there are no parts and
the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import bound

FILTERS = "ABCDE"
FEW, SHARE, CAPITALS = 200, 50, 3
MEASURES = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def transpositions(n: int) -> Iterator[int]:
    """Places i whose swaps of i and i + 1 lead from 0..n-1 through all orders once: the larger item of a run moves on."""
    order, ahead = list(range(n)), [-1] * n
    while True:
        moving = [k for k, x in enumerate(order) if 0 <= k + ahead[x] < n and order[k + ahead[x]] < x]
        if not moving:
            return
        k = max(moving, key=lambda k: order[k])
        x = order[k]
        to = k + ahead[x]
        order[k], order[to] = order[to], order[k]
        for y in range(x + 1, n):
            ahead[y] = -ahead[y]
        yield min(k, to)


class Walk:
    """All orders of one part's filters. cells: for each mask the rows, good rows and toxic rows of it."""

    def __init__(self, cells: np.ndarray, filters: str) -> None:
        self.cells, self.filters = cells, filters
        self.masks = np.arange(len(cells))
        self.alone = [int(cells[1 << f, 0]) for f in range(len(filters))]
        #: sums over all orders of what each filter removes
        self.shapley = [0] * len(filters)

    def step(self, before: int, f: int) -> tuple[int, ...]:
        """kept, removed, redundant, good_lost and toxic_lost of filter f after the filters of the mask before."""
        fails, gone = (self.masks >> f & 1) == 1, (self.masks & before) != 0
        removed = self.cells[fails & ~gone].sum(axis=0)
        return int(self.cells[~fails & ~gone, 0].sum()), int(removed[0]), int(self.cells[fails & gone, 0].sum()), int(removed[1]), int(removed[2])

    def orders(self) -> Iterator[tuple[list[int], list[tuple[int, ...]]]]:
        """Each order with the figures of its steps; shapley is whole once all are visited."""
        n = len(self.filters)
        order = list(range(n))
        before = [(1 << k) - 1 for k in range(n)]
        steps = [self.step(b, f) for b, f in zip(before, order, strict=True)]
        swaps = transpositions(n)
        while True:
            for f, (_, removed, *_) in zip(order, steps, strict=True):
                self.shapley[f] += removed
            yield list(order), list(steps)
            k = next(swaps, None)
            if k is None:
                return
            order[k], order[k + 1] = order[k + 1], order[k]
            before[k + 1] = before[k] | 1 << order[k]
            steps[k], steps[k + 1] = self.step(before[k], order[k]), self.step(before[k + 1], order[k + 1])


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The figures of every order and step for each part of cells (part, mask, n, good, toxic); masks not there count 0.

    The rows of (part, mask) are added up first, so a part is at most 2**filters rows in the task that walks its orders.
    """
    width = 1 << len(filters)

    def walked(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((width, len(MEASURES)), np.int64)
        counts[rows["mask"].to_numpy()] = rows[list(MEASURES)].to_numpy()
        walk, out = Walk(counts, filters), []
        for order, steps in walk.orders():
            name = "".join(filters[f] for f in order)
            for k, (f, (kept, removed, redundant, good, toxic)) in enumerate(zip(order, steps, strict=True)):
                out.append((rows["part"].iloc[0], name, k + 1, kept, removed, redundant, walk.alone[f], good, toxic, f))
        found = pd.DataFrame(out, columns=SCHEMA.replace(" string", "").replace(" bigint", "").replace(" int", "").split(", "))
        return found.assign(shapley=found["shapley"].map(lambda f: walk.shapley[f]))

    summed = cells.groupBy("part", "mask").agg(*(F.sum(m).alias(m) for m in MEASURES))
    return summed.groupBy("part").applyInPandas(walked, SCHEMA)


def masked(bits: Sequence[Column]) -> Column:
    """Conditions as a mask, the first being bit 0; a null one is false."""
    return sum((F.when(bit, F.lit(1 << k)).otherwise(F.lit(0)) for k, bit in enumerate(bits)), F.lit(0))


def own(text: Column) -> Column:
    """The mask of the filters A to D, which a text decides by itself."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return bound(words, lambda w: masked([F.size(w) < FEW, 100 * F.size(F.array_distinct(w)) < SHARE * F.size(w), 100 * capitals > CAPITALS * F.length(text), text.rlike(r"[#$%&*|]")]))


def documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells (part, mask, n, good, toxic) of documents (doc_id, text, lang) with labels (doc_id, quality, toxic).

    Texts are read once and go no further than the scan: they travel as SHA-256 and mask. Copies of a text are added up in
    the tasks that read them, wherever they share part and labels, before the smallest doc_id of the text is looked for.
    Labels are joined by doc_id, equal rows being added up first; a doc_id with very many different texts is a skewed
    join, which adaptive execution splits.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), own(F.col("text")).alias("mask"))
    # rows without a doc_id find no label; their texts spread them
    rows = rows.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n")).withColumn("salt", F.when(F.col("doc_id").isNull(), F.hash("same")).otherwise(F.lit(0)))
    known = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic")).withColumn("salt", F.lit(0))
    rows = rows.join(known, ["doc_id", "salt"], "left").select("doc_id", "part", "same", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    # of the rows of a text the ones with its smallest doc_id do not fail E
    kinds = rows.groupBy("same", "mask", "part", "good", "toxic", F.col("doc_id").isNull().alias("none")).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("first"))
    firsts = F.when(F.col("none"), F.col("n")).when(F.col("least") == F.min("least").over(Window.partitionBy("same")), F.col("first")).otherwise(F.lit(0))
    kinds = kinds.withColumn("first", firsts)
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + F.lit(16)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("cell")
    cells = kinds.select("part", "good", "toxic", both).select("part", "cell.mask", "cell.n", *(F.when(F.col(c), F.col("cell.n")).otherwise(F.lit(0)).alias(c) for c in ("good", "toxic")))
    return cells.groupBy("part", "mask").agg(*(F.sum(m).alias(m) for m in MEASURES))


def duck_sql() -> str:
    """The audit of documents in DuckDB."""
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    bits = [f"len({words}) < {FEW}", f"100 * len(list_distinct({words})) < {SHARE} * len({words})", f"100 * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-Z]', '', 'g'))) > {CAPITALS} * length(coalesce(text, ''))", "regexp_matches(coalesce(text, ''), '[#$%&*|]')", "doc_id IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, ''))"]
    mask = " + ".join(f"CASE WHEN {b} THEN {1 << k} ELSE 0 END" for k, b in enumerate(bits))
    letters = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(FILTERS))
    names = "abcde"
    differ = " AND ".join(f"{x}.c <> {y}.c" for i, x in enumerate(names) for y in names[:i])
    steps = " UNION ALL ".join(f"SELECT filter_order, {k + 1} AS step, {x}b AS own, {' + '.join(f'{y}b' for y in names[:k]) or 0} AS before FROM orders" for k, x in enumerate(names))
    return f"""
WITH known AS (SELECT doc_id, max(quality IS NOT DISTINCT FROM 1) AS good, max(toxic IS NOT DISTINCT FROM 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT doc_id, coalesce(lang, '') AS part, {mask} AS mask FROM documents),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters(c, b) AS (VALUES {letters}),
orders AS (SELECT {' || '.join(f'{x}.c' for x in names)} AS filter_order, {', '.join(f'{x}.b AS {x}b' for x in names)} FROM {', '.join(f'letters {x}' for x in names)} WHERE {differ}),
steps AS ({steps}),
figures AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE mask & (own | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM figures"""
