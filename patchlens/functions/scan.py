"""Running values over arrays in linear time, by array expressions alone.

A fold that appends to an array copies it at every step. Here arrays are cut into blocks, each block is folded by
itself, and what comes before a block is folded over the blocks' last values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scanned(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of an array v0, v1, v2, ...: v0, op(v0, v1), op(op(v0, v1), v2), ...; op is associative and sees nulls as they are."""
    last = lambda a: F.element_at(a, -1)

    def within(block: Column) -> Column:
        return F.aggregate(F.slice(block, 2, BLOCK), F.slice(block, 1, 1), lambda out, v: F.array_append(out, op(last(out), v)))

    def of(every: Column) -> Column:
        count = F.ceil(F.size(every) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: within(F.slice(every, k * BLOCK + 1, F.lit(BLOCK))))

        def joined(parts: Column) -> Column:
            before = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts[0], -1, 1), lambda out, part: F.array_append(out, op(last(out), last(part))))
            return bound(before, lambda b: F.flatten(F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(F.transform(part, lambda v: op(F.get(b, k - 1), v))))))

        return F.when(F.size(every) > 0, bound(blocks, joined)).otherwise(every)

    return bound(values, of)


def before(sizes: Column) -> Column:
    """Of an array of numbers the sums of those before each."""
    return bound(sizes, lambda every: F.zip_with(scanned(every, lambda a, b: a + b), every, lambda total, own: total - own))


def places(every: Column, holds: Callable[[Column], Column]) -> Column:
    """Places (from 1) of the values that hold."""
    return F.filter(F.when(F.size(every) > 0, F.sequence(F.lit(1), F.size(every))).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(holds(F.element_at(every, i)), F.lit(False)))
