"""Operations that follow an order over a whole table, without a task that sees all of it.

Rows are dealt to ranges of the order and sorted there; each range is worked on by itself, in one pass that is stored in
the shared folder; what a range needs from the ones before it is one small row for each range, and is put in afterwards.
A hot key therefore spreads over as many ranges as its rows fill, and a lost task repeats one range. Tables hold one row
for each partition where this says `carry`; nothing else goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: A row's place among those of its partition, below this bit of Spark's increasing id, and its partition above.
PLACE = 33


def whole_row(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def dealt(df: DataFrame, parts: int | None, *order: Column | str) -> DataFrame:
    """Ranges of an order, each sorted; as many as shuffles have partitions where parts is not given."""
    return (df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)).sortWithinPartitions(*order)


def ranked(df: DataFrame, *order: Column, name: str = "rank", parts: int | None = None) -> DataFrame:
    """All rows numbered from 1 by a total order: ranges are numbered apart, and the sizes of those before are added.

    Rows that are equal in `order` are numbered in some order of their own. Only JVM expressions take part.
    """
    rows = scratch.stored(dealt(df, parts, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PLACE)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_at") - F.shiftleft(part, PLACE)
    found = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return found.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + place + 1).alias(name))


def as_of(requests: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, fields: list[str], order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """requests with the fields of the last version of their key whose `since` is not after `at`; null where there is none.

    Of versions of one time the last by `order` counts, then the largest by its fields. Null keys and times match nothing.
    """
    ready = lambda time: [F.col(k).isNotNull() for k in [*keys, time]]
    known = versions
    for c in ready(since):
        known = known.filter(c)
    key = F.to_json(F.struct(*keys)).alias("_key")
    rows = requests.select(whole_row(requests), key, F.col(at).alias("_time"))
    content = known.select(
        F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), key, F.col(since).cast(requests.schema[at].dataType).alias("_time"), F.lit(0).alias("_side"),
        F.struct(*(order or []), *fields).alias("_ways"), F.lit(0).cast("bigint").alias("_spread"), F.struct(*(F.col(f).alias(f"f{i}") for i, f in enumerate(fields))).alias("_held"),
    )
    asked = rows.select("_row", "_key", "_time", F.lit(1).alias("_side"), F.lit(None).cast(content.schema["_ways"].dataType).alias("_ways"), F.monotonically_increasing_id().alias("_spread"), F.lit(None).cast(content.schema["_held"].dataType).alias("_held"))
    by = ["_key", "_time", "_side", "_ways", "_spread"]
    sorted_ = dealt(content.unionByName(asked), parts, *by).select("_row", "_key", "_side", "_held")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests with the last version of this range; the range's own last version as a row without a request."""
        part = TaskContext.get().partitionId()
        last_key: str | None = None
        carry: pa.Array | None = None  # the last version of last_key, if any
        first_key, seen = None, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys_, side, held_ = batch.column(1), batch.column(2).to_numpy(), batch.column(3)
            code = keys_.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            if not seen:
                first_key, seen = keys_[0].as_py(), True
            if keys_[0].as_py() != last_key:
                carry = None
            new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            begins = np.repeat(new, np.diff(np.append(new, n)))
            place = np.maximum.accumulate(np.where(side == 0, np.arange(n), -1))
            place = np.where(place >= begins, place, -1)
            # before the batch's first version of the key that goes on, the carried one
            goes_on = begins == 0
            values = pa.concat_arrays([held_, carry if carry is not None else pa.nulls(1, held_.type)])
            place = np.where((place < 0) & goes_on & (carry is not None), n, place)
            taken = values.take(pa.array(place, pa.int64(), mask=place < 0))
            asks = np.flatnonzero(side == 1)
            # nothing of its key stands before it in this range, and its key is the one that the range begins with
            open_ = (place[asks] < 0) & (begins[asks] == 0) & (keys_[0].as_py() == first_key)
            if len(asks):
                chosen = pa.array(asks)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), keys_.take(chosen), taken.take(chosen), pa.array(open_), pa.array(np.full(len(asks), part), pa.int32()), pa.array(np.ones(len(asks), bool))], ["_row", "_key", "_held", "_open", "_part", "_asked"])
            last_key = keys_[n - 1].as_py()
            end = int(place[n - 1])
            carry = values.slice(end, 1) if end >= 0 else None
        if seen:
            types = {f.name: f.type for f in batch.schema}
            yield pa.RecordBatch.from_arrays([pa.nulls(1, types["_row"]), pa.array([last_key], types["_key"]), carry if carry is not None else pa.nulls(1, types["_held"]), pa.array([carry is not None]), pa.array([part], pa.int32()), pa.array([False])], ["_row", "_key", "_held", "_open", "_part", "_asked"])

    kinds = {f.name: f.dataType.simpleString() for f in sorted_.schema}
    done = scratch.stored(sorted_.mapInArrow(filled, f"_row {kinds['_row']}, _key string, _held {kinds['_held']}, _open boolean, _part int, _asked boolean"))
    # of the ranges before, the last that holds a version of its last key; ranges between are of that key alone
    ends = done.filter("NOT _asked").select(F.col("_part").alias("_p"), F.col("_key").alias("_k"), F.col("_open").alias("_has"), F.col("_held").alias("_h"))
    over = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_p", F.last(F.when(F.col("_has"), F.struct(F.col("_k").alias("k"), F.col("_h").alias("h"))), True).over(over).alias("_from"))
    found = done.filter("_asked").join(F.broadcast(carried), F.col("_part") == F.col("_p"), "left")
    given = F.when(F.col("_open") & (F.col("_from.k") == F.col("_key")), F.col("_from.h")).otherwise(F.col("_held"))
    whole = F.lit(True)
    for c in ready(at):
        whole = whole & c
    out = found.select("_row.*", given.alias("_given")).withColumn("_whole", whole)
    return out.select(*(F.col(f"`{c}`") for c in requests.columns), *(F.when(F.col("_whole"), F.col(f"_given.f{i}")).alias(f) for i, f in enumerate(fields)))


def composed(maps: np.ndarray) -> np.ndarray:
    """Of maps of states (one a row): the first, the second after the first, and so on."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def states(df: DataFrame, order: list[Column], symbol: Column, machine: list[list[int]], start: int = 0, name: str = "state", parts: int | None = None) -> DataFrame:
    """df with the state of a finite machine before each row, when the rows are read in a total order.

    symbol: a number of each row (null: nothing happens); machine: for each symbol the state that follows each state. A
    range's rows are read from all states at once: each row is stored with the state that it finds for every state that its
    range may begin in. Where the ranges really begin follows from one such row for each of them.
    """
    table = np.array(machine, np.uint8)
    if table.ndim != 2 or not 0 < table.shape[1] <= 256 or table.max(initial=0) >= table.shape[1]:
        raise ValueError("a machine of 1 to 256 states, whose rows say what follows each")
    table = np.vstack([table, np.arange(table.shape[1], dtype=np.uint8)])
    count = table.shape[1]
    code = F.coalesce(symbol.cast("int"), F.lit(len(table) - 1))
    rows = dealt(df, parts, *order).select(whole_row(df), code.alias("_code"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), np.arange(count, dtype=np.uint8)
        row_type, any_ = None, False
        for batch in batches:
            n, row_type = batch.num_rows, batch.column(0).type
            if not n:
                continue
            any_ = True
            maps = composed(table[batch.column(1).to_numpy()])
            maps = maps[np.arange(n)[:, None], so_far]
            before = np.vstack([so_far, maps[:-1]])
            so_far = maps[-1]
            found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(count), n, [None, pa.py_buffer(before.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, pa.array(np.full(n, part), pa.int32()), pa.array(np.ones(n, bool))], ["_row", "_map", "_part", "_is"])
        if any_:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, row_type), pa.array([so_far.tobytes()], pa.binary()), pa.array([part], pa.int32()), pa.array([False])], ["_row", "_map", "_part", "_is"])

    done = scratch.stored(rows.mapInArrow(read, f"_row {rows.schema['_row'].dataType.simpleString()}, _map binary, _part int, _is boolean"))
    begins, at = [], start
    for r in done.filter("NOT _is").select("_part", "_map").orderBy("_part").collect():  # one for each partition
        begins.append((r["_part"], at))
        at = r["_map"][at]
    starts = df.sparkSession.createDataFrame(begins, "_part int, _begin int")
    byte = F.conv(F.hex(F.substring("_map", F.col("_begin") + 1, F.lit(1))), 16, 10).cast("int")
    return done.filter("_is").join(F.broadcast(starts), "_part").select("_row.*", byte.alias(name))
