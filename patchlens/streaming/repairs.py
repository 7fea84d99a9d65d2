"""Self-correction over a stream of attempts: a task stops at its first valid attempt or at the limit, and tokens add up.

Attempts come late, out of order and more than once. A task keeps at most `limit` of them as state until all up to where
it stops are there; then one row goes out, and what comes later is passed over. A task that does not get there is closed
as it stands once the watermark is `wait` past its last attempt; closed and open tasks leave no state behind after that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "task string, success boolean, attempts int, input_tokens bigint, output_tokens bigint, complete boolean"
#: Columns of an attempt.
FIELDS = ("task", "attempt", "at", "valid", "input_tokens", "output_tokens")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decided(held: dict[int, tuple], limit: int) -> tuple[bool, int, int, int, bool]:
    """(success, attempts, input tokens, output tokens, complete) of the attempts that a task has.

    Those after the first valid one do not count; complete: all up to it, or up to the limit, are there.
    """
    stop = min([n for n, a in held.items() if a[1]], default=limit)
    counted = [a for n, a in held.items() if n <= stop]
    complete = len(counted) == stop
    return any(a[1] for a in counted), len(counted), sum(a[2] for a in counted), sum(a[3] for a in counted), complete


#: What is kept of a bucket's tasks: their names, the times of their last attempts, whether their rows went out, and their
#: attempts, five numbers each.
STATE = "tasks array<string>, last array<bigint>, closed array<boolean>, held array<array<bigint>>"
#: Keys of the state. A call for a key costs milliseconds whatever it does; one for many tasks costs little more.
BUCKETS = 4096


def kept(flat: list[int]) -> dict[int, tuple]:
    return {flat[k]: (flat[k + 1], bool(flat[k + 2]), flat[k + 3], flat[k + 4]) for k in range(0, len(flat), 5)}


def step(limit: int, wait_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What a micro-batch does to a bucket of tasks, each of which goes its own way and is closed at its own time."""

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tasks = {t: (last, closed, kept(flat)) for t, last, closed, flat in zip(*state.get, strict=True)} if state.exists else {}
        out, touched, now = [], set(), state.getCurrentWatermarkMs()
        for part in () if state.hasTimedOut else parts:
            for task, (attempt, at, valid, *tokens) in zip(part["task"], part["a"], strict=True):
                last, closed, held = tasks.get(task, (0, False, {}))
                if not closed and 1 <= attempt <= limit:
                    new = (int(at), bool(valid), *map(int, tokens))
                    # of repeated attempts the first in time counts
                    held[int(attempt)] = min(new, held.get(int(attempt), new))
                # an attempt that comes behind the watermark waits from there
                tasks[task] = (max(last, int(at), now), closed, held)
                touched.add(task)
        for task in touched:
            last, closed, held = tasks[task]
            if not closed and (found := decided(held, limit))[-1]:
                out.append((task, *found))
                tasks[task] = (last, True, {})
        for task in [t for t, (last, _, _) in tasks.items() if last + wait_ms < now]:
            held = tasks.pop(task)[2]
            if held:
                out.append((task, *decided(held, limit)))
        if tasks:
            flat = [[x for n, a in held.items() for x in (n, a[0], int(a[1]), a[2], a[3])] for _, _, held in tasks.values()]
            state.update((list(tasks), [last for last, _, _ in tasks.values()], [closed for _, closed, _ in tasks.values()], flat))
            state.setTimeoutTimestamp(max(min(last for last, _, _ in tasks.values()) + wait_ms, now) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["task", "success", "attempts", "input_tokens", "output_tokens", "complete"])

    return run


def repaired(stream: DataFrame, limit: int = 3, late: str = "1 hour", wait: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """A row for each task of a stream of (task, attempt, time, valid, input_tokens, output_tokens), as it is decided.

    late: how far behind the latest a row may come; wait: how long a task waits for attempts that are not there yet. The
    session's state store may be any; the RocksDB one keeps state out of the heap. Tasks share `buckets` keys of it, which
    stay as they are while a checkpoint lives. Rows without a task, an attempt or a time are left out; a null `valid` is
    false, null tokens are 0.
    """
    wait_ms = int(pd.Timedelta(wait) / pd.Timedelta("1ms"))
    rows = stream.filter("task IS NOT NULL AND attempt IS NOT NULL AND time IS NOT NULL").withWatermark("time", late)
    number = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    one = F.array(F.col("attempt").cast("bigint"), F.unix_millis("time"), F.coalesce("valid", F.lit(False)).cast("int").cast("bigint"), *map(number, FIELDS[4:]))
    rows = rows.select(F.col("task").cast("string"), one.alias("a"), "time")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("task"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(step(limit, wait_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def repaired_at_once(rows: DataFrame, limit: int = 3) -> DataFrame:
    """The same of a table: what a stream gives once all its rows have come and all tasks are closed."""
    fit = rows.filter(f"task IS NOT NULL AND attempt BETWEEN 1 AND {limit} AND time IS NOT NULL")
    one = F.struct("time", F.coalesce("valid", F.lit(False)).alias("valid"), *(F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in FIELDS[4:]))
    first = fit.groupBy(F.col("task").cast("string").alias("task"), "attempt").agg(F.min(one).alias("a"))
    stops = F.coalesce(F.min(F.when(F.col("a.valid"), F.col("attempt"))), F.lit(limit)).alias("stop")
    tasks = first.groupBy("task").agg(stops, F.collect_list(F.struct("attempt", "a")).alias("held"))
    counted = F.filter("held", lambda h: h["attempt"] <= F.col("stop"))
    total = lambda c: F.aggregate(counted, F.lit(0).cast("bigint"), lambda s, h: s + h["a"][c])
    return tasks.select("task", F.exists(counted, lambda h: h["a"]["valid"]).alias("success"), F.size(counted).alias("attempts"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), (F.size(counted) == F.col("stop")).alias("complete"))
