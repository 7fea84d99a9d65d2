"""Operations along an order against sequential versions, with ranges that cut hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from patchlens.operators import ordered


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_ranks(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, d int").repartition(5)
    found = ordered.ranked(df, F.col("d").asc_nulls_first(), F.asc("i"), parts=parts)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert sorted((r["rank"], r.i) for r in found.collect()) == [(n, r[0]) for n, r in enumerate(want, 1)]
    assert "Python" not in found._jdf.queryExecution().toString() and "ScanExistingRDD" not in found._jdf.queryExecution().toString()
    assert ordered.ranked(df.filter("false"), F.asc("i")).count() == 0


def sequential(requests, versions):
    """Of each request the last version, by all of its columns."""
    out = []
    for i, key, at in requests:
        ready = [v for v in versions if key is not None and at is not None and v[0] == key and v[1] is not None and v[1] <= at]
        out.append((i, max(ready, key=lambda v: (v[1], v[2]))[2] if ready else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("parts", "keys"), [(1, 4), (9, 1), (9, 4), (60, 2), (60, 300)])
def test_as_of(spark, parts, keys):
    rng = random.Random(parts + keys)
    pick = lambda: None if rng.random() < 0.05 else "k%d" % (0 if rng.random() < 0.5 else rng.randrange(keys))
    requests = [(i, pick(), None if rng.random() < 0.05 else rng.randrange(200)) for i in range(400)] + [(1000, "k0", 100)] * 30
    versions = [(pick(), rng.randrange(200), rng.randrange(50)) for _ in range(60)] + [(None, None, 1), ("k0", 50, 7), ("k0", 50, 7)]
    a = spark.createDataFrame(requests, "i int, key string, at int")
    b = spark.createDataFrame(versions, "key string, since int, held int")
    found = ordered.as_of(a.repartition(3), b.repartition(2), ["key"], "at", "since", ["held"], parts=parts)
    assert found.columns == ["i", "key", "at", "held"]
    assert sorted(((r.i, r.held) for r in found.collect()), key=repr) == sequential(requests, versions)
    assert ordered.as_of(a.filter("false"), b, ["key"], "at", "since", ["held"]).count() == 0
    assert ordered.as_of(a, b.filter("false"), ["key"], "at", "since", ["held"]).filter("held IS NOT NULL").count() == 0


def test_a_hot_key_spreads(spark):
    a = spark.range(20_000).select(F.col("id").alias("i"), F.lit("hot").alias("key"), (F.col("id") % 1000).cast("int").alias("at"))
    b = spark.createDataFrame([("hot", 3, "x"), ("hot", 700, "y")], "key string, since int, held string")
    found = ordered.as_of(a, b, ["key"], "at", "since", ["held"], parts=10)
    counts = {r.held: r["count"] for r in found.groupBy("held").count().collect()}
    assert counts == {None: 3 * 20, "x": 697 * 20, "y": 300 * 20}
    sizes = ordered.dealt(a, 10, "key", "at").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2 * 2000


@pytest.mark.parametrize("parts", [1, 6, 50])
def test_states_of_a_machine(spark, parts):
    rng = random.Random(parts)
    machine = [[rng.randrange(7) for _ in range(7)] for _ in range(4)]
    rows = [(i, rng.choice([None, 0, 1, 2, 3])) for i in range(700)]
    df = spark.createDataFrame(rows, "i int, e int").repartition(4)
    found = {r.i: r.state for r in ordered.states(df, [F.asc("i")], F.col("e"), machine, start=5, parts=parts).collect()}
    state = 5
    for i, e in rows:
        assert found[i] == state
        state = state if e is None else machine[e][state]
    assert ordered.states(df.filter("false"), [F.asc("i")], F.col("e"), machine).count() == 0
    with pytest.raises(ValueError, match="machine"):
        ordered.states(df, [F.asc("i")], F.col("e"), [[0, 9]])
