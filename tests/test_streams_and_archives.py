"""Repairs over a stream against a batch, closed tasks, restarts; archives read by ranges of their directories."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from patchlens.sources import archives
from patchlens.streaming import repairs

KIND = "task string, attempt int, time timestamp, valid boolean, input_tokens bigint, output_tokens bigint"


def streamed(spark, folder, batches, **more):
    """The rows of a stream whose batches are files, each a run of its own from the same checkpoint."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", repairs.ROCKS)
    try:
        for rows in batches:
            spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            found = repairs.repaired(spark.readStream.schema(KIND).parquet(f"{folder}/in"), **more)
            found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/at").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return sorted(map(tuple, spark.read.schema(repairs.OUT).parquet(f"{folder}/out").collect()))


def test_stream_equals_batch_and_closes_what_waits(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = random.Random(1)
    day = datetime(2024, 1, 1)
    rows = [(f"t{i}", a, day + timedelta(minutes=rng.randrange(50)), rng.random() < 0.3, rng.randrange(9), rng.randrange(9)) for i in range(12) for a in (1, 2, 3, 4) if rng.random() < 0.85]
    rows += rows[:5] + [(None, 1, day, True, 1, 1), ("odd", None, day, True, 1, 1), ("none", 1, day, None, None, None)]
    want = sorted(map(tuple, repairs.repaired_at_once(spark.createDataFrame(rows, KIND)).collect()))
    rng.shuffle(rows)
    end = [("end", 9, day + timedelta(days=9), False, 0, 0)]
    got = streamed(spark, str(tmp_path), [rows[:20], rows[20:], end, [("end", 9, day + timedelta(days=10), False, 0, 0)]], late="2 hours", wait="2 hours")
    assert got == want
    assert any(not r[-1] for r in want) and any(r[1] for r in want)


def test_tasks_that_share_state_are_apart(spark, tmp_path):
    """one key of the state holds many tasks; each is decided, repeated, passed over and closed at its own time."""
    from datetime import datetime, timedelta

    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    a = [("x", 1, at(1), False, 1, 1), ("y", 1, at(1), True, 2, 2), ("z", 1, at(0), False, 3, 3), ("x", 3, at(2), True, 4, 4)]
    b = [("x", 2, at(2), False, 5, 5), ("y", 1, at(0), True, 9, 9), ("z", 1, at(1), False, 9, 9)]
    end = [[("e", 9, at(100 * k), False, 0, 0)] for k in (1, 2)]
    got = streamed(spark, str(tmp_path), [a, b, *end], late="5 hours", wait="5 hours", buckets=1)
    assert got == [("x", True, 3, 10, 10, True), ("y", True, 1, 2, 2, True), ("z", False, 1, 3, 3, False)]


def test_decided():
    a = lambda valid, n=1: (0, valid, n, 2 * n)
    assert repairs.decided({}, 3) == (False, 0, 0, 0, False)
    assert repairs.decided({2: a(True)}, 3) == (True, 1, 1, 2, False)
    assert repairs.decided({1: a(False), 2: a(True, 5), 3: a(True, 7)}, 3) == (True, 2, 6, 12, True)
    assert repairs.decided({1: a(False), 2: a(False), 3: a(False)}, 3) == (False, 3, 3, 6, True)


def test_archive_of_many_members(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(3000):
            z.writestr(f"d/m{i}.json", f'{{"id": {i}}}' * (i % 7), zipfile.ZIP_STORED if i % 2 else zipfile.ZIP_DEFLATED)
        z.writestr("d/", "")
    data = bytearray(path.read_bytes())
    with zipfile.ZipFile(path) as z:
        info = z.getinfo("d/m1201.json")
    data[info.header_offset + 30 + len("d/m1201.json") + 3] ^= 255
    path.write_bytes(bytes(data))
    spark.dataSource.register(archives.Archives)
    df = spark.read.format("members").option("path", str(path)).option("members", 250).load()
    assert df.rdd.getNumPartitions() == 13
    rows = {r.name: r for r in df.collect()}
    assert len(rows) == 3000 and [n for n, r in rows.items() if r.error] == ["d/m1201.json"]
    assert rows["d/m10.json"].content == b'{"id": 10}' * 3 and rows["d/m7.json"].content == b""


@pytest.mark.parametrize("content", [b"", b"PK", b"PK\5\6" + bytes(18), b"PK\5\6" + bytes(8) + b"\xff" * 8 + bytes(2), b"x" * 1000])
def test_odd_archives(spark, tmp_path, content):
    (tmp_path / "a.zip").write_bytes(content)
    spark.dataSource.register(archives.Archives)
    rows = spark.read.format("members").option("path", str(tmp_path)).load().collect()
    assert not rows if content == b"PK\5\6" + bytes(18) else (len(rows) == 1 and rows[0].error and rows[0].name is None)


def test_archives_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    """a writer remembers the members of one archive, not of its whole task."""
    monkeypatch.setattr(archives, "WRITTEN", 30)
    writer = archives.Writer({"path": str(tmp_path / "a")}, False)
    said = writer.write(iter([{"name": f"m{i}", "content": b"x" * i} for i in range(100)]))
    assert len(said.paths) == 4
    writer.commit([said, archives.Written([]), None])
    spark.dataSource.register(archives.Archives)
    rows = spark.read.format("members").option("path", str(tmp_path / "a")).load().collect()
    assert len(list((tmp_path / "a").rglob("*.zip"))) == 4 and {r.name: r.content for r in rows} == {f"m{i}": b"x" * i for i in range(100)}


def test_a_failed_job_leaves_no_archive(spark, tmp_path):
    spark.dataSource.register(archives.Archives)
    rows = spark.range(100).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("name"), F.lit(b"x").alias("content"))
    rows.repartition(4).write.format("members").mode("append").save(str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("*.zip"))) == 4
    with pytest.raises(Exception, match="lost"):
        rows.select("name", F.when(F.col("name") == "m50", F.raise_error("lost").cast("binary")).otherwise(F.col("content")).alias("content")).repartition(4).write.format("members").mode("append").save(str(tmp_path / "a"))
    assert len(list((tmp_path / "a").rglob("*.zip"))) == 4
    rows.limit(3).write.format("members").mode("overwrite").save(str(tmp_path / "a"))
    assert spark.read.format("members").option("path", str(tmp_path / "a")).load().count() == 3
