"""Queries that follow an order over whole tables: contents at a time, keys in use, attempts as they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import status
from ..operators import ordered
from ..sources import scratch
from ..streaming import repairs
from .queries import SQL, query, t

#: Half of the lines and orders are of one file.
HOT = "CASE WHEN {0} % 2 = 0 THEN 0 ELSE {1} END"


@query(f"""WITH v AS (SELECT {HOT.format('o_orderkey', 'o_custkey % 500')} AS file, o_orderdate AS since, max_by(o_orderpriority || ' of ' || o_orderkey, o_orderkey) AS content FROM orders GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, content, len(string_split(content, ' ')) AS words FROM (SELECT *, {HOT.format('l_orderkey', 'l_partkey % 500')} AS file FROM lineitem) l ASOF LEFT JOIN v ON l.file = v.file AND l.l_shipdate >= v.since""")
def content_at_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file held when a line was shipped: its last content up to then, and how many words that has."""
    hot = lambda n, k: F.when(F.col(n) % 2 == 0, 0).otherwise(F.col(k) % 500).alias("file")
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", hot("l_orderkey", "l_partkey"), "l_shipdate")
    versions = t(spark, sf_dir, "orders").select(hot("o_orderkey", "o_custkey"), "o_orderdate", "o_orderkey", F.concat("o_orderpriority", F.lit(" of "), F.col("o_orderkey").cast("string")).alias("content"))
    found = ordered.as_of(lines, versions, ["file"], "l_shipdate", "o_orderdate", ["content"], ["o_orderkey"])
    return found.select("l_orderkey", "l_linenumber", "content", F.size(F.split("content", " ")).cast("bigint").alias("words"))


KEYS = 3
#: What follows each state, 4 * key + failures in a row, on a success, on an error that asks for another key, on another one.
CALLS = [
    [4 * (s // 4) for s in range(4 * KEYS)],
    [4 * ((s // 4 + 1) % KEYS) + (s % 4 + 1) % KEYS for s in range(4 * KEYS)],
    [4 * (s // 4) for s in range(4 * KEYS)],
]


def said(kind: Column, k: Column) -> Column:
    """The message of an event: a third of the errors are of a quota, a third of the service itself."""
    return F.when(kind == "error", F.when(k % 3 == 0, "429 Quota exceeded").when(k % 3 == 1, "500 Internal Error").otherwise("400 bad request"))


@query(f"""WITH e AS (SELECT event_id, ts, event_type, event_type = 'error' AND (props::JSON ->> 'k')::BIGINT % 3 < 2 AS turned FROM events),
n AS (SELECT *, coalesce(sum(turned::INT) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turns, coalesce(sum((NOT turned)::INT) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e)
SELECT event_id, (turns % {KEYS})::INTEGER AS key, ((row_number() OVER (PARTITION BY run ORDER BY ts, event_id) - 1) % {KEYS})::INTEGER AS failures FROM n""")
def key_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key that each call of all events uses, and how many keys have failed one after the other before it.

    An error of a quota or of the service turns to the next key; after as many in a row as there are keys the count starts
    again, as it does after any other outcome.
    """
    rows = t(spark, sf_dir, "events").select("event_id", "ts", said(F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")).alias("message"))
    symbol = F.when(F.col("message").isNull(), 0).when(status.rotate_key(F.col("message")), 1).otherwise(2)
    found = ordered.states(rows, [F.asc("ts"), F.asc("event_id")], symbol, CALLS)
    return found.select("event_id", F.floor(F.col("state") / 4).cast("int").alias("key"), (F.col("state") % 4).alias("failures"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events make a task's attempts; a purchase or a signup is a valid one."""
    n = F.col("event_id")
    return t(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), F.floor(n / 4).cast("string")).alias("task"), (n % 4 + 1).cast("int").alias("attempt"), F.col("ts").cast("timestamp").alias("time"), F.col("event_type").isin("purchase", "signup").alias("valid"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"), F.floor("value").cast("bigint").alias("output_tokens"),
    )


TRIED = "SELECT 't' || event_id // 4 AS task, event_id % 4 + 1 AS attempt, event_type IN ('purchase', 'signup') AS valid, (props::JSON ->> 'k')::BIGINT AS i, floor(value)::BIGINT AS o FROM events WHERE event_id % 4 < 3"


@query(f"""SELECT task, bool_or(valid) AS success, count(*)::INTEGER AS attempts, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, count(*) = min(stop) AS complete
FROM (SELECT *, coalesce(min(attempt) FILTER (valid) OVER (PARTITION BY task), 3) AS stop FROM ({TRIED})) WHERE attempt <= stop GROUP BY task""")
def repairs_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of each task of a table of attempts: up to the first valid one, or to the third."""
    return repairs.repaired_at_once(_attempts(spark, sf_dir))


@query(SQL["repairs_at_once"].replace("GROUP BY task", "GROUP BY task HAVING count(*) = min(stop)"))
def repairs_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of all events, which come out of order in several micro-batches: tasks that are complete.

    The stream is stopped halfway and started again from its checkpoint.
    """
    folder = scratch.folder(spark, "repairs")
    rows = _attempts(spark, sf_dir)
    half = F.pmod(F.xxhash64("task", "attempt"), F.lit(2))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, repairs.ROCKS)
    for k in (0, 1):
        rows.filter(half == k).repartition(2, "attempt", "task").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        found = repairs.repaired(stream, late="90 days", wait="90 days")
        run = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/at").option("path", f"{folder}/out").trigger(availableNow=True).start()
        run.awaitTermination()
    spark.conf.set(store, before)
    return spark.read.schema(repairs.OUT).parquet(f"{folder}/out")
