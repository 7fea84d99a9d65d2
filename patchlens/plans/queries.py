"""The operators applied to the driver's tables: every query with the SQL that must give the same rows.

Tables stand in for reports: lineitem and orders for attempts (order = patch, part = file, supplier = function; F is a
success, O a failure), events for failure logs (user = vulnerability, day = report, a number in props = reason),
documents for texts, pages for addresses. Texts that the tables lack, such as diffs, are built from their columns on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, diff, status, text, url
from ..operators import aggregates as agg
from ..operators import filters, joins, ordered, reshape

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch between the JVM and a Python worker, for queries that send whole texts.
BATCH_ROWS = 500


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose whole texts go to Python: a session's batches get a bound, if they have no tighter one.

    Plans read this setting when they run, so it stays; operators leave the session as it is.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting, "10000")) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    return t(spark, sf_dir, name)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


EDGES = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey"""
MATRIX = f"""SELECT sr.r_name AS from_region, cr.r_name AS to_region, count(*) FILTER (o_orderstatus = 'F') AS successes,
count(*) FILTER (o_orderstatus = 'O') AS failures, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS errors, count(*) AS total_attempts,
round(CAST(100 AS DOUBLE) * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) AS success_rate {EDGES} GROUP BY 1, 2"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_region, to_region, status) of each line: both regions are looked up by the small sides first."""
    nation = t(spark, sf_dir, "nation").join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    supplier = t(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("from_region"))
    customer = t(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("to_region"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("from_region", "to_region", "o_orderstatus")


@query(MATRIX)
def success_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.success_matrix(_edges(spark, sf_dir), ["from_region", "to_region"], "o_orderstatus", "F", "O")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("SELECT from_region, " + ", ".join(f"""coalesce(CAST(max(success_rate) FILTER (to_region = '{r}') AS VARCHAR), '-') AS "{r}" """ for r in REGIONS) + f"FROM ({MATRIX}) GROUP BY 1")
def success_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.matrix(success_matrix(spark, sf_dir), "from_region", "to_region", "success_rate", REGIONS)


@query(f"SELECT count(*) AS edges, count(DISTINCT from_region) AS sources, count(DISTINCT to_region) AS targets FROM ({MATRIX})")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.edge_counts(success_matrix(spark, sf_dir), "from_region", "to_region")


@query("""SELECT src, tgt, count(*) AS n, count(status) AS known FROM (
SELECT l_shipmode_src AS src, tgt, status FROM (SELECT l_returnflag AS l_shipmode_src, CASE WHEN l_linenumber < 6 THEN l_linestatus END AS tgt, CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS status FROM lineitem) WHERE tgt IS NOT NULL AND status IS NOT NULL
UNION ALL SELECT o_orderpriority, tgt, status FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS tgt, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS status FROM orders) WHERE tgt IS NOT NULL AND o_orderpriority IS NOT NULL) GROUP BY 1, 2""")
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("src"), F.when(F.col("l_linenumber") < 6, F.col("l_linestatus")).alias("tgt"), F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("status"))
    cross = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("src"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("tgt"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    return reshape.edges(main, cross).groupBy("src", "tgt").agg(F.count("*").alias("n"), F.count("status").alias("known"))


WORDS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'))::BIGINT"


@query(f"SELECT doc_id, coalesce({WORDS.format('text')}, 0) AS word_based, coalesce(length(text) // 4, 0)::BIGINT AS char_based, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::BIGINT AS spaced FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.words_and_chars(F.col("text")).alias("t"), text.whitespace_tokens(F.col("text")).alias("spaced")).select("doc_id", "t.*", "spaced")


ROLLUP = f"SELECT lang AS section, coalesce(sum({WORDS.format('text')}), 0)::BIGINT AS word_based, coalesce(sum(length(text) // 4), 0)::BIGINT AS char_based FROM documents GROUP BY 1"


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.token_rollup(t(spark, sf_dir, "documents").select(F.col("lang").alias("section"), "text"), "section", text.words_and_chars(F.col("text")))


@query(ROLLUP)
def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir)


@query(f"SELECT section, round(word_based::DOUBLE / (SELECT count(DISTINCT source) FROM documents), 2) AS word_based, round(char_based::DOUBLE / (SELECT count(DISTINCT source) FROM documents), 2) AS char_based FROM ({ROLLUP})")
def token_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("_n"))
    return agg.token_average(_rolled(spark, sf_dir).crossJoin(F.broadcast(n)), F.col("_n")).drop("_n")


URL = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', {})"


@query(f"""SELECT page_id, {URL.format(1)} AS host, {URL.format(2)} AS path, regexp_extract({URL.format(2)}, '[^/]*$') AS base_name,
regexp_extract(regexp_extract({URL.format(2)}, '[^/]*$'), '.(\\.[^.]*)$', 1) AS suffix FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", url.host(u).alias("host"), url.path(u).alias("path"), text.base_name(url.path(u)).alias("base_name"), text.suffix(url.path(u)).alias("suffix"))


MADE_URLS = f"""SELECT page_id, CASE page_id % 4
WHEN 0 THEN 'https://{url.TREE_HOST}/platform/frameworks/m' || page_id || '/+/' || md5(url) || left(md5(url), 8)
WHEN 1 THEN 'https://{url.FORGE_HOST}/clo/la/kernel/m' || page_id || '/-/commit/' || md5(url) || left(md5(url), 8)
WHEN 2 THEN 'https://{url.TREE_HOST}/kernel/common/+/' || md5(url) || left(md5(url), 8) || '^!'
ELSE url END AS u FROM pages"""


def _made_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, n = F.col("url"), F.col("page_id")
    sha = F.concat(F.md5(u.cast("binary")), F.left(F.md5(u.cast("binary")), F.lit(8)))
    made = (
        F.when(n % 4 == 0, F.concat(F.lit(f"https://{url.TREE_HOST}/platform/frameworks/m"), n.cast("string"), F.lit("/+/"), sha))
        .when(n % 4 == 1, F.concat(F.lit(f"https://{url.FORGE_HOST}/clo/la/kernel/m"), n.cast("string"), F.lit("/-/commit/"), sha))
        .when(n % 4 == 2, F.concat(F.lit(f"https://{url.TREE_HOST}/kernel/common/+/"), sha, F.lit("^!")))
        .otherwise(u)
    )
    return t(spark, sf_dir, "pages").select("page_id", made.alias("u"))


@query(f"""SELECT page_id, nullif(regexp_extract(u, '([a-fA-F0-9]{{40}})', 1), '') AS commit_hash,
CASE WHEN page_id % 4 = 0 THEN 'frameworks/m' || page_id WHEN page_id % 4 = 1 THEN 'kernel/m' || page_id WHEN page_id % 4 = 2 THEN 'kernel/common' END AS project,
CASE WHEN page_id % 4 IN (0, 2) THEN u || '^!/?format=TEXT' WHEN page_id % 4 = 1 THEN u || '.diff' END AS download,
CASE WHEN page_id % 4 IN (0, 2) THEN md5(url) || left(md5(url), 8) WHEN page_id % 4 = 1 THEN '/clo/la/kernel/m' || page_id || '/-/commit/' || md5(url) || left(md5(url), 8) ELSE rtrim(string_split({URL.format(2)}, '/+/')[-1], '^!') END AS fix_commit
FROM ({MADE_URLS}) JOIN pages USING (page_id)""")
def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No project and no download at unknown hosts."""
    u = F.col("u")
    return _made_urls(spark, sf_dir).select("page_id", url.commit_hash(u).alias("commit_hash"), url.project(u).alias("project"), url.download(u).alias("download"), url.fix_commit(u).alias("fix_commit"))


ITEMS = "SELECT l_orderkey, l_partkey, l_suppkey, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2, 3"


@query(f"""SELECT l_orderkey, min(o)::BIGINT AS first_seen, string_agg(l_partkey || ':' || items, ';' ORDER BY o, l_partkey) AS files FROM (
SELECT l_orderkey, l_partkey, min(o) AS o, string_agg(l_suppkey, ',' ORDER BY o, l_suppkey) AS items FROM ({ITEMS}) GROUP BY 1, 2) GROUP BY 1""")
def dedup_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reshape.regroup(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    files = F.transform("files", lambda f: F.concat(f["file"].cast("string"), F.lit(":"), F.array_join(F.transform(f["items"], lambda x: x.cast("string")), ",")))
    return found.select("l_orderkey", long("first_seen").alias("first_seen"), F.array_join(files, ";").alias("files"))


@query("""SELECT l_partkey, string_agg(l_orderkey, ',' ORDER BY l_shipdate NULLS FIRST, l_orderkey * 10 + l_linenumber) AS patches, count(*) AS n
FROM (SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS l_shipdate FROM lineitem) GROUP BY 1""")
def invert_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_shipdate")).alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    found = reshape.inverted(rows, "l_partkey", "d", "o", ["l_orderkey"])
    return found.select("l_partkey", F.array_join(F.transform("patches", lambda p: p["l_orderkey"].cast("string")), ",").alias("patches"), long(F.size("patches")).alias("n"))


RUNS = """SELECT l_orderkey, l_linenumber, (l_linenumber % 4 - 1)::INT AS code, CASE l_returnflag WHEN 'R' THEN 'Hunk #1 succeeded at 3 (offset 2 lines).' WHEN 'A' THEN 'Reversed (or previously applied) patch detected!' ELSE CASE WHEN l_linestatus = 'F' THEN 'can''t find file to patch at input line 3' ELSE '1 out of 1 hunk FAILED' END END AS output FROM lineitem"""
DETAIL = """CASE WHEN code = 0 THEN CASE WHEN contains(output, 'offset') THEN 'Applied Successfully: With Offsets' WHEN contains(output, 'Reversed (or previously applied) patch detected') THEN 'Applied Successfully: Already Applied' ELSE 'Applied Successfully: Clean' END
WHEN code = 1 THEN 'Rejected: Failed Hunks' WHEN code > 1 THEN CASE WHEN contains(output, 'can''t find file to patch') THEN 'Skipped: Files Not Found' ELSE 'Rejected: Error Running Patch Command' END
WHEN contains(output, 'FAILED') THEN 'Rejected: Failed Hunks' ELSE 'Unknown Status' END"""
STATUSES = f"SELECT *, CASE WHEN contains(detailed_status, 'Rejected') OR contains(detailed_status, 'Skipped') THEN 'Rejected' ELSE 'Applied Successfully' END AS status FROM (SELECT *, {DETAIL} AS detailed_status FROM ({RUNS}))"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    said = (
        F.when(flag == "R", "Hunk #1 succeeded at 3 (offset 2 lines).").when(flag == "A", f"{status.REVERSED}!")
        .when(line == "F", f"{status.NOT_FOUND} at input line 3").otherwise("1 out of 1 hunk FAILED")
    )
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 4 - 1).alias("code"), said.alias("output"))
    rows = rows.withColumn("detailed_status", status.detailed(F.col("code"), F.col("output")))
    return rows.withColumn("status", status.overall(F.col("detailed_status")))


@query(f"SELECT l_orderkey, l_linenumber, detailed_status, status FROM ({STATUSES})")
def status_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("l_orderkey", "l_linenumber", "detailed_status", "status")


@query(f"SELECT detailed_status, count(*) AS n, count(*) FILTER (status = 'Rejected') AS failed FROM ({STATUSES}) GROUP BY 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy("detailed_status").agg(F.count("*").alias("n"), agg.count_if(F.col("status") == status.REJECTED).alias("failed"))


@query(f"SELECT l_orderkey, l_linenumber, detailed_status FROM ({STATUSES}) WHERE status = 'Rejected' OR contains(detailed_status, 'Failed Hunks')")
def needs_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).filter(status.needs_repair(F.col("status"), F.col("detailed_status"))).select("l_orderkey", "l_linenumber", "detailed_status")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(project, '') = '' THEN 'Rejected: Missing project path in report' WHEN NOT directory THEN 'Rejected: Project directory not found' WHEN NOT patch THEN 'Rejected: Missing Patch File' END AS reason
FROM (SELECT CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 <> 1 THEN p_brand END AS project, p_size % 3 <> 0 AS directory, p_size % 2 = 0 AS patch FROM part)) GROUP BY 1""")
def precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    rows = t(spark, sf_dir, "part").select(F.when(n % 5 == 0, "").when(n % 5 != 1, F.col("p_brand")).alias("project"), (n % 3 != 0).alias("directory"), (n % 2 == 0).alias("patch"))
    return rows.select(status.precheck(F.col("project"), F.col("directory"), F.col("patch")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


CLASSES = """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS successes, count(*) FILTER (o_orderstatus = 'O') AS failures, count(*) AS total FROM orders GROUP BY 1"""
CLASSED = f"SELECT *, CASE WHEN failures = total THEN 'all_failures' WHEN successes > 0 AND failures > 0 THEN 'partial_failures' ELSE 'all_successful' END AS class FROM ({CLASSES})"


@query(CLASSED)
def tristate_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.classified(t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "F", "O")


@query(f"SELECT class, count(*) AS n, sum(total)::BIGINT AS tested, sum(successes)::BIGINT AS successes, sum(failures)::BIGINT AS failures, 0::BIGINT AS unique_versions FROM ({CLASSED}) GROUP BY 1")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tristate_class(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.sum("total").alias("tested"), F.sum("successes").alias("successes"), F.sum("failures").alias("failures"))
    return own.crossJoin(F.broadcast(agg.unique_versions(t(spark, sf_dir, "orders"), "o_orderpriority")))


@query("SELECT o_orderpriority AS version, count(*) AS tested, count(*) FILTER (o_orderstatus = 'O') AS failures FROM orders GROUP BY 1")
def per_version_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("version")).agg(F.count("*").alias("tested"), agg.count_if(F.col("o_orderstatus") == "O").alias("failures"))


FAILED = "SELECT user_id, CAST(ts AS DATE)::VARCHAR AS report, coalesce((props::JSON ->> 'k')::BIGINT, -1) AS reason, event_id, value FROM events WHERE event_type = 'error'"


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").filter("event_type = 'error'")
    reason = F.coalesce(long(F.get_json_object("props", "$.k")), F.lit(-1))
    return rows.select("user_id", F.col("ts").cast("date").cast("string").alias("report"), reason.alias("reason"), "event_id", "value")


COUNTS = f"SELECT user_id, count(DISTINCT report) AS appears_in_num_reports, count(DISTINCT report) AS total_failures_across_all_inputs FROM ({FAILED}) GROUP BY 1"


@query(COUNTS)
def failure_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.by_source(_failed(spark, sf_dir), "user_id", "report")


@query(f"""SELECT user_id, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons, array_to_string(list_sort(list(DISTINCT report)), ',') AS reports, count(*) AS n_rows FROM ({FAILED}) GROUP BY 1""")
def vuln_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.details(_failed(spark, sf_dir), "user_id", ["reason", "report"])
    return found.select("user_id", text.joined_numbers(F.col("reasons")).alias("reasons"), F.array_join("reports", ",").alias("reports"), "n_rows")


@query(f"SELECT reason, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM ({FAILED})), 2) AS percent FROM ({FAILED}) GROUP BY 1")
def reason_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.shares(_failed(spark, sf_dir), "reason")


@query(f"SELECT report, string_agg(reason || ' (' || n || ')', ', ' ORDER BY n DESC, reason) AS reasons FROM (SELECT report, reason, count(*) AS n FROM ({FAILED}) GROUP BY 1, 2) GROUP BY 1")
def file_reason_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _failed(spark, sf_dir).groupBy("report", "reason").agg(F.count("*").alias("n"))
    return counted.groupBy("report").agg(reshape.counted_list("reason", "n").alias("reasons"))


@query(f"SELECT count(*) AS entities, count(*) FILTER (n > 1) AS repeated, coalesce(max(n), 0) AS most, coalesce(round(avg(n), 2), 0) AS mean FROM (SELECT appears_in_num_reports AS n FROM ({COUNTS}))")
def cross_input_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.cross_stats(failure_by_entity(spark, sf_dir), "appears_in_num_reports")


TOP = f"SELECT user_id, appears_in_num_reports AS n, row_number() OVER (ORDER BY appears_in_num_reports DESC, user_id) AS rank FROM ({COUNTS}) ORDER BY rank LIMIT 20"


@query(TOP)
def topk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.top(failure_by_entity(spark, sf_dir).select("user_id", F.col("appears_in_num_reports").alias("n")), 20, F.desc("n"), F.asc("user_id"))


@query(f"SELECT reason, count(*) AS n FROM ({FAILED}) WHERE user_id IN (SELECT user_id FROM ({TOP}) WHERE rank <= 10) GROUP BY 1")
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = topk_entities(spark, sf_dir).filter("rank <= 10").select("user_id")
    return _failed(spark, sf_dir).join(F.broadcast(few), "user_id", "left_semi").groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, source, CASE WHEN source <> 'src1' THEN quality END AS quality, CASE WHEN source <> 'src1' THEN toxic END AS toxic FROM documents LEFT JOIN (
SELECT doc_id, max_by(quality, doc_id) AS quality, max_by(toxic, doc_id) AS toxic FROM labels GROUP BY 1) USING (doc_id)""")
def lookup_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = t(spark, sf_dir, "labels").withColumn("_o", F.col("doc_id"))
    return joins.enrich(t(spark, sf_dir, "documents").select("doc_id", "source"), ref, "doc_id", "_o", ["quality", "toxic"], F.col("source") != "src1")


@query("SELECT count(*) AS forwarded, count(*) FILTER (o_orderkey IS NULL) AS skipped, sum(o_totalprice) FILTER (o_orderkey IS NOT NULL) IS NOT NULL AS any_text FROM (SELECT l_orderkey * (CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 END) AS k FROM lineitem) LEFT JOIN orders ON k = o_orderkey")
def applied_to_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * F.when(F.col("l_linenumber") == 7, -1).otherwise(1)).alias("k"))
    found = rows.join(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("k") == F.col("o_orderkey"), "left")
    return found.agg(F.count("*").alias("forwarded"), agg.count_if(F.col("o_orderkey").isNull()).alias("skipped"), F.sum("o_totalprice").isNotNull().alias("any_text"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.missing(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id").orderBy("doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = t(spark, sf_dir, "labels")
    groups = {"successful": labels.filter("quality = 1 AND toxic = 0"), "failed": labels.filter("quality = 1 AND toxic = 1"), "mismatch": labels.filter("quality = 0")}
    return joins.unfinished(t(spark, sf_dir, "documents").select("doc_id"), groups, "doc_id")


@query("SELECT p_partkey, p_name || '.rej' AS path FROM part WHERE p_size % 3 = 0 AND p_name || '.rej' IN (SELECT DISTINCT p_name || CASE WHEN p_size % 2 = 0 THEN '.rej' ELSE '.orig' END FROM part)")
def reject_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    files = part.select(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".rej").otherwise(".orig")).alias("path")).distinct()
    return joins.rejects(part.filter("p_size % 3 = 0").select("p_partkey", F.col("p_name").alias("file")), files).select("p_partkey", "path")


@query("SELECT l_suppkey, min_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS l_orderkey FROM lineitem GROUP BY 1")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return joins.first_match(rows, "l_suppkey", "l_orderkey", "o")


@query("""SELECT source, count(*) AS n, count(quality) AS rated FROM (SELECT 'customer' AS source, NULL AS quality FROM customer UNION ALL SELECT 'labels', quality FROM labels UNION ALL SELECT 'supplier', NULL FROM supplier) GROUP BY 1""")
def union_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [t(spark, sf_dir, n).select(F.lit(n).alias("source"), *more) for n, more in (("customer", ["c_custkey"]), ("labels", ["quality"]), ("supplier", []))]
    return joins.all_rows(*parts).groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("rated"))


VERSIONS = "SELECT v, regexp_extract(v, '^(\\d+)', 1)::INT * 2 + CASE WHEN v LIKE '%L' THEN 1 ELSE 0 END AS o FROM (SELECT DISTINCT (11 + s_suppkey % 4) || CASE WHEN s_suppkey % 3 = 0 THEN 'L' ELSE '' END AS v FROM supplier)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return t(spark, sf_dir, "supplier").select(F.concat((k % 4 + 11).cast("string"), F.when(k % 3 == 0, "L").otherwise("")).alias("v")).distinct().withColumn("ver", text.version(F.col("v")))


@query(f"SELECT a.v AS source, b.v AS target FROM ({VERSIONS}) a JOIN ({VERSIONS}) b ON a.o > b.o")
def version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.ordered_pairs(_versions(spark, sf_dir), "ver").select(F.col("a.v").alias("source"), F.col("b.v").alias("target"))


@query(f"SELECT v, row_number() OVER (ORDER BY o DESC) AS rank FROM ({VERSIONS})")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.ranked(_versions(spark, sf_dir), F.desc("ver")).select("v", "rank")


@query("""SELECT n_regionkey, bool_and(n = expected) AS matches, count(*) FILTER (n <> expected) AS mismatches FROM (
SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) JOIN (
SELECT n_regionkey, count(*) AS expected FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) USING (n_regionkey) GROUP BY 1""")
def cardinality_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    left = t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    right = t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joins.same_counts(left, right, "n_regionkey", "c_mktsegment").select("n_regionkey", "matches", "mismatches")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT role, turn, CASE WHEN conv_id % 3 > 0 THEN conv_id % 50 END FROM conversations)")
def distinct_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    rows = t(spark, sf_dir, "conversations").select("role", "turn", F.when(c % 3 > 0, c % 50).alias("c"))
    return agg.distinct_keys(rows, ["role", "turn", "c"])


PAIRS = """SELECT event_type, bucket, count(DISTINCT user_id) AS conflicts, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS successful FROM (SELECT event_type, event_id % 5 AS bucket, user_id, value FROM events) GROUP BY 1, 2"""
RATED = f"SELECT *, round(CAST(100 AS DOUBLE) * successful / conflicts, 2) AS success_rate FROM ({PAIRS})"


@query(RATED)
def pair_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 5).alias("bucket"), "user_id", "value")
    return agg.rate_by_pair(rows, ["event_type", "bucket"], ["user_id"], F.col("value") > 50)


@query(f"SELECT event_type, bucket, success_rate, row_number() OVER (ORDER BY success_rate, event_type, bucket) AS rank FROM ({RATED}) ORDER BY rank LIMIT 3")
def worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.top(pair_success_rate(spark, sf_dir).select("event_type", "bucket", "success_rate"), 3, F.asc("success_rate"), F.asc("event_type"), F.asc("bucket"))


@query("""SELECT left(message, 5) || '...' AS message, n FROM (SELECT message, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'No LLM output' WHEN event_type = 'click' THEN NULL ELSE event_type END AS message FROM events)
WHERE message IS NOT NULL GROUP BY 1 ORDER BY n DESC, message LIMIT 3) WHERE trim(message) <> '' AND NOT regexp_matches(lower(message), 'skip|no llm')""")
def value_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = t(spark, sf_dir, "events").select(F.when(kind == "view", "No LLM output").when(kind != "click", kind).alias("message"))
    return agg.top_errors(rows, "message").select(text.shortened(F.col("message"), 5).alias("message"), "n")


@query("""SELECT event_id, CASE WHEN f IS NULL THEN false WHEN lower(f) = 'true' THEN true WHEN lower(f) = 'false' THEN false ELSE true END AS flag, coalesce(TRY_CAST(x AS DOUBLE), 0) AS number, coalesce(f, 'nan') AS label, coalesce(f, 'nan') || '_' || coalesce(x, 'nan') AS key
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN 'yes' END AS f, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 'x' END AS x FROM events)""")
def coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = t(spark, sf_dir, "events").select(n, F.when(n % 4 == 0, "True").when(n % 4 == 1, "false").when(n % 4 == 2, "yes").alias("f"), F.when(n % 3 == 0, n.cast("string")).when(n % 3 == 1, "x").alias("x"))
    f, x = F.col("f"), F.col("x")
    return rows.select("event_id", filters.flag(f).alias("flag"), filters.number(x).alias("number"), filters.label(f).alias("label"), text.composite_key(f, x).alias("key"))


@query("SELECT event_type, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM (SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100 OFFSET 50) GROUP BY 1")
def slice_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = filters.page(t(spark, sf_dir, "events").select("event_id", "event_type"), 50, 100, F.asc("event_id"))
    return few.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("""SELECT o_orderkey, o_orderdate AS naive, o_orderdate - INTERVAL 2 HOUR AS utc, coalesce(epoch(o_orderdate)::BIGINT, 0) AS seconds, o_orderdate IS NULL AS none FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS o_orderdate FROM orders)""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "N/A").otherwise(F.concat(d, F.lit("+02:00"))).alias("d"))
    naive = dates.naive(F.col("d"))
    return rows.select("o_orderkey", naive.alias("naive"), dates.aware(F.col("d")).cast("timestamp_ntz").alias("utc"), dates.epoch(dates.aware(F.concat(F.left("d", F.lit(19)), F.lit("Z")))).alias("seconds"), naive.isNull().alias("none"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END NULLS FIRST, o_orderkey) AS rank FROM orders")
def date_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("o_orderkey") % 10 == 0, "N/A").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", dates.aware(d).alias("d"))
    return ordered.ranked(rows, F.col("d").asc_nulls_first(), F.asc("o_orderkey")).select("o_orderkey", "rank")


@query("SELECT count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
def date_range_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").filter(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")))
    return rows.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""SELECT p_partkey, 'android' || p_size || '-release' AS branch, CASE WHEN p_size % 2 = 0 THEN 'https://android.googlesource.com/platform/' || p_brand END AS repo,
CASE WHEN p_size % 3 = 0 THEN 'upstream' WHEN p_size % 3 = 1 AND p_size <> 15 AND p_size IN (10, 13, 16, 19) THEN 'downstream' END AS role FROM part""")
def role_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    package = F.when(n % 2 == 0, F.concat(F.lit("platform/"), F.col("p_brand"))).otherwise(F.col("p_brand"))
    versions = F.array(F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit("-next"))).when(n % 3 == 1, n.cast("string")).otherwise("15"))
    return t(spark, sf_dir, "part").select("p_partkey", url.branch(n.cast("string")).alias("branch"), url.repository(package).alias("repo"), filters.role(versions, ["10", "13", "15", "16", "19"]).alias("role"))


@query("""SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS numbers FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def nested_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("l_linenumber", F.col("l_returnflag").alias("downstream_version"), F.lit("heavy").alias("content"))
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("failures"))
    slim = filters.without(filters.of_version(rows, "failures", "R", ["l_orderkey"]), "failures", "content")
    return slim.select("l_orderkey", text.joined_numbers(F.transform("failures", lambda f: f["l_linenumber"])).alias("numbers"))


@query("SELECT l_linenumber, l_quantity, l_orderkey FROM lineitem")
def flatten_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("failures"))
    return reshape.with_parents(rows, "failures", ["l_orderkey"])


@query("SELECT DISTINCT 'CVE-' || (2000 + p_size) || '-' || p_size AS cve FROM part WHERE p_size % 2 = 0")
def cve_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    rows = t(spark, sf_dir, "part").select(F.array(F.concat(F.lit("A-"), n), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("CVE-"), (F.col("p_size") + 2000).cast("string"), F.lit("-"), n))).alias("aliases"))
    return filters.alias_ids(rows, "aliases")


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE 'Brand#1%'")
def id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_prefix(t(spark, sf_dir, "part"), "p_brand", "Brand#1")


@query("""SELECT o_orderkey, CASE WHEN l_linenumber IS NULL THEN 0 ELSE l_linenumber END AS attempt_number, coalesce(l_quantity, -1) AS quantity FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'A') ON o_orderkey = l_orderkey""")
def attempt_explode_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = t(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("attempt"), "l_quantity")).alias("attempts"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey").join(tried, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return reshape.attempts(rows, "attempts", ["o_orderkey"]).select("o_orderkey", "attempt_number", F.coalesce("_a.l_quantity", F.lit(-1.0)).alias("quantity"))


NL = "chr(10)"
BREAKS = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
WHOLE = f"""SELECT doc_id, n, 'diff --git a/src/f' || doc_id % 7 || '.c b/src/f' || doc_id % 7 || '.c' || {NL} || '--- a/x' || {NL} || '+++ b/x' || {NL} || '@@ -1,2 +1,' || n + 1 || ' @@' || {NL} || ' keep' || {NL} || '-old' || {NL} || '+' || replace(w, {NL}, {NL} || '+') AS one,
CASE WHEN doc_id % 2 = 0 THEN {NL} || 'diff --git a/lib/g.c b/lib/g.c' || {NL} || '--- a/y' || {NL} || '+++ b/y' || {NL} || '@@ -3 +3,2 @@ f' || {NL} || ' a' || {NL} || '+b' ELSE '' END AS two
FROM (SELECT doc_id, w, length(w) - length(replace(w, {NL}, '')) + 1 AS n FROM (SELECT doc_id, regexp_replace(text, {BREAKS}, {NL}, 'g') AS w FROM documents))"""


def _whole_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit patch of one or two files whose added lines are all of a document's."""
    n = F.col("doc_id")
    name = F.concat(F.lit("src/f"), (n % 7).cast("string"), F.lit(".c"))
    parts = F.split("text", text.LINE_ENDS, -1)
    one = F.concat(F.lit("commit "), n.cast("string"), F.lit("\ndiff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/x\n+++ b/x\n@@ -1,2 +1,"), (F.size(parts) + 1).cast("string"), F.lit(" @@\n keep\n-old\n+"), F.array_join(parts, "\n+"), F.lit("\n"))
    two = F.when(n % 2 == 0, "diff --git a/lib/g.c b/lib/g.c\n--- a/y\n+++ b/y\n@@ -3 +3,2 @@ f\n a\n+b\n").otherwise("")
    return t(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.concat(one, two).alias("d"))


@query(f"""SELECT doc_id, (1 + (doc_id + 1) % 2)::BIGINT AS hunks, (2 + n + CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END)::BIGINT AS total, (n + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END)::BIGINT AS added, (1 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS removed FROM ({WHOLE})""")
def hunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _whole_diffs(spark, sf_dir).select("doc_id", diff.hunk_count(d).alias("hunks"), diff.line_counts(d).alias("c")).select("doc_id", "hunks", "c.*")


@query(f"SELECT doc_id, substr(one, strpos(one, '@@ ')) || two AS hunks FROM ({WHOLE})")
def hunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_diffs(spark, sf_dir).select("doc_id", diff.hunks_only(F.col("d")).alias("hunks"))


@query(f"""SELECT doc_id, (1 + (doc_id + 1) % 2)::BIGINT AS sections, (6 + n)::BIGINT AS lines, 'src/f' || doc_id % 7 || '.c' AS file, CASE WHEN doc_id % 7 = 3 THEN 1 ELSE 0 END::BIGINT AS by_name, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS by_suffix, 1::BIGINT AS by_mention FROM ({WHOLE})""")
def diff_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    found = _whole_diffs(spark, sf_dir).select("doc_id", diff.sections(F.col("d")).alias("s"))
    count = lambda c: long(F.size(c))
    return found.select(
        "doc_id", count(s).alias("sections"), count(s[0]["lines"]).alias("lines"), diff.target(s[0]["header"]).alias("file"), count(diff.kept_by_name(s, F.array(F.lit("src/f3.c")))).alias("by_name"),
        count(diff.kept_by_suffix(s, F.array(F.lit("root/lib/g.c")))).alias("by_suffix"), count(diff.kept_by_mention(s, F.lit("src/f"))).alias("by_mention"),
    )


@query(f"SELECT doc_id, one AS patch, ltrim(two, {NL}) AS other FROM ({WHOLE})")
def patch_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _whole_diffs(spark, sf_dir).select("doc_id", diff.patch_of(d, F.col("name")).alias("patch"), diff.patch_of(d, F.lit("b/lib/g.c")).alias("other"))


@query(f"""SELECT doc_id, 1::BIGINT AS blocks, '<<<<<<< DOWNSTREAM (version 14)' || {NL} || 'ours ' || doc_id || {NL} || '=======' || {NL} || regexp_replace(text, {BREAKS}, {NL}, 'g') || {NL} || '>>>>>>> UPSTREAM PATCH (commit c' || doc_id || ')' AS block FROM documents""")
def conflict_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    made = F.concat(F.lit("int x;\n<<<<<<< HEAD\nours "), n, F.lit("\n=======\n"), F.col("text"), F.lit("\n>>>>>>> theirs\nint y;\n"))
    found = t(spark, sf_dir, "documents").select("doc_id", diff.conflicts(made, F.lit("14"), F.concat(F.lit("c"), n)).alias("c"))
    return found.select("doc_id", long(F.size("c")).alias("blocks"), F.col("c")[0]["merge_conflict"].alias("block"))


@query(f"""SELECT doc_id, '```c' || {NL} || f || {NL} || '```' AS fenced, f AS back, array_to_string(list_transform(list_zip(l, range(1, len(l) + 1)), lambda x: x[2] || ': ' || x[1]), {NL}) AS numbered, f AS decoded
FROM (SELECT doc_id, 'x' || text AS f, string_split(regexp_replace('x' || text, {BREAKS}, {NL}, 'g') || {NL} || 'end', {NL}) AS l FROM documents)""")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("f")
    rows = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x"), F.col("text")).alias("f"))
    return rows.select("doc_id", text.fenced(f, F.lit("c")).alias("fenced"), text.unfenced(F.concat(F.lit("```diff\n"), f, F.lit("\n```"))).alias("back"), text.numbered(F.concat(f, F.lit("\nend\n"))).alias("numbered"), text.decoded(F.base64(F.encode(f, "UTF-8"))).alias("decoded"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'src/p' || l_partkey || '.c' ELSE '' END AS failed, CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END AS total_hunks, CASE WHEN l_returnflag = 'R' THEN '1,4' ELSE '' END AS failed_hunks,
CASE WHEN l_returnflag = 'A' THEN 'src/p' || l_partkey || '.c' ELSE '' END AS missing FROM lineitem""")
def console_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, name = F.col("l_returnflag"), F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".c"))
    said = F.concat(F.lit("checking file other.c\npatching file "), name, F.when(flag == "R", "\nHunk #1 FAILED at 2.\nHunk #4 FAILED at 9.\n2 out of 5 hunks FAILED\n").when(flag == "A", "\ncan't find file to patch at input line 3\n").otherwise("\n"))
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", said.alias("o"), F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name).alias("p"))
    totals = diff.hunk_totals(F.col("o"))
    return rows.select(
        "l_orderkey", "l_linenumber", F.array_join(diff.failed_files(F.col("o")), ",").alias("failed"), totals["total_hunks"].alias("total_hunks"),
        text.joined_numbers(totals["failed_hunks"]).alias("failed_hunks"), F.array_join(diff.missing_files(F.col("p"), F.col("o"), F.array()), ",").alias("missing"),
    )


@query("""SELECT *, input_tokens + output_tokens AS total_tokens, applied_directly + fixed AS successful, forwarded - fixed AS failed, printf('%.2f%%', round(CAST(100 AS DOUBLE) * (applied_directly + fixed) / for_application, 2)) AS application_rate,
printf('%.2f%%', round(CAST(100 AS DOUBLE) * (applied_directly + fixed) / total_patches, 2)) AS pipeline_rate FROM
(SELECT count(*) AS total_patches, count(*) FILTER (o_orderstatus = 'P') AS fetch_failures, count(*) FILTER (o_orderstatus <> 'P') AS for_application, count(*) FILTER (o_orderstatus = 'F') AS applied_directly, count(*) FILTER (o_orderstatus = 'O') AS forwarded FROM orders),
(SELECT count(*) FILTER (l_returnflag = 'A') AS fixed, count(*) FILTER (l_returnflag <> 'A') AS fix_rejected, sum(l_linenumber)::BIGINT AS input_tokens, sum(2 * l_linenumber)::BIGINT AS output_tokens FROM lineitem WHERE l_linenumber % 4 <> 3), (SELECT count(*) AS generation_failures FROM lineitem WHERE l_linenumber % 4 = 3)""")
def pipeline_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    s = F.col("o_orderstatus")
    applied = orders.filter(s != "P").select(F.when(s == "F", status.CLEAN).otherwise(status.HUNKS).alias("detailed_status"), (s == "O").alias("forwarded"))
    repaired = items.filter("l_linenumber % 4 <> 3").select(F.when(F.col("l_returnflag") == "A", status.CLEAN).when(F.col("l_returnflag") == "R", status.HUNKS).alias("detailed_status"), F.when(F.col("l_returnflag") == "A", status.APPLIED).otherwise(status.REJECTED).alias("status"), long("l_linenumber").alias("input_tokens"), long(F.col("l_linenumber") * 2).alias("output_tokens"))
    return agg.funnel(orders.select((s == "P").alias("failed")), applied, repaired, items.filter("l_linenumber % 4 = 3"))


@query("""SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, 'Unknown Error') AS error_type, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1""")
def failure_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the counts alone: failures_of_error has what failed, a row each, and error_lists the list that a report carries
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("e"))
    return rows.groupBy(F.coalesce("e", F.lit("Unknown Error")).alias("error_type")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, 'Unknown Error') AS error_type, o_orderkey FROM orders""")
def failures_of_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed with each error that failure_by_error counts, a row each: no list grows with an error."""
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("e"))
    return rows.select(F.coalesce("e", F.lit("Unknown Error")).alias("error_type"), "o_orderkey")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'format' WHEN 1 THEN 'hunks' WHEN 2 THEN 'apply' WHEN 3 THEN 'format,hunks' ELSE 'none' END AS feedback, event_id % 5 = 0 AS rotate FROM events""")
def attempt_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    wrong = F.when((n % 5).isin(0, 3), "bad header").otherwise(status.FORMAT_FINE)
    failed = F.when((n % 5).isin(1, 3), "Hunk #1 FAILED").when(n % 5 == 2, "no such file").otherwise(status.APPLY_FINE)
    return t(spark, sf_dir, "events").select("event_id", F.array_join(status.feedback(wrong, failed), ",").alias("feedback"), status.rotate_key(F.when(n % 5 == 0, "Quota exceeded").otherwise("other")).alias("rotate"))


@query("SELECT event_type, bucket, kind, n FROM (SELECT event_type, NULL::BIGINT AS bucket, 1::BIGINT AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT event_type, event_id % 5, 0, count(*) FROM events GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, 3, count(*) FROM events)")
def rollup_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our extension: a roll-up with Catalyst's grouping sets."""
    rows = t(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 5).alias("bucket"))
    return rows.rollup("event_type", "bucket").agg(F.grouping_id().alias("kind"), F.count("*").alias("n"))


from . import ordered_queries, patch_queries, report_queries  # noqa: E402, F401 (add their queries to QUERIES)
