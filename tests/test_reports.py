"""Scans, sinks and whole-report plans over files made here."""

import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from patchlens import schemas
from patchlens.functions import url
from patchlens.plans import report_queries
from patchlens.plans import reports as plans
from patchlens.sources import reports, scratch, sinks
from patchlens.streaming import attempts

SHA = "0123456789abcdef0123456789abcdef0123456"


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_schemas_are_valid(spark):
    for ddl in (schemas.SCANNER, schemas.PARSED, schemas.GROUPED, schemas.FETCH_FAILURE, schemas.APPLIED, schemas.REPAIRED, schemas.OSV, schemas.FAILURES, schemas.EVALUATED, schemas.FAILURE_LOG, schemas.ATTEMPTS_CSV):
        assert spark.createDataFrame([], ddl).schema
    assert len(spark.createDataFrame([], schemas.ATTEMPTS_CSV).columns) == 35


def test_parse_scan(spark, tmp_path):
    a, b = (f"https://{url.TREE_HOST}/platform/x/+/{SHA}{n}" for n in (1, 2))
    find = lambda patch, code: {"patch": patch, "unpatched_code": code}
    report = {"covered_cves": [], "missing_patches": [{"ID": "i", "details": [find(b, "f.c::g"), find(a, "z.c"), find(b, "a.c::h::i"), find(b, "f.c::g"), find(b, "f.c::e")]}, {"ID": "j", "details": []}, {"ID": "k", "details": [find("https://other/+/1", "q.c")]}]}
    got = plans.parse_scan(reports.scanner(spark, write(tmp_path / "r.json", report))).orderBy("first_seen").collect()
    assert [r["patch_url"] for r in got] == [b, a]
    assert {k: v["functions"] for k, v in got[0]["files"].items()} == {"f.c": ["g", "e"], "a.c": ["h::i"]}
    assert got[1]["files"]["z.c"]["functions"] == [] and got[1]["project"] == "x" and got[1]["patch_file"] == f"{SHA}1.diff"


def test_patches_of_either_root(spark, tmp_path):
    row = {"patch_url": "u", "patch_file": "p", "project": "x", "files": {"a.c": {"functions": ["f"]}}}
    listed = reports.patches(spark, write(tmp_path / "l.json", [row, row]))
    held = reports.patches(spark, write(tmp_path / "o.json", {"patches": [row]}))
    assert listed.count() == 2 and held.count() == 1
    assert held.select(F.explode("files")).first()["key"] == "a.c"


def test_tolerant_scan(spark, tmp_path):
    good = {"run_timestamp": "t", "target_downstream_version": "14", "skipped_or_errored_diff_generation_log": [{"vulnerability_id": "v", "file_name": "f"}, {"vulnerability_id": "v", "file_name": "g", "reason": "r"}]}
    paths = [write(tmp_path / "a.json", good), write(tmp_path / "b.json", "{broken")]
    got = reports.failure_logs(spark, paths)
    assert sorted(r["reason"] for r in got.collect()) == ["r", "unknown"]
    assert reports.failure_logs(spark, [str(tmp_path / "none.json")]).count() == 0
    tables = plans.failure_analysis(got)
    assert tables["vulnerabilities"].first()["appears_in_num_reports"] == 1
    assert tables["stats"].first()["entities"] == 1 and tables["files"].count() == 2 and tables["top_reasons"].count() == 2


def test_lists_and_folders(spark, tmp_path):
    assert sorted(r[0] for r in reports.id_list(spark, write(tmp_path / "ids.txt", "b\n\n a \nb\n")).collect()) == ["a", "b"]
    (tmp_path / "osv").mkdir()
    write(tmp_path / "osv" / "A-1.json", {"id": "A-1"})
    assert [r[0] for r in reports.listed_ids(spark, str(tmp_path / "osv")).collect()] == ["A-1"]
    (tmp_path / "t" / "s").mkdir(parents=True)
    write(tmp_path / "t" / "s" / "x.c.rej", "@@")
    assert [tuple(r) for r in reports.reject_files(spark, str(tmp_path / "t")).collect()] == [("s/x.c.rej", "@@")]


def evaluated():
    result = lambda v, r: {"downstream_version": v, "result": r, "downstream_patch_content": "a b", "file_conflicts": []}
    return {
        "id": "v1", "patch_attempts": [{"upstream_patch_content": "one two three", "patch_results": [result("13", "success"), result("12", "failure"), result("12", "skipped"), result(None, "success")]}],
        "cross_patch_attempts": [{"from": "14", "to": "13", "result": "success"}, {"from": "14", "to": "12"}, {"to": "12", "result": "success"}],
    }


def test_evaluation(spark, tmp_path):
    rows = reports.documents(spark, write(tmp_path / "e.json", evaluated()), schemas.EVALUATED)
    cells = {(r["src"], r["tgt"]): tuple(r)[2:] for r in plans.success_matrix(rows).collect()}
    assert cells == {("main", "13"): (1, 0, 0, 1, 100.0), ("main", "12"): (0, 1, 1, 2, 0.0), ("14", "13"): (1, 0, 0, 1, 100.0), ("14", "12"): (0, 0, 1, 1, 0.0)}
    assert plans.classified(rows).first()["class"] == "partial_failures"
    tokens = {r["section"]: r["word_based"] for r in plans.token_sections(rows).collect()}
    assert tokens["upstream_patch"] == 3 and tokens["downstream_patch"] == 8


def test_attempt_rows_to_csv_and_rates(spark, tmp_path):
    # a conflict is successful if its own flag says so
    conflict = lambda name, tries: {"file_name": name, "total_hunks": 2, "failed_hunks": [1, 2], "rej_file_content": "```diff\n@@ -1 +1 @@\n-a\n+b\n```", "llm_output_valid": any(t["valid"] for t in tries), "validation_results": tries}
    log = {"summary": {"system_prompt": "s\n\"q\"", "base_task_prompt": "b"}, "failures": [{"id": "v", "upstream_patch_content": "", "failures": [{"downstream_version": "14", "file_conflicts": [conflict("a.c", [{"attempt": 1, "valid": False}, {"attempt": 2, "valid": True}]), conflict("b.c", [])]}]}]}
    got = plans.attempt_rows(reports.documents(spark, write(tmp_path / "l.json", log), schemas.FAILURES))
    rows = got.orderBy("target_file_name", "attempt_number").collect()
    assert [(r["target_file_name"], r["attempt_number"], r["rej_file_actual_hunk_count"], r["original_patch_failed_hunk_numbers"]) for r in rows] == [("a.c", 1, 1, "1,2"), ("a.c", 2, 1, "1,2"), ("b.c", 0, 1, "1,2")]
    sinks.csv(got.select("system_prompt", "target_file_name"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.first()["system_prompt"] == 's\n"q"'
    rate = plans.prompt_rates(got).first()
    assert (rate["conflicts"], rate["successful"], rate["success_rate"]) == (2, 1, 50.0)
    assert len(got.columns) == 35 and got.columns == spark.createDataFrame([], schemas.ATTEMPTS_CSV).columns
    sinks.csv(got, str(tmp_path / "all"))
    assert plans.prompt_rates(reports.attempts_csv(spark, str(tmp_path / "all"))).collect() == plans.prompt_rates(got).collect()


def test_ground_truth_is_the_versions_own_patch(spark, tmp_path):
    patch = lambda n: "diff --git a/x.c b/x.c\n@@ -1 +1 @@ f\n" + "+n\n" * n
    conflict = {"file_name": "x.c", "validation_results": ["odd"]}
    version = lambda own, c: {"downstream_version": "14", "downstream_patch_content": own, "file_conflicts": [c]}
    tried = conflict | {"validation_results": [{"attempt": 1, "valid": True}]}
    log = {"failures": ["odd", {"id": "v", "upstream_patch_content": patch(2), "failures": [version(patch(3), tried), version("", tried), version(None, conflict), 7]}]}
    write(tmp_path / "l.json", log)
    rows = plans.attempt_rows(reports.run_logs(spark, str(tmp_path))).collect()
    # a list of only invalid attempts gives no row
    assert sorted((r["ground_truth_added_lines"], r["downstream_specific_gt_added_lines"]) for r in rows) == [(2, 0), (3, 3)]
    assert {r["system_prompt"] for r in rows} == {"MISSING_IN_SUMMARY"} and {r["attempt_runtime_sec"] for r in rows} == {0.0}

def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string")
    sinks.json_document(df, str(tmp_path / "j"), "rows")
    assert len(spark.read.json(str(tmp_path / "j")).first()["rows"]) == 2
    assert sinks.by_suffix(df, None) is None and sinks.by_suffix(df, str(tmp_path / "x.txt")) is None
    assert sinks.by_suffix(df, str(tmp_path / "x.csv")) == "csv"
    sinks.id_list(df, str(tmp_path / "ids"), "s")
    assert [r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["a", "b"]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "14", "failure"), ("2024-01-01 02:00:00", "14", "success"), ("2024-01-05 00:00:00", "13", "success")], "ts string, v string, r string")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v string, r string").parquet(str(tmp_path / "in"))
    q = attempts.per_version(stream, "ts", "v", "r", "failure").writeStream.outputMode("append").format("memory").queryName("per_version").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert [(r["v"], r["tested"], r["failures"]) for r in spark.table("per_version").collect()] == [("14", 2, 1)]
    finally:
        q.stop()


def test_a_bundle_reads_as_the_folder_of_its_files(spark, tmp_path):
    """Files without a folder, a listing and a commit of their own."""
    texts = [("a", '{"id": "A", "aliases": ["x"]}'), ("b", '[{"id": "B"}, {"id": "C"}]'), ("c", '{"id": "D", ')]
    docs = spark.createDataFrame(texts, "name string, value string")
    (tmp_path / "d").mkdir()
    for name, value in texts:
        write(tmp_path / "d" / f"{name}.json", value)
    packed, plain = scratch.documents(docs.repartition(2), "name", str(tmp_path / "p")), str(tmp_path / "d")
    assert len([p for p in (tmp_path / "p.bundle").iterdir() if p.name.startswith("part-")]) <= 2
    for path in (packed, plain):
        assert sorted((r["id"], r["source_file"]) for r in reports.documents(spark, path, schemas.OSV, tolerant=True).collect()) == [("A", "a.json"), ("B", "b.json"), ("C", "b.json")]
        assert sorted(r[0] for r in reports.listed_ids(spark, path).collect()) == ["a", "b", "c"]
    rejects = scratch.bundle(spark.createDataFrame([("d/x.rej", "@@"), ("e/x.orig", "o")], "name string, value string"), str(tmp_path / "r"))
    assert [tuple(r) for r in reports.reject_files(spark, rejects).collect()] == [("d/x.rej", "@@\n")]


def test_texts_of_a_bundle_are_read_a_few_at_once(spark, tmp_path):
    """F1 to F7 of round 4: texts that compress well lay in one group of rows, which a reader holds whole."""
    big = spark.range(40, numPartitions=1).select(F.col("id").cast("string").alias("name"), F.repeat(F.lit("ab"), 500_000).alias("value"))
    small = spark.range(5000, numPartitions=1).select(F.concat(F.lit("s"), F.col("id")).alias("name"), F.lit("x").alias("value"))
    path = scratch.bundle(big.unionByName(small).coalesce(1), str(tmp_path / "b"))
    (part,) = (tmp_path / "b.bundle").glob("part-*")
    found = pq.ParquetFile(part).metadata
    groups = [found.row_group(i) for i in range(found.num_row_groups)]
    assert max(g.column(1).total_uncompressed_size for g in groups) <= scratch.GROUP + 2_000_000 and len(groups) <= 16
    back = scratch.bundled(spark, path).agg(F.count("*"), F.sum(F.length("value"))).first()
    assert tuple(back) == (5040, 40 * 1_000_001 + 5000 * 2)


def test_tasks_that_nest_rows_are_counted_by_rows(spark):
    """F1 to F7 of round 4: few bytes of lines are many bytes of documents."""
    rows = spark.range(40 * report_queries.NESTED).select((F.col("id") % 997).alias("doc"))
    assert report_queries.dealt(rows).rdd.getNumPartitions() == 40
    assert report_queries.dealt(rows.limit(5)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_logs_of_a_bundle_pass_over_odd_nodes(spark, tmp_path):
    """the same rows from a bundle as from files, also where inner nodes are of other types."""
    good = {"downstream_version": "14", "file_conflicts": [{"file_name": "x.c", "validation_results": [{"attempt": 1, "valid": True}]}]}
    odd = {"downstream_version": "13", "file_conflicts": ["odd", {"file_name": "y.c", "validation_results": ["odd", {"attempt": 2}]}]}
    log = json.dumps({"summary": {"system_prompt": "s"}, "failures": ["odd", {"id": "v", "failures": [good]}, {"id": "w", "failures": [7, odd, good]}]})
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "l.json", log)
    packed = scratch.documents(spark.createDataFrame([("l", log)], "name string, value string"), "name", str(tmp_path / "p"))
    rows = [sorted(plans.attempt_rows(reports.run_logs(spark, path)).collect()) for path in (packed, str(tmp_path / "d"))]
    assert rows[0] == rows[1] and [(r["vulnerability_id"], r["target_file_name"], r["attempt_number"]) for r in rows[0]] == [("v", "x.c", 1), ("w", "y.c", 2), ("w", "x.c", 1)]
    assert [(r["source_file"], [v and v["id"] for v in r["failures"]]) for r in reports.logged(spark, packed).collect()] == [("l.json", [None, "v", "w"])]
    few = plans.attempt_rows(reports.run_logs(spark, packed, ordered=False))
    assert sorted(map(tuple, plans.data_summary(few.select(*plans.SUMMED_UP)).collect())) == sorted(map(tuple, plans.data_summary(few).collect()))


def test_averages_edges_and_classes_of_one_pass(spark):
    """Missing arrays, results without attempts and null results as before."""
    tokens = {"general": {"word_based": 4, "char_based": 6}}
    result = lambda v, r, *c: {"downstream_version": v, "result": r, "downstream_patch_tokens": tokens, "file_conflicts": list(c) or None}
    conflict = {"file_name": "a", "upstream_file_tokens": tokens, "inline_merge_token_summary": {"word_based": 2, "char_based": 2}}
    reports_ = [
        {"id": "a", "patch_attempts": [{"upstream_patch_tokens": tokens, "patch_results": [result("13", "failure", conflict), result("12", None)]}, {"patch_results": None}], "cross_patch_attempts": [{"from": "14", "to": "13"}, {"to": "12"}]},
        {"id": "b", "patch_attempts": [{"patch_results": [result("13", "failure")]}]}, {"id": "c", "patch_attempts": []}, {"id": "d"}, {"id": "e", "patch_attempts": [{"patch_results": [result(None, "success"), result("13", "success")]}]},
    ]
    rows = spark.createDataFrame([(json.dumps(r),) for r in reports_], "v string").select(F.from_json("v", schemas.EVALUATED).alias("e")).select("e.*")
    averages = {r["section"]: (r["failed_results"], r["word_based"], r["char_based"]) for r in plans.failure_averages(plans.failure_entries(rows)).collect()}
    assert averages == {"upstream_patch": (2, 2.0, 3.0), "downstream_patch": (2, 4.0, 6.0), "upstream_source": (2, 2.0, 3.0), "downstream_source": (2, 0.0, 0.0), "rej_file": (2, 0.0, 0.0), "inline_merge_conflict": (2, 1.0, 1.0)}
    assert plans.failure_averages(plans.failure_entries(rows.filter("id = 'e'"))).count() == 0
    assert sorted(map(tuple, plans.evaluation_edges(rows).collect()), key=repr) == sorted([("main", "13", "failure"), ("main", "13", "failure"), ("main", "13", "success"), ("14", "13", None)], key=repr)
    one = {r["id"]: r["c"] for r in rows.select("id", plans.class_of(F.col("patch_attempts")).alias("c")).collect() if r["c"]}
    assert one == {r["id"]: r["class"] for r in plans.classified(rows).collect()} and set(one) == {"a", "b", "e"}
    # a report is read once, however many kinds of edges and sections it gives
    for df in (plans.evaluation_edges(rows), plans.failure_averages(plans.failure_entries(rows))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("JsonToStructs") + df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 12 and "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
