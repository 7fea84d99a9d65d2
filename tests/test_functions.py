"""Truth tables of the scalar functions and text operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patchlens.functions import dates, diff, status, text, url
from patchlens.operators import aggregates, filters, joins, reshape

SHA = "0123456789abcdef0123456789abcdef01234567"


def table(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def each(spark, values, f, kind="string"):
    rows = table(spark, values, kind).select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_lines(spark):
    values = ["a\nb", "a\nb\n", "", "\n", "a\r\nb\x0bc\x0cd\x1ce\x85f g", "a\n\nb"]
    assert each(spark, values, text.lines) == [v.splitlines() for v in values]


def test_tokens(spark):
    got = each(spark, ["ab cd_1 é", "", None, "x" * 9], text.words_and_chars)
    assert [tuple(g) for g in got] == [(3, 2), (0, 0), (0, 0), (1, 2)]


def test_paths(spark):
    assert each(spark, ["a/b.tar.gz", "a/.git", "x", "d/"], text.base_name) == ["b.tar.gz", ".git", "x", ""]
    assert each(spark, ["a/b.tar.gz", "a/.git", "x"], text.stem) == ["b.tar", ".git", "x"]
    assert each(spark, ["a/b.tar.gz", "a/.git", "x"], text.suffix) == [".gz", "", ""]


def test_split_once(spark):
    got = each(spark, ["f.c", "f.c::g", "a::B::c"], lambda c: text.split_once(c, "::"))
    assert [tuple(g) for g in got] == [("f.c", None), ("f.c", "g"), ("a", "B::c")]


def test_fences(spark):
    assert each(spark, ["```diff\nx\n```", "```c\nx\n```", "plain", "```x```", None], text.unfenced) == ["x", "x", "plain", "```x```", ""]
    assert each(spark, ["x", "", None], lambda c: text.fenced(c, F.lit("c"))) == ["```c\nx\n```", "", ""]
    assert each(spark, ["eA==", "é!", None], text.decoded) == ["x", None, None]


def test_versions(spark):
    got = each(spark, ["12", "12L", "13", "11"], text.version)
    assert sorted(map(tuple, got)) == [(11, 0), (12, 0), (12, 1), (13, 0)]


def test_urls(spark):
    tree, forge = f"https://{url.TREE_HOST}", f"https://{url.FORGE_HOST}"
    values = [f"{tree}/platform/frameworks/base/+/{SHA}", f"{forge}/clo/la/kernel/x/-/commit/{SHA}", f"https://example.com/a/+/{SHA}", f"{tree}/platform/x/{SHA}", f"{tree}/k/+/{SHA}^!"]
    assert each(spark, values, url.project) == ["frameworks/base", "kernel/x", None, None, "k"]
    assert each(spark, [values[0], "no"], url.commit_hash) == [SHA, None]
    assert each(spark, values[:3], url.download) == [values[0] + "^!/?format=TEXT", values[1] + ".diff", None]
    assert each(spark, [values[4], values[1]], url.fix_commit) == [SHA, f"/clo/la/kernel/x/-/commit/{SHA}"]
    assert each(spark, [values[4], values[1]], lambda c: url.fix_commit(c, parity=False)) == [SHA, SHA]


def test_dates(spark):
    assert each(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "N/A", None, "junk"], dates.naive) == [dt.datetime(2024, 1, 2, 3, 4, 5)] * 2 + [None] * 3
    hours = each(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "N/A"], lambda c: F.unix_timestamp(dates.aware(c)))
    assert hours == [1704164645, 1704157445, None]
    spoken = ["Tue Jan 02 03:04:05 2024 +0000", "by x at 2024-01-02 03:04:05 +0000 ok", "junk"]
    assert each(spark, spoken, lambda c: dates.epoch(dates.commit_time(c))) == [1704164645, 1704164645, 0]
    assert each(spark, ["Jan 02, 2024 3:04AM", "2024-01-02T03:04:00"], dates.page_time) == [dt.datetime(2024, 1, 2, 3, 4)] * 2
    assert each(spark, ["Committer", "commit", "", "author"], dates.commit_row) == [True, True, True, False]
    assert each(spark, ["Committer", "commit"], lambda c: dates.commit_row(c, parity=False)) == [True, False]


@pytest.mark.parametrize(
    "code, said, want",
    [
        (0, "", status.CLEAN), (0, "offset 3", status.OFFSETS), (0, status.REVERSED, status.ALREADY), (1, "offset", status.HUNKS),
        (2, status.NOT_FOUND, status.NO_FILES), (2, "", status.ERROR), (-9, "FAILED", status.HUNKS), (-9, "", status.UNKNOWN), (0, None, status.CLEAN),
    ],
)
def test_status(spark, code, said, want):
    row = spark.createDataFrame([(code, said)], "c int, o string").select(status.detailed(F.col("c"), F.col("o")).alias("d")).select("d", status.overall(F.col("d")).alias("s")).first()
    assert row["d"] == want
    assert row["s"] == (status.REJECTED if "Rejected" in want or "Skipped" in want else status.APPLIED)


@pytest.mark.parametrize("s, f, k, want", [(0, 0, 0, "all_failures"), (0, 2, 0, "all_failures"), (1, 1, 0, "partial_failures"), (1, 1, 1, "partial_failures"), (2, 0, 0, "all_successful"), (0, 1, 1, "all_successful"), (0, 0, 2, "all_successful")])
def test_tri_state(spark, s, f, k, want):
    assert spark.range(1).select(status.tri_state(F.lit(s), F.lit(f), F.lit(s + f + k)).alias("c")).first()["c"] == want


PATCH = "commit x\ndiff --git a/src/a.c b/src/a.c\n--- a/src/a.c\n+++ b/src/a.c\n@@ -1,2 +1,2 @@ f\n keep\n-old\n+new\n\\ No newline\ndiff --git a/b.c b/b.c\n--- a/b.c\n+++ b/b.c\n@@ -1 +1,2 @@\n x\n+y\n"


def test_diff(spark):
    one = lambda f: each(spark, [PATCH], f)[0]
    assert one(diff.hunk_count) == 2
    # lines after the first hunk's header that begin with +, - or a space: headers of the second file too
    assert tuple(one(diff.line_counts)) == (7, 3, 2)
    assert one(diff.hunks_only).startswith("@@ -1,2 +1,2 @@ f\n keep")
    assert each(spark, ["no hunk", None, ""], diff.hunks_only) == ["", "", ""]
    assert one(lambda c: diff.patch_of(c, F.lit("b.c"))).startswith("diff --git a/b.c")
    assert one(lambda c: F.size(diff.kept_by_name(diff.sections(c), F.array(F.lit("src/a.c"))))) == 1
    assert one(lambda c: F.size(diff.kept_by_suffix(diff.sections(c), F.array(F.lit("x/b.c"))))) == 1
    assert each(spark, ["", "text only"], diff.sections) == [[], []]


def test_long_diffs_take_time_in_proportion(spark):
    import time

    def took(n):
        value = "x\n" + "diff --git a/f b/f\n@@ -1 +1 @@\n+a\n-b\n" * (n // 4)
        df = spark.createDataFrame([(value,)], "t string").select(F.size(diff.sections(F.col("t"))).alias("n"), diff.failed_files(F.repeat(F.lit("checking file a\nHunk #1 FAILED\n"), F.lit(n // 2))).alias("f"))
        began = time.perf_counter()
        row = df.first()
        assert row["n"] == n // 4 and row["f"] == ["a"]
        return time.perf_counter() - began

    took(100)
    few, many = took(10_000), took(100_000)
    assert many < 12 * few


def test_diff_grammar(spark):
    good = diff.parse(PATCH)
    assert good[1] == "" and good[0].count("@@ -") == 2
    for bad in ("", "text", "@@ -1 +1 @@\n x", "+++ b/x\n@@ -1,3 +1,3 @@\n x\n", "+++ b/x\n@@ -1 +1 @@\nodd\n", "+++ b/x\n@@ bad\n"):
        assert diff.parse(bad)[1]
    rows = each(spark, [PATCH, "text", None], diff.parsed)
    assert [r["valid"] for r in rows] == [True, False, False]


def test_conflicts(spark):
    value = "a\n<<<<<<< HEAD\nx\n=======\ny\nz\n>>>>>>> t\nb\n<<<<<<< HEAD\n=======\nq\n>>>>>>> t\n"
    got = each(spark, [value, "none"], lambda c: diff.conflicts(c, F.lit("14"), F.lit("c1")))
    assert [g["hunk_number"] for g in got[0]] == [1, 2] and got[1] == []
    assert got[0][0]["merge_conflict"] == "<<<<<<< DOWNSTREAM (version 14)\nx\n=======\ny\nz\n>>>>>>> UPSTREAM PATCH (commit c1)"


def test_console(spark):
    said = "checking file a.c\nHunk #1 FAILED at 3.\n1 out of 4 hunks FAILED\npatching file b.c\nok\npatching file c.c\nHunk #2 FAILED at 9.\n"
    assert each(spark, [said, "", None], diff.failed_files) == [["a.c", "c.c"], [], []]
    got = each(spark, [said, "Hunk #3 FAILED", "fine"], diff.hunk_totals)
    assert [(g["total_hunks"], g["failed_hunks"]) for g in got] == [(4, [1, 2]), (3, [3]), (0, [])]


def test_coercion(spark):
    assert each(spark, ["True", "false", "yes", None], filters.flag) == [True, False, True, False]
    assert each(spark, ["3", "x", None], filters.number) == [3.0, 0.0, 0.0]
    assert each(spark, ["a", None], filters.label) == ["a", "nan"]


def test_qualifies(spark):
    kind = "array<struct<package struct<name string>, ecosystem_specific struct<spl string>>>".replace(" struct", ":struct").replace("name string", "name:string").replace("spl string", "spl:string")
    ok, no = (("platform/x",), ("2024-01-01",)), (("platform/x",), ("2024-01-05",))
    df = spark.createDataFrame([(1, [no, ok], "2024-01-01T00:00:00Z"), (2, [no], "2024-01-01T00:00:00Z"), (3, [ok], "2023-12-31T23:59:59Z"), (4, None, None)], f"i int, a {kind}, p string")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    assert [r["i"] for r in df.filter(filters.qualifies(F.col("a"), F.col("p"), day("2024-01-01"), day("2024-12-31"))).collect()] == [1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "a string, b string, s string, o bigint")
    assert aggregates.success_matrix(none, ["a", "b"], "s", "F", "O").collect() == []
    assert aggregates.cross_stats(none.groupBy("a").agg(F.count("*").alias("n")), "n").first().asDict() == {"entities": 0, "repeated": 0, "most": 0, "mean": 0.0}
    assert reshape.regroup(none, "a", "b", "s", "o").collect() == []
    assert aggregates.shares(none, "a").collect() == []


def test_last_wins_and_all_or_none(spark):
    main = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id int, severity string")
    ref = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "c", "d"), (2, 2, "e", ""), (3, 3, "f", "g")], "id int, o int, p string, q string")
    got = joins.enrich(main, ref, "id", "o", ["p", "q"], F.col("severity").isNotNull()).orderBy("id").collect()
    assert [(r["p"], r["q"]) for r in got] == [("c", "d"), (None, None), (None, None)]


def test_resume_leaves_a_group_out(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "url int")
    groups = {"done": rows.filter("url = 0"), "mismatch": rows.filter("url = 1")}
    assert sorted(r[0] for r in joins.unfinished(rows, groups, "url").collect()) == [1, 2, 3]
    assert sorted(r[0] for r in joins.unfinished(rows, groups, "url", parity=False).collect()) == [2, 3]


def test_settings():
    from patchlens import config

    assert config.load(None) == config.Config()
    got = config.load({"llm_runner": {"max_retries": 7, "unknown": 1}, "paths": None, "other": {"a": 1}})
    assert got.llm_runner.max_retries == 7 and got.llm_runner.concurrency == 5 and got.paths.parsed_vanir_report == "reports/parsed_report.json"


def test_keys_that_rotate(spark):
    assert each(spark, ["API key not valid. Please", "Rate Limit", "Quota", "Internal error", "other", None], status.rotate_key) == [True, True, True, True, False, False]


def test_invalid_attempts_are_no_rows(spark):
    df = spark.createDataFrame([(1, [None]), (2, []), (3, None), (4, [None, (3,)])], "k int, a array<struct<attempt:int>>")
    assert sorted((r["k"], r["attempt_number"]) for r in reshape.attempts(df, "a", ["k"]).collect()) == [(2, 0), (3, 0), (4, 3)]


def test_groups_of_one_side(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "g int, c string")
    right = spark.createDataFrame([(1, "14"), (1, "14"), (1, "13"), (3, "14")], "g int, v string")
    got = {r["g"]: (r["matches"], r["mismatches"], r["mismatch_versions"], r["matched_versions"]) for r in joins.same_counts(left, right, "g", "v").collect()}
    assert got == {1: (False, 1, ["13"], ["14"]), 2: (True, 0, [], []), 3: (False, 1, ["14"], [])}
