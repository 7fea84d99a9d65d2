"""Plans over whole reports: parsing a scan, judging an evaluation, analysing failures, preparing attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diff, text, url
from ..functions.scan import bound
from ..functions.status import tri_state
from ..operators import aggregates as agg
from ..operators import filters, reshape


#: Fixed value: what a conflict without attempts says.
UNTRIED = "No LLM attempt made or logged"


def parse_scan(found: DataFrame) -> DataFrame:
    """Findings as patches: per address its files in the order they came, each with its distinct functions.

    An address without a commit or project is left out.
    """
    parts = text.split_once(F.col("unpatched_code"), "::")
    rows = found.select("patch", parts["head"].alias("file"), parts["tail"].alias("function"), "ordinal")
    good = rows.filter(url.commit_hash(F.col("patch")).isNotNull() & url.project(F.col("patch")).isNotNull())
    listed = reshape.regroup(good, "patch", "file", "function", "ordinal")
    files = F.map_from_entries(F.transform("files", lambda f: F.struct(f["file"].alias("k"), F.struct(f["items"].alias("functions")).alias("v"))))
    return listed.select("first_seen", F.col("patch").alias("patch_url"), F.concat(url.commit_hash(F.col("patch")), F.lit(".diff")).alias("patch_file"), url.project(F.col("patch")).alias("project"), files.alias("files"))


def by_file(patches: DataFrame) -> DataFrame:
    """Patches of each file by date."""
    rows = patches.select(F.explode(F.map_keys("files")).alias("file"), "patch_url", "patch_file", "project", "commit_date", F.try_to_timestamp("commit_date").alias("_date"), "ordinal")
    return reshape.inverted(rows, "file", "_date", "ordinal", ["patch_url", "patch_file", "project", "commit_date"])


def evaluation_edges(evaluated: DataFrame) -> DataFrame:
    """(src, tgt, status) of forwarded and of cross attempts of all groups."""
    edge = lambda kind, src, tgt, status: F.struct(kind.alias("_main"), src.alias("src"), tgt.alias("tgt"), status.alias("status"))
    results = F.flatten(F.filter(F.transform("patch_attempts", lambda a: a["patch_results"]), lambda x: x.isNotNull()))
    main = F.transform(results, lambda r: edge(F.lit(True), F.lit("main"), r["downstream_version"], r["result"]))
    cross = F.transform("cross_patch_attempts", lambda c: edge(F.lit(False), c["from"], c["to"], c["result"]))
    # both kinds in one pass over the report
    none = F.array().cast("array<struct<_main: boolean, src: string, tgt: string, status: string>>")
    rows = evaluated.select(F.inline(F.concat(F.coalesce(main, none), F.coalesce(cross, none))))
    return rows.filter(F.when(F.col("_main"), F.col("tgt").isNotNull() & F.col("status").isNotNull()).otherwise(F.col("src").isNotNull() & F.col("tgt").isNotNull())).select("src", "tgt", "status")


def success_matrix(evaluated: DataFrame) -> DataFrame:
    return agg.success_matrix(evaluation_edges(evaluated), ["src", "tgt"], "status", "success", "failure")


def classified(evaluated: DataFrame) -> DataFrame:
    rows = evaluated.select("id", F.explode("patch_attempts").alias("a")).select("id", F.explode("a.patch_results").alias("r"))
    return agg.classified(rows.select("id", "r.result"), "id", "result", "success", "failure")


def class_of(attempts: Column) -> Column:
    """The class that classified() gives a vulnerability, from its own attempts; null without results."""
    results = F.flatten(F.filter(F.transform(attempts, lambda a: F.transform(a["patch_results"], lambda r: F.coalesce(r["result"], F.lit("")))), lambda x: x.isNotNull()))
    n = lambda c: F.size(c).cast("bigint")
    return bound(results, lambda rs: F.when(n(rs) > 0, tri_state(n(F.filter(rs, lambda r: r == "success")), n(F.filter(rs, lambda r: r == "failure")), n(rs))))


def token_sections(evaluated: DataFrame) -> DataFrame:
    """Token estimates of the leaves, recomputed: (section, text) of patches, sources, rejects and conflicts."""
    attempt = evaluated.select(F.explode("patch_attempts").alias("a"))
    result = attempt.select(F.explode("a.patch_results").alias("r"))
    conflict = result.select(F.explode("r.file_conflicts").alias("c"))
    inline = conflict.select(F.explode("c.inline_merge_conflicts").alias("m"))
    parts = [
        attempt.select(F.lit("upstream_patch").alias("section"), F.col("a.upstream_patch_content").alias("text")), result.select(F.lit("downstream_patch"), "r.downstream_patch_content"),
        conflict.select(F.lit("upstream_source"), "c.upstream_file_content"), conflict.select(F.lit("downstream_source"), "c.downstream_file_content"),
        conflict.select(F.lit("rej_file"), "c.rej_file_content"), inline.select(F.lit("inline_merge"), "m.merge_conflict"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return agg.token_rollup(rows, "section", text.words_and_chars(F.col("text")))


def failure_analysis(logged: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """The tables of a failure report, from logged failures."""
    counts = agg.by_source(logged, "vulnerability_id", "source_file")
    pairs = logged.groupBy("file_name", "reason").agg(F.count("*").alias("n"))
    order = (F.desc("appears_in_num_reports"), F.asc("vulnerability_id"))
    few = agg.top(counts, k, *order)
    return {
        "vulnerabilities": counts, "details": agg.details(logged, "vulnerability_id", ["patch_sha", "file_name", "reason", "source_file"]), "reasons": agg.shares(logged, "reason"),
        "files": pairs.groupBy("file_name").agg(F.sum("n").alias("n"), reshape.counted_list("reason", "n").alias("reasons")),
        "stats": agg.cross_stats(counts, "total_failures_across_all_inputs", "appears_in_num_reports"), "top": few,
        "top_reasons": logged.join(F.broadcast(few.select("vulnerability_id")), "vulnerability_id", "left_semi").groupBy("vulnerability_id", "reason").agg(F.count("*").alias("n")),
    }


def charts(logged: DataFrame) -> dict[str, DataFrame]:
    """What the four charts of a failure report show: label and value, in order."""
    named = lambda df, label, value, k: agg.top(df.select(F.col(label).alias("label"), F.col(value).alias("value")), k, F.desc("value"), F.asc("label"))
    sources = logged.select("vulnerability_id", "source_file").distinct().groupBy("source_file").agg(F.count("*").alias("n"))
    files = logged.groupBy(text.base_name(F.col("file_name")).alias("file"), "file_name").agg(F.count("*").alias("n"))
    reasons = agg.shares(logged, "reason", 1)
    return {
        "vulnerabilities": named(agg.by_source(logged, "vulnerability_id", "source_file"), "vulnerability_id", "total_failures_across_all_inputs", 15),
        "reasons": reasons.select(F.col("reason").alias("label"), F.col("n").alias("value"), "percent"), "sources": named(sources, "source_file", "n", 10), "files": named(files, "file", "n", 15),
    }


def failure_entries(evaluated: DataFrame) -> DataFrame:
    """An entry for each attempt with failures: these alone, under what the vulnerability's first attempt says of the patch."""
    first = F.element_at("patch_attempts", 1)
    each = evaluated.filter(F.size("patch_attempts") > 0).select(
        "id", "vulnerability_url", F.coalesce("severity", F.lit("Unknown")).alias("severity"), first["upstream_patch_content"].alias("upstream_patch_content"),
        first["upstream_commits"].alias("upstream_commits"), first["upstream_patch_tokens"].alias("upstream_patch_tokens"), F.explode("patch_attempts").alias("a"),
    )
    own = F.filter("a.patch_results", lambda r: F.coalesce(r["result"] == "failure", F.lit(False)))
    out = each.withColumn("failures", own).filter(F.size("failures") > 0)
    return out.select("id", "vulnerability_url", "severity", "failures", F.coalesce("upstream_patch_content", F.lit("")).alias("upstream_patch_content"), F.coalesce("upstream_commits", F.array().cast("array<string>")).alias("upstream_commits"), "upstream_patch_tokens")


def failure_averages(entries: DataFrame) -> DataFrame:
    """Stored token estimates of failures by section, over the number of failed results, rounded.

    The original cannot compute these once there are failures; this is what it was meant to give.
    """
    said = lambda section, tokens: F.struct(F.lit(section).alias("section"), tokens.alias("t"))
    inline = lambda c: F.struct(c["inline_merge_token_summary"].alias("general"))
    of_conflict = lambda c: F.array(said("upstream_source", c["upstream_file_tokens"]), said("downstream_source", c["downstream_file_tokens"]), said("rej_file", c["rej_file_tokens"]), said("inline_merge_conflict", inline(c)))
    own = F.array(said("upstream_patch", F.col("upstream_patch_tokens")))
    results = F.transform("failures", lambda r: said("downstream_patch", r["downstream_patch_tokens"]))
    conflicts = F.flatten(F.transform(F.flatten(F.filter(F.transform("failures", lambda r: r["file_conflicts"]), lambda x: x.isNotNull())), of_conflict))
    # all sections and the number of failed results in one pass
    rows = entries.select(F.inline(F.concat(own, results, conflicts)))
    unit = lambda u: F.coalesce(F.sum(f"t.general.{u}"), F.lit(0)).cast("bigint").alias(u)
    summed = rows.groupBy("section").agg(unit("word_based"), unit("char_based"), F.count("*").alias("_rows"))
    # at most six rows
    count = summed.agg(F.coalesce(F.max(F.when(F.col("section") == "downstream_patch", F.col("_rows"))), F.lit(0)).alias("_n"), F.collect_list(F.struct("section", "word_based", "char_based")).alias("_s"))
    return agg.token_average(count.select(F.inline("_s"), "_n"), F.col("_n")).withColumnRenamed("_n", "failed_results")


def conflict_records(rejects: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """A record of each file whose patch failed. Keys: run.

    runs: run, version, commit, patch, output, total_hunks, failed_hunks. rejects: run, path, content of reject files.
    files: run, path, upstream, downstream, marked (contents before and after the patch was merged, null if missing) and
    merge_output. A run without reject files whose output says that a file was not found gives a record of the short form
    for each file of its output's diff.
    """
    named = rejects.select("run", F.replace("path", F.lit(".rej"), F.lit("")).alias("path"), "content", F.lit(True).alias("rejected"))
    return records(runs.join(named, "run", "left").join(files, ["run", "path"], "left"))


def records(rows: DataFrame) -> DataFrame:
    """The same where runs already have their files: a row for each reject file of a run, one (not rejected) where it has none.

    Columns: those of runs, rejected (null reads as false), path of the file, content of its reject file, and those of files.
    All records are made in one pass: a row becomes records of one form or the other.
    """
    content = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = F.coalesce("rejected", F.lit(False))
    lost = F.contains(content("output"), F.lit("can't find file to patch at input line"))
    each = F.when(own, F.array("path")).when(lost, F.regexp_extract_all("output", F.lit("diff --git a/(.*?) b/"), F.lit(1)))
    inline = F.when(own, diff.conflicts(content("marked"), F.col("version"), F.col("commit")))
    rows = rows.select("*", own.alias("_own"), F.explode(each).alias("file_name")).withColumn("inline_merge_conflicts", inline)
    kind = F.substring_index("file_name", ".", -1)
    tokens = lambda c: F.struct(text.words_and_chars(content(c)).alias("general"))
    fence = lambda c: F.when(content(c) == "", F.lit("")).otherwise(F.concat(F.lit("```"), kind, F.lit("\n"), text.stripped(F.col(c)), F.lit("\n```")))
    total = lambda unit: F.aggregate("inline_merge_conflicts", F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c["merge_conflict_tokens"][unit], F.lit(0)))
    summary = F.struct(total("word_based").alias("word_based"), total("char_based").alias("char_based"))
    missing = F.concat(F.lit("File '"), F.col("file_name"), F.lit("' is missing in downstream repo"))
    none, empty = F.lit(None), F.lit("")
    # of a file with rejects, of a file that is not there
    forms = {
        "total_hunks": (F.col("total_hunks"), F.lit(0)), "failed_hunks": (F.col("failed_hunks"), F.array().cast("array<int>")), "inline_merge_conflicts": (F.col("inline_merge_conflicts"), F.filter(diff.conflicts(empty, empty, empty), lambda _: F.lit(False))),
        "inline_merge_token_summary": (summary, none), "rej_file_content": (F.concat(F.lit("```diff\n"), text.stripped(F.col("content")), F.lit("\n```")), empty), "rej_file_tokens": (tokens("content"), none),
        "patch_apply_output": (F.col("output"), F.col("output")), "inline_merge_output": (content("merge_output"), empty), "upstream_file_content": (fence("upstream"), empty), "upstream_file_tokens": (tokens("upstream"), none),
        "downstream_file_content": (fence("downstream"), empty), "downstream_file_tokens": (tokens("downstream"), none), "downstream_file_content_with_markers": (fence("marked"), none), "reason": (none.cast("string"), missing),
    }
    return rows.select("run", "file_name", *(F.when(F.col("_own"), whole).otherwise(short).alias(c) for c, (whole, short) in forms.items()))


def attempt_rows(logs: DataFrame) -> DataFrame:
    """One row per attempt of each conflict, in the columns and order of the table of attempts.

    A conflict without attempts has one row of number 0. What is missing reads as its default. The ground truth is the
    version's own patch, or the upstream one where that is empty; columns of the version's own are empty then.
    """
    say = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    each = lambda df, array, name: df.select("*", F.explode(F.filter(array, lambda x: x.isNotNull())).alias(name))
    file = each(each(each(logs.select("source_file", "summary", F.col("failures").alias("_f")), "_f", "v"), "v.failures", "r"), "r.file_conflicts", "c")
    reject = diff.hunks_only(text.unfenced(F.col("c.rej_file_content")))
    own_patch = F.coalesce("r.downstream_patch_content", F.lit(""))
    truth = F.when(own_patch != "", own_patch).otherwise(say("v.upstream_patch_content", ""))
    of_file = lambda patch: diff.hunks_only(diff.patch_of(patch, say("c.file_name", "UnknownFile")))
    texts = file.select(
        F.col("source_file").alias("json_file_source"), say("summary.system_prompt", "MISSING_IN_SUMMARY").alias("system_prompt"), say("summary.base_task_prompt", "MISSING_IN_SUMMARY").alias("base_task_prompt"),
        say("v.id", "UnknownVulnerabilityID").alias("vulnerability_id"), say("r.downstream_version", "N/A").alias("downstream_version"), say("c.file_name", "UnknownFile").alias("target_file_name"), "c",
        reject.alias("_rej"), of_file(truth).alias("_gt"), of_file(own_patch).alias("_own"),
    )
    counts = lambda c, n: diff.line_counts(F.col(c))[n]
    lines = lambda c, name: [counts(c, n).alias(f"{name}_{n}_lines") for n in ("total", "added", "removed")]
    own = texts.select(
        "json_file_source", "system_prompt", "base_task_prompt", "vulnerability_id", "downstream_version", "target_file_name",
        say("c.total_hunks", 0).cast("bigint").alias("original_patch_total_hunks_for_file"), F.coalesce(text.joined_numbers(F.col("c.failed_hunks")), F.lit("")).alias("original_patch_failed_hunk_numbers"),
        F.greatest(F.coalesce(F.size("c.failed_hunks"), F.lit(0)), F.lit(0)).cast("bigint").alias("rej_file_reported_hunk_count"), diff.hunk_count(F.col("_rej")).alias("rej_file_actual_hunk_count"), *lines("_rej", "rej_file"),
        diff.hunk_count(F.col("_gt")).alias("ground_truth_hunk_count"), *lines("_gt", "ground_truth"),
        F.col("_own").alias("downstream_specific_gt_cleaned_hunks"), diff.hunk_count(F.col("_own")).alias("downstream_specific_gt_hunk_count"), *lines("_own", "downstream_specific_gt"),
        say("c.llm_output_valid", False).alias("fc_llm_output_valid_overall"), say("c.attempts_made", 0).cast("bigint").alias("fc_attempts_made_overall"), say("c.error", "").alias("fc_error_overall"),
        say("c.last_format_error", "").alias("fc_last_format_error_overall"), say("c.last_apply_error", "").alias("fc_last_apply_error_overall"), say("c.runtime_seconds", 0.0).alias("fc_runtime_total_sec"),
        F.col("c.validation_results").alias("_attempts"),
    )
    names = [c for c in own.columns if c != "_attempts"]
    none = F.col("_a").isNull()
    tried = lambda field, default, untried: F.when(none, F.lit(untried)).otherwise(F.coalesce(F.col(f"_a.{field}"), F.lit(default)))
    return reshape.attempts(own, "_attempts", names).select(
        *names, F.col("attempt_number").cast("int").alias("attempt_number"), tried("format_valid", False, False).alias("attempt_format_valid"), tried("format_error", "", UNTRIED).alias("attempt_format_error"),
        tried("apply_valid", False, False).alias("attempt_apply_valid"), tried("apply_error", "", UNTRIED).alias("attempt_apply_error"), tried("valid", False, False).alias("attempt_valid_overall"), tried("runtime_seconds", 0.0, 0.0).alias("attempt_runtime_sec"),
    )


CONFLICT_KEY = ["vulnerability_id", "downstream_version", "target_file_name"]
#: What data_summary() reads of the table of attempts.
SUMMED_UP = ["system_prompt", "base_task_prompt", *CONFLICT_KEY, "fc_llm_output_valid_overall", "attempt_valid_overall", "attempt_format_error", "attempt_apply_error"]


def coerced(attempts: DataFrame) -> DataFrame:
    """The table of attempts as it is analysed: prompts and keys as labels, flags that are never null, empty errors as none."""
    flags = ("fc_llm_output_valid_overall", "attempt_valid_overall", "attempt_format_valid", "attempt_apply_valid")
    labels = ["system_prompt", "base_task_prompt", *CONFLICT_KEY]
    errors = ("attempt_format_error", "attempt_apply_error")
    return attempts.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags if c in attempts.columns} | {c: filters.label(F.col(c)) for c in labels} | {c: F.nullif(F.col(c), F.lit("")) for c in errors if c in attempts.columns})


def prompt_rates(attempts: DataFrame) -> DataFrame:
    """Distinct conflicts and successful ones (by the conflict's own outcome) of each pair of prompts."""
    return agg.rate_by_pair(coerced(attempts), ["system_prompt", "base_task_prompt"], CONFLICT_KEY, F.col("fc_llm_output_valid_overall"))


def overall_rate(attempts: DataFrame) -> DataFrame:
    return agg.overall_rate(coerced(attempts), CONFLICT_KEY, F.col("fc_llm_output_valid_overall"))


def data_summary(attempts: DataFrame, prompts: int = 3, errors: int = 3) -> DataFrame:
    """The summary of a table of attempts as lines of text: section, position, line.

    Sections: 1 overall, 2 the worst pairs of prompts, 3 and 4 the commonest errors of format and of application among
    failed attempts. Null messages are no errors; noise goes after the commonest are taken.
    """
    rows = coerced(attempts)
    two = lambda c: F.format_string("%.2f", c)
    rate = overall_rate(attempts)
    told = (
        F.concat(F.lit("- Total unique file conflicts processed: "), F.col("conflicts").cast("string")), F.concat(F.lit("- Successfully resolved file conflicts: "), F.col("successful").cast("string")),
        F.concat(F.lit("- Overall success rate per file_conflict: "), two(F.col("success_rate")), F.lit("%")),
    )
    one = rate.select(F.posexplode(F.array(*told)).alias("_p", "line")).select(F.lit(1).alias("section"), (F.col("_p") + 1).alias("position"), "line")
    worst = agg.top(prompt_rates(attempts), prompts, F.asc("success_rate"), F.asc("system_prompt"), F.asc("base_task_prompt"))
    said = F.concat(F.lit("System: '"), text.shortened(F.col("system_prompt"), 100), F.lit("', Base: '"), text.shortened(F.col("base_task_prompt"), 150), F.lit("' Success Rate: "), two(F.col("success_rate")), F.lit("% over "), F.col("conflicts").cast("string"), F.lit(" unique file conflicts."))
    out = one.unionByName(worst.select(F.lit(2).alias("section"), F.col("rank").cast("int").alias("position"), said.alias("line")))
    failed = rows.filter(~F.col("attempt_valid_overall"))
    for section, column in ((3, "attempt_format_error"), (4, "attempt_apply_error")):
        found = agg.top_errors(failed, column, errors)
        numbered = agg.top(found.withColumnRenamed(column, "message"), errors, F.desc("n"), F.asc("message"))
        line = F.concat(F.lit('- "'), text.shortened(F.trim("message"), 100), F.lit('": '), F.col("n").cast("string"), F.lit(" times"))
        out = out.unionByName(numbered.select(F.lit(section).alias("section"), F.col("rank").cast("int").alias("position"), line.alias("line")))
    return out


def pipeline_summary(parsed: DataFrame, fetch_failures: DataFrame, applied: DataFrame, forwarded: DataFrame, repaired: DataFrame, generated: DataFrame) -> dict[str, DataFrame]:
    """The final summary of a run from its reports: totals, breakdowns and lists.

    parsed, fetch_failures, applied, forwarded and repaired: a row each patch or file of that report; generated: the
    report of repairs (summary with failed_patches_list and token totals).
    """
    lists = generated.select(F.explode("summary.failed_patches_list").alias("f")).select("f.*")
    tokens = generated.select(*(F.coalesce(F.sum(f"summary.total_{t}tokens"), F.lit(0)).alias(f"llm_total_{t}tokens") for t in ("input_", "output_", "")))
    count = lambda df, name, c=None: df.agg((F.count("*") if c is None else agg.count_if(c)).alias(name))
    totals = count(parsed, "total_patches_from_vanir")
    for part in (
        count(fetch_failures, "total_fetch_failures"), count(applied, "total_patches_for_application"), count(applied, "patches_applied_directly", agg.applied()), count(forwarded, "patches_forwarded_to_llm"),
        count(repaired, "patches_successfully_fixed_by_llm", agg.applied()), count(repaired, "llm_application_failures", ~agg.applied() & (F.col("status") == "Rejected")), count(lists, "llm_generation_failures"), tokens,
    ):
        totals = totals.crossJoin(part)
    done = F.col("patches_applied_directly") + F.col("patches_successfully_fixed_by_llm")
    summary = totals.select(
        "*", done.alias("total_successful_patches"), (F.col("patches_forwarded_to_llm") - F.col("patches_successfully_fixed_by_llm")).alias("total_failed_patches"),
        agg.rate_text(done, F.col("total_patches_for_application")).alias("application_success_rate"), agg.rate_text(done, F.col("total_patches_from_vanir")).alias("pipeline_success_rate"),
    )
    upstream = forwarded.select(F.coalesce("detailed_status", F.lit("Unknown Error")).alias("error_type"), "patch_file", "project", text.stripped(F.col("message_output")).alias("error_message"))
    failed = agg.breakdown(repaired, lists)
    each = lambda df: df.groupBy("error_type").agg(F.count("*").alias("n"))
    return {"summary": summary, "fetch_failures": fetch_failures, "upstream_failures": upstream, "upstream_breakdown": each(upstream), "llm_failures": failed, "llm_breakdown": each(failed)}


def console_lines(summary: DataFrame) -> DataFrame:
    """A one-row summary as lines, `name: value`, in the order of its columns."""
    lines = [F.struct(F.lit(i).alias("position"), F.concat(F.lit(f"{c.replace('_', ' ')}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))).alias("line")) for i, c in enumerate(summary.columns)]
    return summary.select(F.explode(F.array(*lines)).alias("x")).select("x.*")


def successes(results: DataFrame) -> DataFrame:
    """Repairs that succeeded and were saved, as patches of a next run."""
    saved = F.coalesce("saved_patch_file", F.lit("")) != ""
    return results.filter(F.coalesce("success", F.lit(False)) & saved).select(F.col("saved_patch_file").alias("patch_file"), F.lit(None).cast("string").alias("patch_url"), F.lit("LLM").alias("source"), "project")
