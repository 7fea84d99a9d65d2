"""Schemas of the reports, as DDL. Names and their order are those of the reports. Objects whose keys are data are maps: inference would make a field of each key."""

from __future__ import annotations

SCANNER = "covered_cves array<string>, missing_patches array<struct<ID string, details array<struct<patch string, unpatched_code string>>>>"
PATCH = "patch_url string, patch_file string, project string, commit_date string, files map<string, struct<functions: array<string>>>"
PARSED = f"patches array<struct<{PATCH.replace(' string', ': string').replace(' map<', ': map<')}>>"
GROUPED_RECORD = "file string, patches array<struct<patch_url string, patch_file string, project string, commit_date string>>"
GROUPED = f"grouped_patch_records array<struct<{GROUPED_RECORD}>>"
FETCH_FAILURE = "url string, reason string, commit_date string"
REJECTED_FILE = "struct<failed_file string, reject_file string, rej_content string>"
APPLIED = f"patches array<struct<patch_file string, patch_url string, source string, project string, status string, detailed_status string, message_output string, upstream_patch_content string, rejected_files array<{REJECTED_FILE}>>>"
TOKENS = "struct<general struct<word_based bigint, char_based bigint>>"
ATTEMPT = "struct<attempt int, format_valid boolean, format_error string, apply_valid boolean, apply_error string, valid boolean, error string, runtime_seconds double>"
REPAIRED = f"""summary struct<total_patches_processed bigint, successful_patches bigint, failed_patches bigint, failed_patches_list array<struct<patch_file string, project string, error string>>,
total_input_tokens bigint, total_output_tokens bigint, total_tokens bigint>, results array<struct<success boolean, patch_hash string, file string, output_path string, project string, original_file string,
saved_patch_file string, token_counts struct<input bigint, output bigint, total bigint>, validation_results array<{ATTEMPT}>>>"""
OSV = """id string, aliases array<string>, published string, affected array<struct<package struct<name string>, versions array<string>,
ecosystem_specific struct<severity string, spl string, fixes array<string>>>>"""
CONFLICT = f"""struct<file_name string, total_hunks int, failed_hunks array<int>, inline_merge_conflicts array<struct<hunk_number int, merge_conflict string, merge_conflict_tokens {TOKENS}>>,
inline_merge_token_summary struct<word_based bigint, char_based bigint>, rej_file_content string, rej_file_tokens {TOKENS}, upstream_file_content string, upstream_file_tokens {TOKENS},
downstream_file_content string, downstream_file_tokens {TOKENS}, reason string, llm_output_valid boolean, attempts_made bigint, error string, last_format_error string, last_apply_error string,
runtime_seconds double, validation_results array<{ATTEMPT}>>"""
RESULT = f"struct<downstream_version string, branch_used string, downstream_patch string, repo_path string, result string, reason string, downstream_patch_content string, downstream_patch_tokens {TOKENS}, file_conflicts array<{CONFLICT}>>"
FAILURES = f"""summary struct<total_downstream_patch_failures bigint, system_prompt string, base_task_prompt string>, failures array<struct<id string, vulnerability_url string, severity string,
failures array<{RESULT}>, upstream_patch_content string, upstream_commits array<string>, upstream_patch_tokens {TOKENS}>>"""
EVALUATED = f"""id string, aliases array<string>, vulnerability_url string, severity string, patch_attempts array<struct<upstream_commits array<string>, upstream_branch_used string, upstream_patch_content string,
upstream_patch_tokens {TOKENS}, total_downstream_versions_tested bigint, successful_patches bigint, failed_patches bigint, patch_results array<{RESULT}>>>,
cross_patch_attempts array<struct<`from` string, `to` string, result string, patch_output string, reason string>>"""
GROUPS = ("vulnerabilities_with_all_failures", "vulnerabilities_with_partial_failures", "vulnerabilities_with_all_successful_patches")
FAILURE_LOG = "run_timestamp string, target_downstream_version string, skipped_or_errored_diff_generation_log array<struct<vulnerability_id string, file_name string, patch_sha string, reason string, last_format_error string, last_apply_error string>>"
#: Columns of the table of attempts, in the order in which it is written.
ATTEMPTS_CSV = """json_file_source string, system_prompt string, base_task_prompt string, vulnerability_id string, downstream_version string, target_file_name string, original_patch_total_hunks_for_file bigint,
original_patch_failed_hunk_numbers string, rej_file_reported_hunk_count bigint, rej_file_actual_hunk_count bigint, rej_file_total_lines bigint, rej_file_added_lines bigint, rej_file_removed_lines bigint,
ground_truth_hunk_count bigint, ground_truth_total_lines bigint, ground_truth_added_lines bigint, ground_truth_removed_lines bigint, downstream_specific_gt_cleaned_hunks string, downstream_specific_gt_hunk_count bigint,
downstream_specific_gt_total_lines bigint, downstream_specific_gt_added_lines bigint, downstream_specific_gt_removed_lines bigint, fc_llm_output_valid_overall boolean, fc_attempts_made_overall bigint,
fc_error_overall string, fc_last_format_error_overall string, fc_last_apply_error_overall string, fc_runtime_total_sec double, attempt_number int, attempt_format_valid boolean, attempt_format_error string,
attempt_apply_valid boolean, attempt_apply_error string, attempt_valid_overall boolean, attempt_runtime_sec double"""
