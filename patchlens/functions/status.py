"""Classifications of patch runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The statuses of reports.
APPLIED, REJECTED = "Applied Successfully", "Rejected"
CLEAN, OFFSETS, ALREADY = f"{APPLIED}: Clean", f"{APPLIED}: With Offsets", f"{APPLIED}: Already Applied"
HUNKS, ERROR, NO_FILES, UNKNOWN = f"{REJECTED}: Failed Hunks", f"{REJECTED}: Error Running Patch Command", "Skipped: Files Not Found", "Unknown Status"
NO_PROJECT, NO_DIRECTORY, NO_PATCH = f"{REJECTED}: Missing project path in report", f"{REJECTED}: Project directory not found", f"{REJECTED}: Missing Patch File"
REVERSED, NOT_FOUND = "Reversed (or previously applied) patch detected", "can't find file to patch"


def detailed(code: Column, output: Column) -> Column:
    """Detailed status by exit code first, then by what was printed."""
    said = F.coalesce(output, F.lit(""))
    has = lambda word: F.contains(said, F.lit(word))
    return (
        F.when(code == 0, F.when(has("offset"), OFFSETS).when(has(REVERSED), ALREADY).otherwise(CLEAN))
        .when(code == 1, HUNKS)
        .when(code > 1, F.when(has(NOT_FOUND), NO_FILES).otherwise(ERROR))
        .otherwise(F.when(has("FAILED"), HUNKS).otherwise(UNKNOWN))
    )


def overall(status: Column) -> Column:
    return F.when(F.contains(status, F.lit("Rejected")) | F.contains(status, F.lit("Skipped")), REJECTED).otherwise(APPLIED)


def precheck(project: Column, directory: Column, patch: Column) -> Column:
    """Why a patch is not tried at all, in this order; null if it is. directory, patch: whether they exist."""
    return F.when(F.coalesce(project, F.lit("")) == "", NO_PROJECT).when(~F.coalesce(directory, F.lit(False)), NO_DIRECTORY).when(~F.coalesce(patch, F.lit(False)), NO_PATCH)


def project_path(root: Column, project: Column) -> Column:
    return F.when(root.endswith(project), root).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), project))


def needs_repair(status: Column, detail: Column) -> Column:
    return F.coalesce((status == REJECTED) | F.contains(detail, F.lit("Failed Hunks")), F.lit(False))


#: What a passed validation says.
FORMAT_FINE, APPLY_FINE = "Valid patch format", "Patch applies cleanly in repo"


def feedback(format_error: Column, apply_error: Column) -> Column:
    """The advice that a failed attempt gets, in order: an array of format, hunks and apply, or none."""
    wrong = lambda c, fine: F.coalesce(c, F.lit("")).isin("", fine) == F.lit(False)
    hunks = F.lower(apply_error).rlike("hunk #|failed")
    kinds = F.array(F.when(wrong(format_error, FORMAT_FINE), "format"), F.when(wrong(apply_error, APPLY_FINE), F.when(hunks, "hunks").otherwise("apply")))
    kept = F.array_compact(kinds)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("none")))


def rotate_key(message: Column) -> Column:
    """Whether an error asks for another key."""
    return F.coalesce(F.lower(message).rlike("quota|rate limit|api key not valid|internal error"), F.lit(False))


def tri_state(successes: Column, failures: Column, total: Column) -> Column:
    return F.when(failures == total, "all_failures").when((successes > 0) & (failures > 0), "partial_failures").otherwise("all_successful")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; 0 for nothing of nothing."""
    return F.coalesce(F.round(F.try_divide(F.lit(100.0).cast("double") * part, whole), digits), F.lit(0.0))
