"""Expressions over patch addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two hosts that addresses are told apart by.
TREE_HOST, FORGE_HOST = "android.googlesource.com", "git.codelinaro.org"


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def commit_hash(url: Column) -> Column:
    """The first run of 40 hex digits, null without one."""
    return F.nullif(F.regexp_extract(url, "([a-fA-F0-9]{40})", 1), F.lit(""))


def project(url: Column) -> Column:
    """Project path by host; null for other hosts."""
    where = path(url)
    before = F.when(F.contains(host(url), F.lit(TREE_HOST)), F.regexp_extract(where, r"(.+?)/\+/", 1)).when(F.contains(host(url), F.lit(FORGE_HOST)), F.regexp_extract(where, "(.+?)/-/commit/", 1))
    # only the first /platform/ goes, and only a leading /clo/la/
    tree = F.regexp_replace(before, "^(.*?)/platform/", "$1")
    forge = F.regexp_replace(before, "^/clo/la/", "")
    return F.nullif(F.trim(F.when(F.contains(host(url), F.lit(TREE_HOST)), tree).otherwise(forge), F.lit("/")), F.lit(""))


def fix_commit(url: Column, parity: bool = True) -> Column:
    """What follows the last /+/ without a tail of ^ and !; repaired: the hash where the address has no /+/."""
    last = F.rtrim(F.element_at(F.split(path(url), r"/\+/"), -1), F.lit("^!"))
    return last if parity else F.coalesce(F.when(F.contains(url, F.lit("/+/")), last), commit_hash(url))


def repository(package: Column) -> Column:
    return F.when(package.startswith("platform/"), F.concat(F.lit(f"https://{TREE_HOST}/"), package))


def download(url: Column) -> Column:
    """Where a patch's diff is fetched; null for other hosts."""
    return F.when(F.contains(host(url), F.lit(TREE_HOST)), F.concat(url, F.lit("^!/?format=TEXT"))).when(F.contains(host(url), F.lit(FORGE_HOST)), F.concat(url, F.lit(".diff")))


def branch(version: Column) -> Column:
    return F.concat(F.lit("android"), version, F.lit("-release"))


def vulnerability_page(id_: Column) -> Column:
    return F.concat(F.lit("https://api.osv.dev/v1/vulns/"), id_)


def failures_report(report: Column) -> Column:
    """Where the failures of a report go."""
    return F.replace(report, F.lit(".json"), F.lit("_failures.json"))


def commit_query(url: Column) -> Column:
    """Where the forge tells of a commit: its address needs four path segments and 7 to 40 hex digits; null without."""
    found = lambda group: F.regexp_extract(path(url), r"^/([^/]+/[^/]+/[^/]+/[^/]+)/-/commit/([a-f0-9]{7,40})", group)
    whole = F.concat(F.lit(f"https://{FORGE_HOST}/api/v4/projects/"), F.replace(F.url_encode(found(1)), F.lit("+"), F.lit("%20")), F.lit("/repository/commits/"), found(2))
    return F.when(found(2) != "", whole)


def generated_patch(commit: Column, file: Column, made: Column) -> Column:
    """The name of a generated patch file."""
    return F.concat(commit, F.lit("_"), F.substring_index(file, "/", -1), F.lit("_"), F.date_format(made, "yyyyMMdd_HHmmss"), F.lit(".diff"))
