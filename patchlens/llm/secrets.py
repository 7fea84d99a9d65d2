"""Secret scans through a trigram inverted index, by DataFrame functions alone.

A Boolean query over lower-cased trigrams is derived from each rule's pattern: every text that the rule matches
satisfies it. The trigrams of all queries are indexed: postings by (segment, trigram), a segment being a hash range of
about SEGMENT rows, so a posting list is bounded however common its trigram. Queries are evaluated by intersecting and
uniting postings, candidates are verified with the pattern, and rules without mandatory trigrams scan every text.

Candidates up to BROADCAST rows are broadcast to the scan that verifies; beyond that texts and candidates are shuffled,
but for the rows that repeat most, which stay where they are read and meet a broadcast.
Rows are named by a hash in the index. It only says where rules are tried: a text's spans are always found in that text.

Null texts count as empty and have no spans. Equal texts have equal spans, equal rows are separate rows. An empty table
gives no rows. A long text, or one with many matches, costs time in proportion to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import LEAST, hottest, lookup
from .spans import SPAN, duck_spans, duck_written, matches, placed, written

#: Rows of an index segment, about.
SEGMENT = 4096
#: Candidates that are broadcast at most.
BROADCAST = 500_000
#: Strings that a run of literals may stand for, and members of a class that counts as literals.
STRINGS, MEMBERS = 64, 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A group and the length that it must have; shorter matches are dropped.
    group: int = 0
    least: int = 0


#: The base patterns are given, the public formats of issued keys are their issuers'.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    # a match is a maximal run: asking for the length inside finds the same ones
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abposr]-[A-Za-z0-9-]{10,}"),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: A query: a trigram, or ("and" | "or", frozenset of queries); None holds for every text.
Query = str | tuple | None


def both(parts: list[Query]) -> Query:
    parts = {p for p in parts if p is not None}
    parts = {q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])}
    return None if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def either(parts: list[Query]) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    members = lambda q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q])
    # what holds only where another alternative holds too adds nothing
    distinct = set(parts)
    kept = {p for p in distinct if not any(members(q) < members(p) for q in distinct)}
    return next(iter(kept)) if len(kept) == 1 else ("or", frozenset(kept))


def of_strings(strings: set[str]) -> Query:
    return either([both([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def members(items: list) -> set[str] | None:
    """The few lower-cased characters of a class, or None."""
    out = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MEMBERS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MEMBERS else None


def analyse(nodes) -> tuple[set[str] | None, Query]:
    """(all strings that the nodes match, lower-cased, if few; the query that any match satisfies)."""
    run, done, whole = {""}, [], True
    for kind, value in nodes:
        strings, query = None, None
        if kind is op.LITERAL:
            strings = {chr(value).lower()}
        elif kind is op.IN:
            strings = members(value)
        elif kind is op.SUBPATTERN:
            strings, query = analyse(value[3])
        elif kind is op.BRANCH:
            each = [analyse(b) for b in value[1]]
            if all(s is not None for s, _ in each) and len(found := set().union(*(s for s, _ in each))) <= STRINGS:
                strings = found
            else:
                query = either([q if s is None else of_strings(s) for s, q in each])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, body = value
            strings_in, query_in = analyse(body)
            if strings_in is not None and most != op.MAXREPEAT and most <= 2:
                strings = set().union(*({"".join(p) for p in product(strings_in, repeat=n)} for n in range(least, most + 1)))
            elif least:
                query = query_in if strings_in is None else of_strings(strings_in)
        elif kind is op.AT:
            strings = {""}
        if strings is not None and len(joined := {a + b for a in run for b in strings}) <= STRINGS:
            run = joined
            continue
        done += [of_strings(run), query if strings is None else of_strings(strings)]
        run, whole = {""}, False
    return (run, of_strings(run)) if whole else (None, both([*done, of_strings(run)]))


def trigram_query(pattern: str) -> Query:
    return analyse(parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def answered(query: Query, postings: Column) -> Column:
    """Rows of a segment that satisfy a query; postings: map of trigram to rows."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(postings, F.lit(query)), F.array().cast("array<bigint>"))
    parts = [answered(q, postings) for q in sorted(query[1], key=repr)]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and rid, a hash of both."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))


def build_index(rows: DataFrame, terms: list[str], segments: int) -> DataFrame:
    """The inverted index: segment, trigram, rids."""
    low = rows.select("rid", F.lower("text").alias("low"))
    hits = low.select("rid", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("low"), t))).alias("trigram"))
    return hits.groupBy(F.pmod("rid", F.lit(segments)).alias("segment"), "trigram").agg(F.collect_set("rid").alias("rids"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """rid and the kinds whose queries it satisfies."""
    segment = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rids"))).alias("postings"))
    each = [F.struct(F.lit(kind).alias("kind"), answered(q, F.col("postings")).alias("rids")) for kind, q in queries.items()]
    answers = segment.select(F.explode(F.array(*each)).alias("a")).select("a.kind", F.explode("a.rids").alias("rid"))
    return answers.groupBy("rid").agg(F.collect_set("kind").alias("kinds"))


def spans_of(df: DataFrame, rules: tuple[Rule, ...], ranks: dict[str, int], kinds: Column | None) -> DataFrame:
    """Adds `spans`: all spans of the rules, each rule tried where kinds (null: everywhere) names it."""
    none = F.array().cast("array<string>")
    for r in rules:
        tried = F.lit(True) if kinds is None else F.coalesce(F.array_contains(kinds, r.kind), F.lit(False))
        df = df.withColumn(f"_m_{r.kind}", F.when(tried, matches(F.col("text"), r.pattern)).otherwise(none))
    keep = lambda r: F.transform(matches(F.col("text"), r.pattern, r.group), lambda g: F.length(g) >= r.least) if r.least else None
    found = [placed(F.col("text"), r.pattern, F.col(f"_m_{r.kind}"), ranks[r.kind], r.kind, keep(r)) for r in rules]
    df = df.withColumn("spans", F.array_sort(F.concat(*found)) if found else F.array().cast(SPAN))
    return df.drop(*(f"_m_{r.kind}" for r in rules))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, text and spans (start, rank of the rule, kind, end), in order, of each row of docs."""
    rows = prepared(docs)
    ranks = {r.kind: i for i, r in enumerate(rules)}
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    fully = tuple(r for r in rules if r.kind not in indexed)
    if not indexed:
        return spans_of(rows, fully, ranks, None).select("doc_id", "text", "spans")
    terms = sorted(set().union(*map(trigrams, indexed.values())))
    segments = max(1, math.ceil(rows.count() / SEGMENT))
    index = cut(build_index(rows, terms, segments))
    found = cut(candidates(index, indexed))
    # the other rules are tried where a query was satisfied; rows that share a hash by chance are only tried in vain
    each = F.concat(F.coalesce("kinds", F.array().cast("array<string>")), F.array(*(F.lit(r.kind) for r in fully)).cast("array<string>"))
    if found.count() <= broadcast:
        named = rows.join(F.broadcast(found), "rid", "left")
    else:  # equal rows share a rid: those of the most rows meet a broadcast, where they lie
        many = cut(rows.groupBy("rid").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).join(found, "rid", "left"))
        named = lookup(rows, cut(found.withColumn("n", F.lit(0).cast("bigint"))), "rid", hottest(many, "n"), "left").drop("n")
    named = named.withColumn("kinds", each)
    return spans_of(named, rules, ranks, F.col("kinds")).select("doc_id", "text", "spans")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def duck_sql() -> str:
    """The digest of all documents in DuckDB."""
    def one(i: int, r: Rule) -> str:
        groups = f"regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group})"
        return duck_spans(r.pattern, i, r.kind, f"length(({groups})[i]) >= {r.least}" if r.least else "true")

    every = ", ".join(one(i, r) for i, r in enumerate(RULES))
    counts = ", ".join(f"len(list_filter(found, lambda s: s.kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS (SELECT doc_id, list_sort(flatten([{every}])) AS found FROM texts)
SELECT doc_id, {counts}, sha256({duck_written(f"list_filter(found, lambda s: s.rank < {len(BASE)})")}) AS base_sha256, {duck_written("found")} AS spans
FROM spans"""
