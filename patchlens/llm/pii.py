"""Personal data by weak supervision, by DataFrame functions alone.

Base kinds are found by their patterns and always stay. Further candidates (national numbers, accounts, local phone
numbers, addresses, names) come from one wider pattern. Labelers vote on every candidate, for, against or not at all:
the shape of the match, gazetteers, words before it, other personal data around it, and signs against it.
Expectation-maximisation over the histogram of vote patterns (bounded: KINDS * 3^5 * 3 rows, counted over all documents)
estimates the labelers' reliabilities without any labels. A span classifier then reads the span itself: the shape of its
characters, how it begins and ends and the words on either side, hashed into BUCKETS logistic weights. Its odds are those
before any vote, which each vote changes by the labeler's reliability; by turns it is trained on the posteriors that
follow, and these on it (a few rounds on a bounded sample), so that it also finds spans on which no labeler votes.
Candidates with a final probability of at least 0.5 become spans where they overlap no base span.

The sample is SAMPLE candidates a kind at most, the first by a hash; the counts of votes cover all documents.

Null texts count as empty and have no spans. Equal texts have equal spans, equal rows are separate rows. An empty table
gives no rows. A long text, or one with many matches, costs time in proportion to it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import bound, scanned
from .common import cut
from .spans import SPAN, between, chunks, matches, written

#: The given patterns, in a form that never looks at a character run twice. A run's first character
#: (or the end of the last match, \G) is its only start, and runs that nothing can follow from inside are possessive.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = ("email", "ip", "card", "phone")
MORE = ("national", "account", "local", "address", "person")
KINDS = BASE + MORE
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Square|Court|Way"
WIDE = (
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
    r"|(?<![0-9+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
    rf"|(?<![0-9])[0-9]{{1,5}} (?:[A-Z][a-z]{{1,20}} ){{1,3}}(?:{STREETS})(?![A-Za-z])"
    r"|(?<!\p{L})\p{Lu}\p{Ll}{1,20}(?: \p{Lu}\p{Ll}{1,20}){1,2}(?!\p{L})"
)
#: Given names that are common in public registers of births (a gazetteer, which a caller may replace),
#: words of streets, and cues.
NAMES = (
    "james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony mark steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan "
    "jacob gary nicholas eric stephen larry justin scott brandon benjamin samuel frank gregory raymond patrick alexander jack dennis jerry mary patricia jennifer linda elizabeth barbara susan jessica sarah karen "
    "nancy lisa betty margaret sandra ashley kimberly emily donna michelle carol amanda dorothy melissa deborah stephanie rebecca laura sharon cynthia kathleen amy angela anna ruth brenda pamela nicole katherine "
    "emma olivia sophia peter hans karl klaus wolfgang jürgen dieter manfred stefan andreas martin jens uwe ursula monika petra sabine renate helga karin brigitte ingrid erika andrea anja julia lena jean pierre "
    "michel andré philippe alain jacques bernard marcel rené louis claude marie jeanne françoise monique catherine nathalie isabelle sylvie jacqueline sophie claire camille antonio josé manuel francisco juan jesús "
    "javier carlos miguel alejandro pedro luis pablo maría carmen josefa isabel dolores pilar teresa ana cristina lucía paula elena rosa"
).split()
STREET_NAMES = "main|oak|park|church|high|station|mill|maple|washington|lake|hill|elm|pine|cedar|view|river|spring|north|south|east|west|king|queen|victoria|green|bridge|school|market|union|center|broad|forest|sunset|ridge|walnut|chestnut|meadow|garden"
#: What speaks for and against the shape of a match of a base kind.
SHAPES = {
    "email": (r"\.(?:com|org|net|edu|gov|info|biz|io|eu|uk|de|fr|es|it|nl|ch|at|be|ca|au|jp|br|in)$", r"(?i)^(?:no-?reply|postmaster|webmaster|admin|info|support|abuse|root)@"),
    "ip": (r"^(?!0)", r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."),
    "card": (r"^(?:4|5[ -]?[1-5]|3[ -]?[47]|6[ -]?0[ -]?1[ -]?1|6[ -]?5)", r"^(?:0|9)"),
    "phone": (r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+0"),
}
NOT_NAMES = "the and of in on for with this that from by is are was a an to it at as monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december der die das und le la les et el los las y".split()
BEFORE = r"(?i)(?<!\p{L})(?:name|contact|call|phone|tel|mobile|fax|ssn|social security|iban|account|address|lives at|born|mr|mrs|ms|dr|herr|frau|monsieur|madame|señor|señora|e?mail|signed|regards)[^\p{L}]{0,3}$"
AROUND = r"@|\+[0-9]|[0-9]{4}"
AGAINST = r"(?i)(?:version|page|figure|section|isbn|issn|chapter|vol|no)[^\p{L}]{0,3}$"
LEFT, RIGHT = 40, 20
LABELERS = 5
#: Chances of a vote for, none and against, where there is personal data and where not, before any data are seen; and
#: for how many candidates that counts.
START = ((0.55, 0.40, 0.05), (0.05, 0.60, 0.35))
BELIEF = 20.0
ROUNDS, STEPS, RATE, RIDGE = 60, 150, 2.0, 1e-3
#: Hashed weights of the span classifier; candidates of each kind that it is trained on at most.
BUCKETS, SAMPLE = 4096, 2000
#: Candidates that a hashed feature needs in the sample: rarer ones weigh nothing. Rounds of training.
LEAST, TURNS = 20, 5
#: Votes as they are counted: for, none, against.
COLUMN = {1: 0, 0: 1, -1: 2}


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    back = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def around(text: Column, pattern: str, found: Column) -> Column:
    """start, end, match, left and right of each match: its place, and what stands before and after it."""
    kind = "array<struct<start:int,end:int,match:string,left:string,right:string>>"

    def of(gaps: Column) -> Column:
        ends = scanned(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), lambda a, b: a + b)
        one = lambda end, m, i: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"), F.right(F.get(gaps, i), F.lit(LEFT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(RIGHT)).alias("right"))
        return bound(ends, lambda at: F.transform(found, lambda m, i: one(F.get(at, i), m, i)))

    return F.when(F.size(found) > 0, bound(F.split(text, pattern, -1), of)).otherwise(F.array()).cast(kind)


def voted(kind: Column, s: Column, names: list[str]) -> list[Column]:
    """Each labeler's vote on a candidate: 1, 0 or -1."""
    vote = lambda yes, no=F.lit(False): F.when(no, -1).when(yes, 1).otherwise(0)
    words = F.split(F.lower(s["match"]), " ")
    person = kind == "person"
    shape = (
        F.when(kind == "email", vote(*(s["match"].rlike(p) for p in SHAPES["email"]))).when(kind == "ip", vote(*(s["match"].rlike(p) for p in SHAPES["ip"])))
        .when(kind == "card", vote(*(s["match"].rlike(p) for p in SHAPES["card"]))).when(kind == "phone", vote(*(s["match"].rlike(p) for p in SHAPES["phone"])))
        .when(kind == "national", vote(~s["match"].rlike("^(?:000|666|9)|-00-|-0000$"), s["match"].rlike("^(?:000|666|9)|-00-|-0000$")))
        .when(kind == "account", vote(s["match"].rlike("^(?:DE[0-9]{20}|FR[0-9]{12}[A-Z0-9]{11}[0-9]{2}|ES[0-9]{22}|GB[0-9]{2}[A-Z]{4}[0-9]{14}|NL[0-9]{2}[A-Z]{4}[0-9]{10})$")))
        .when(kind == "local", vote(s["match"].rlike(r"^\(?[2-9]"), s["match"].rlike(r"^\(?[01]")))
        .otherwise(0)
    )
    known = F.array(*map(F.lit, names))
    other = F.array(*map(F.lit, NOT_NAMES))
    listed = F.when(person, vote(F.array_contains(known, words[0]), F.arrays_overlap(words, other))).when(kind == "address", vote(F.lower(s["match"]).rlike(f"(?<![a-z])(?:{STREET_NAMES})(?![a-z])"), s["match"].rlike("^0"))).otherwise(0)
    repeated = person & (F.size(F.array_distinct(words)) < F.size(words))
    return [shape, listed, vote(s["left"].rlike(BEFORE)), vote((F.concat_ws(" ", s["left"], s["right"])).rlike(AROUND)), vote(F.lit(False), s["left"].rlike(AGAINST) | repeated)]


def features(kind: Column, s: Column) -> Column:
    """The span as its classifier sees it, hashed: shape, first and last characters, the words before and after."""
    shape = s["match"]
    for pattern, mark in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), ("[0-9]+", "0")):
        shape = F.regexp_replace(shape, pattern, mark)
    low = F.lower(s["match"])
    before, after = F.regexp_extract(F.lower(s["left"]), r"(\p{L}+)\P{L}*$", 1), F.regexp_extract(F.lower(s["right"]), r"^\P{L}*(\p{L}+)", 1)
    each = {"shape": F.left(shape, F.lit(16)), "first": F.left(low, F.lit(3)), "last": F.right(low, F.lit(3)), "before": before, "after": after}
    return F.array(*((F.crc32(F.concat_ws("|", F.lit(name), kind, value)) % BUCKETS).cast("int") for name, value in each.items()))


def described(kind: Column, s: Column, names: list[str]) -> Column:
    """A candidate as it is counted and judged: place, kind, votes and length class."""
    size = s["end"] - s["start"]
    votes = [v.cast("int").alias(f"v{i}") for i, v in enumerate(voted(kind, s, names))]
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), *votes, F.when(size < 12, 0).when(size < 20, 1).otherwise(2).alias("size"), features(kind, s).alias("seen"))


def candidates(docs: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """doc_id, text and what follows it in docs, with `base` and `wide`: arrays of described candidates."""
    text = F.col("text")
    df = docs.withColumn("text", F.coalesce(text.cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    guards = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    patterns = dict(zip(BASE, (EMAIL, IP, CARD, PHONE), strict=True)) | {"wide": WIDE}
    for kind, pattern in patterns.items():
        df = df.withColumn(f"_{kind}", F.when(guards.get(kind, F.lit(True)), matches(text, pattern)).otherwise(none))
    for kind, pattern in patterns.items():
        df = df.withColumn(f"_{kind}", around(text, pattern, F.col(f"_{kind}")))

    def sound(kind: str) -> Column:
        return F.transform(F.filter(f"_{kind}", lambda s: valid(kind, s["match"])), lambda s: described(F.lit(kind), s, names))

    def told(s: Column) -> Column:
        m = s["match"]
        kind = F.when(m.rlike("^[A-Z]{2}[0-9]{2}"), "account").when(m.rlike("^[0-9]{3}-[0-9]{2}-"), "national").when(m.rlike(r"^[0-9(].*[0-9]$"), "local").when(m.rlike("^[0-9]"), "address").otherwise("person")
        return described(kind, s, names)

    df = df.withColumn("base", F.concat(*map(sound, BASE))).withColumn("wide", F.transform("_wide", told))
    return df.drop(*(f"_{k}" for k in patterns))


def histogram(found: DataFrame) -> list[tuple]:
    """(kind, votes, length class, candidates) over all documents: a bounded number of rows."""
    votes = [f"c.v{i}" for i in range(LABELERS)]
    each = found.select(F.explode(F.concat("base", "wide")).alias("c")).groupBy("c.kind", *votes, "c.size").agg(F.count("*").alias("n"))
    return sorted((r["kind"], tuple(r[f"v{i}"] for i in range(LABELERS)), r["size"], r["n"]) for r in each.collect())


def estimate(counted: list[tuple]) -> tuple[list, list[float]]:
    """Expectation-maximisation: each labeler's [class][for, none, against], and the posterior of each row."""
    chance = [[list(START[0]), list(START[1])] for _ in range(LABELERS)]
    prior = {k: 0.5 for k in KINDS}
    posterior = [0.0] * len(counted)
    for _ in range(ROUNDS):
        votes = [[[BELIEF * p for p in START[y]] for y in (0, 1)] for _ in range(LABELERS)]
        share = {k: [1.0, 2.0] for k in KINDS}
        for i, (kind, pattern, _, n) in enumerate(counted):
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(chance[j][0][COLUMN[v]] / chance[j][1][COLUMN[v]]) for j, v in enumerate(pattern))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            share[kind][0] += n * posterior[i]
            share[kind][1] += n
            for j, v in enumerate(pattern):
                votes[j][0][COLUMN[v]] += n * posterior[i]
                votes[j][1][COLUMN[v]] += n * (1 - posterior[i])
        chance = [[[x / sum(row) for x in row] for row in v] for v in votes]
        prior = {k: min(1 - 1e-4, max(1e-4, a / b)) for k, (a, b) in share.items()}
    return chance, posterior


def sample(found: DataFrame, most: int = SAMPLE) -> list[tuple]:
    """(kind, votes, length class, hashed features, candidates) of at most `most` candidates a kind: the first by a hash."""
    each = found.select(F.explode(F.concat("base", "wide")).alias("c")).select("c.*")
    first = Window.partitionBy("kind").orderBy(F.xxhash64("seen", "start", "end"))
    few = each.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most)
    votes = [f"v{i}" for i in range(LABELERS)]
    counted = few.groupBy("kind", *votes, "size", "seen").agg(F.count("*").alias("n"))
    return sorted((r["kind"], tuple(r[v] for v in votes), r["size"], tuple(r["seen"]), r["n"]) for r in counted.collect())


def swayed(chance: list, votes: tuple) -> float:
    """What the votes add to a candidate's log odds."""
    return sum(math.log(chance[j][0][COLUMN[v]] / chance[j][1][COLUMN[v]]) for j, v in enumerate(votes))


def train(rows: list[tuple], chance: list) -> np.ndarray:
    """Logistic weights, BUCKETS of hashed features, then those of the kinds, from sample() and the labelers' chances.

    Each kind weighs alike.
    """
    weight = np.zeros(BUCKETS + len(KINDS))
    if not rows:
        return weight
    seen = np.array([(*r[3], BUCKETS + KINDS.index(r[0])) for r in rows])
    sway = np.array([swayed(chance, r[1]) for r in rows])
    count = np.array([r[4] for r in rows], float)
    common = np.bincount(seen.ravel(), np.repeat(count, seen.shape[1]), len(weight)) >= LEAST
    common[BUCKETS:] = True
    total = np.bincount(seen[:, -1] - BUCKETS, count, len(KINDS))
    share = count / (total[seen[:, -1] - BUCKETS] * np.count_nonzero(total))
    chances = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(TURNS):
        target = chances(weight[seen].sum(axis=1) + sway)
        for _ in range(STEPS):
            slope = np.bincount(seen.ravel(), np.repeat(share * (chances(weight[seen].sum(axis=1)) - target), seen.shape[1]), len(weight))
            weight -= RATE * common * (slope + RIDGE * weight / len(KINDS))
    return weight


def judged(weights: Column, chance: list, c: Column) -> Column:
    """The final probability as an expression; weights: those of train() as an array."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int")
    z = F.element_at(weights, F.lit(BUCKETS) + kind)
    for j in range(5):
        z = z + F.element_at(weights, c["seen"][j] + 1)
    for j in range(LABELERS):
        odds = [F.lit(math.log(chance[j][0][k] / chance[j][1][k])) for k in range(3)]
        z = z + F.when(c[f"v{j}"] == 1, odds[0]).when(c[f"v{j}"] == -1, odds[2]).otherwise(odds[1])
    return 1 / (1 + F.exp(-z))


def span(c: Column) -> Column:
    rank = F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int") - 1
    return F.struct(c["start"].alias("start"), rank.alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"))


def apart(base: Column, wide: Column) -> Column:
    """The candidates of wide that overlap no span of base: one look to the left and one to the right along both."""

    def of(every: Column) -> Column:
        end = scanned(F.transform(every, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(F.lit(-1))), F.greatest)
        start = F.reverse(scanned(F.reverse(F.transform(every, lambda e: F.when(e["own"] == 0, e["start"]).otherwise(F.lit(2**31 - 1)))), F.least))
        around = F.zip_with(end, start, lambda e, s: F.struct(e.alias("end"), s.alias("start")))
        free = F.zip_with(every, around, lambda c, a: F.when((c["own"] == 1) & (a["end"] <= c["start"]) & (a["start"] >= c["end"]), c["c"]))
        return F.array_compact(free)

    laid = lambda spans, own: F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.lit(own).alias("own"), c["end"].alias("end"), c.alias("c")))
    return F.when((F.size(base) > 0) & (F.size(wide) > 0), bound(F.array_sort(F.concat(laid(base, 0), laid(wide, 1))), of)).otherwise(wide)


def scan(docs: DataFrame, names: list[str] = NAMES, text: bool = True) -> DataFrame:
    """The columns of docs (a null text empty; a column `spans` gives way) and spans (start, rank of the kind, kind, end) by kind, then start.

    Without `text` that column is left out; what is kept of a row is then small, and stored between counting and judging,
    so that texts are read once instead of twice.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "spans" and (text or c != "text"))).alias("_row")
    found = candidates(docs.select("text", row), names)
    # what is counted and sampled is stored without texts: patterns run once for it, and, where texts are kept, once for these
    found = found if text else cut(found.drop("text"))
    seen = cut(found.select("base", "wide")) if text else found
    counted = histogram(seen)
    chance, _ = estimate(counted)
    weight = train(sample(seen), chance)
    # a table of one row: the weights are no part of the plan
    weights = docs.sparkSession.createDataFrame([(weight.tolist(),)], "_weights array<double>")
    found = found.crossJoin(F.broadcast(weights))
    added = apart(F.col("base"), F.filter("wide", lambda c: judged(F.col("_weights"), chance, c) >= 0.5))
    spans = F.transform(F.concat("base", added), span)
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    kept = F.col("_row").withField("text", F.col("text")) if text else F.col("_row")
    return found.select(kept.alias("_row"), ordered.cast(SPAN).alias("spans")).select("_row.*", "spans")


def masked(found: DataFrame) -> DataFrame:
    """text with every span (overlapping ones as one, by its first kind) replaced by <KIND>; spans go."""
    ordered = F.array_sort("spans")

    def groups(spans: Column) -> Column:
        """(start, end, kind) of each run of overlapping spans."""

        def of(reach: Column) -> Column:
            begins = F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
            upto = lambda heads, k: F.coalesce(F.get(heads, k + 1), F.size(spans)) - 1
            return bound(begins, lambda heads: F.transform(heads, lambda at, k: F.struct(F.get(spans, at)["start"].alias("start"), F.get(reach, upto(heads, k)).alias("end"), F.get(spans, at)["kind"].alias("kind"))))

        return bound(scanned(F.transform(spans, lambda s: s["end"]), F.greatest), of)

    def masked_text(parts: Column, runs: Column) -> Column:
        kept = F.transform(runs, lambda r, k: F.concat(between(parts, F.coalesce(F.get(runs, k - 1)["end"], F.lit(0)), r["start"]), F.lit("<"), F.upper(r["kind"]), F.lit(">")))
        return F.concat(F.array_join(kept, ""), between(parts, F.element_at(runs, -1)["end"], F.length("text")))

    text = bound(chunks(F.col("text")), lambda parts: bound(bound(ordered, groups), lambda runs: masked_text(parts, runs)))
    return found.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).drop("spans")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
