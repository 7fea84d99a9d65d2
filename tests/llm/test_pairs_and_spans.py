"""Near-duplicates, secrets, personal data and the pipeline: brute force, planted cases and odd inputs."""

import hashlib
import random
import re
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from patchlens.llm import embdedup, graph, pii, queries, secrets, simhash

SF = "/root/testdata/sf0.01"


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


# graph


def test_components_of_paths_stars_and_random(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(400)] + [(random.randint(2000, 2400), random.randint(2000, 2400)) for _ in range(300)] + [(5000, 5000), (-1, -2), (-1, -2)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    names = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(names)}
    want = roots(len(names), [(at[a], at[b]) for a, b in edges if a != b])
    assert set(got) == set(names)
    pairs = {(want[at[x]], got[x]) for x in names}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert graph.components(spark.createDataFrame([], "src bigint, dst bigint")).collect() == []


# fingerprints


def by_hand(text, n=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


TEXTS = [None, "", " \t\n", "One", "one two", "ÄB c d e", "a b c a b c a b c", "x " * 3000, "A B C D", "a b c d", "q\x1cr s t"]


def test_fingerprints_by_hand():
    texts = TEXTS + [d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()[:60]]
    for t in texts:
        assert int(simhash.fingerprint((t or "").encode())[0]) == by_hand(t)


def test_spark_hash_is_the_same(spark):
    want = np.array([xxhash.xxh64_intdigest("añb c d", 42)], np.uint64).view(np.int64)[0]
    assert spark.range(1).select(F.xxhash64(F.lit("añb c d"))).first()[0] == want


@pytest.mark.parametrize("words, reach", [(1, 3), (1, 8), (2, 24)])
def test_trees_find_all_links(words, reach):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (60, words), dtype=np.uint64)
    points = np.repeat(base, 50, 0)
    for _ in range(reach + 2):  # clusters, far beyond the reach inside
        points[np.arange(len(points)), rng.integers(0, words, len(points))] ^= np.uint64(1) << rng.integers(0, 64, len(points)).astype(np.uint64)
    points = np.unique(points, axis=0)
    n = len(points)
    near = sum(np.bitwise_count(points[:, None, k] ^ points[None, :, k]).astype(int) for k in range(words)) <= reach
    want = roots(n, zip(*np.nonzero(near), strict=True))
    tree = simhash.Tree(points[:: max(1, n // 500)], 20)
    point, leaf, home = tree.route(points, reach)
    assert np.bincount(point[home], minlength=n).tolist() == [1] * n  # one home each
    links = []
    for x in np.unique(leaf):
        own = np.flatnonzero(leaf == x)
        found = simhash.forest(points[point[own]], home[own], reach)
        links += list(zip(point[own], point[own][found], strict=True))
    got = roots(n, links)
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_near_duplicates_by_hand(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "one"), (3, "One")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"node": F.lit(1), "f0": F.lit(2)})
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [by_hand(t) for _, t in rows]
    want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for (doc, _), r in zip(rows, want, strict=True):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    expected = sorted(((d, least[r]) for (d, _), r in zip(rows, want, strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == expected
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_all_documents_by_hand(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r["doc_id"]: r for r in queries.op7_simhash(spark, SF).collect()}
    prints = np.array([int(got[d["doc_id"]]["fingerprint"], 16) for d in docs], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    want = roots(len(docs), zip(*np.nonzero(near), strict=True))
    least = {}
    for d, r in zip(docs, want, strict=True):
        least[r] = min(d["doc_id"], least.get(r, d["doc_id"]))
    assert all(got[d["doc_id"]]["component_id"] == least[r] for d, r in zip(docs, want, strict=True))


# embeddings


def test_error_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 64)) * 10.0 ** rng.integers(-30, 30, (300, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    small, scale, size, lost = embdedup.quantise(x)
    about = (small.astype(float) @ small.astype(float).T) * np.outer(scale, scale)
    bound = lost[:, None] * (size + lost) + size[:, None] * lost
    assert (np.abs(unit @ unit.T - about) <= bound + 1e-12).all()


def test_embeddings_by_hand(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    rows = []
    for i in range(600):
        v = centres[rng.integers(30)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(3))))
    rows += [(600 + i, [float(x) for x in np.float32(centres[0])], 1) for i in range(150)]  # copies
    bad = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, rows[0][1], None), (1005, [], 1), (1006, [float("inf")] * 16, 1), (1007, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id bigint, embedding array<float>, label int, node string")
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(df, block=100).collect()}
    assert len(got) == len(rows) + len(bad)
    x = np.array([r[1] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    want = roots(len(rows), zip(*np.nonzero(near), strict=True))
    least = {}
    for i, r in enumerate(want):
        least.setdefault(r, i if i < 600 else i)
    for i, r in enumerate(want):
        row = got[rows[i][0]]
        first = rows[min(j for j, s in enumerate(want) if s == r)][0] if near[i].any() else rows[i][0]
        assert (row["n_links"], row["component_id"], row["kept"]) == (near[i].sum(), first, first == rows[i][0])
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _, _ in bad)
    assert embdedup.near_duplicates(df.limit(0)).collect() == []


# secrets


SECRETS = [
    None, "", "none", 'password = "abcdefghijkl" x', "token=short TOKEN: 'ABCDEFGHIJKLMNOP'", "secret=token:abcdefghijklmnop", "api_key=abc apikey:0123456789abcdef01", "AKIA" + "A" * 14 + " AKIAAKIA" + "B" * 20,
    "deadbeefdeadbeef0", "DEADBEEFdeadbeef", "é😀 password=éabcdefghijklmn passwd:abcdefghijklmn", "token:=abcdefghijklmn", "ghp_" + "a" * 36, "xoxb-0123456789-abc", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM",
    "sk_live_" + "a1" * 10 + " AIza" + "b" * 35, "secret='" + "x" * 40_000, "0123456789abcdef" * 400, "token=aaaaaaaaaaaa" * 300,
]


def secrets_by_hand(text):
    text = text or ""
    out = []
    for rank, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_secrets_by_hand(spark, broadcast):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(3, "another row of id 3 AKIA" + "Z" * 16), (4, SECRETS[4]), (None, "password=abcdefghijklmn")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"rid": F.lit(1), "kinds": F.lit("x"), "spans": F.lit("y")})
    got = secrets.scan(docs, broadcast=broadcast).collect()
    mine = sorted(((r["doc_id"], r["text"], [tuple(s) for s in r["spans"]]) for r in got), key=repr)
    assert mine == sorted(((i, t or "", secrets_by_hand(t)) for i, t in rows), key=repr)
    assert secrets.scan(docs.limit(0), broadcast=broadcast).collect() == []


def test_given_patterns_are_the_base(spark):
    """The base rules ask for lengths inside; the given patterns drop short matches after."""
    for text in SECRETS:
        text = text or ""
        for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)):
            given = [m.span() for m in re.finditer(pattern, text) if len(m[0]) >= least]
            assert given == [(s, e) for s, _, k, e in secrets_by_hand(text) if k == kind]


def holds(query, text):
    if query is None or isinstance(query, str):
        return query is None or query in text
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


def test_trigram_queries_miss_nothing():
    for text in SECRETS:
        for rule in secrets.RULES:
            if re.search(rule.pattern, text or ""):
                assert holds(secrets.trigram_query(rule.pattern), text.lower())
    assert secrets.trigram_query("[0-9a-f]{16,}") is None and secrets.trigram_query("ab") is None
    assert secrets.trigram_query("abcd") == ("and", frozenset({"abc", "bcd"}))
    assert secrets.trigram_query("abc|xyz") == ("or", frozenset({"abc", "xyz"}))
    assert secrets.trigram_query("(abc)*x") is None and secrets.trigram_query("(abc)+x") == "abc"


# personal data


PERSONAL = [
    None, "", "nothing", "mail a.b@c.d_e@f.gh and x@y then z@@q.r.s. end", "1.2.3.4.5.6.7.8 999.1.1.1 010.001.255.0 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 1234567890123456789012", "+1 (683) 555-6293 +12 +1------2 +49 30 1234567 .",
    "é😀 +33 1 23 45 67 89 é a@b.c", "a" * 50_000 + "@b.c", "1" * 30_000, "1.1." * 5000, "a@" * 3000 + "b.c", "+1" * 4000, "x@y.z " * 500, "Contact Anna Smith, call (683) 555-6293 or 078-05-1120", "0 0 0 0 0 0 0 0 0 0 0 0 0",
]


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


GIVEN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)


def personal_by_hand(text, skip_slow=True):
    # on runs as long as these the given patterns are quadratic; what they find there is known
    out = []
    for kind, pattern, ok in GIVEN:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if ok(m[0])]
    return out


def test_personal_data_by_hand(spark, monkeypatch):
    if hasattr(sys, "set_int_max_str_digits"):
        monkeypatch.setattr(sys, "set_int_max_str_digits", sys.set_int_max_str_digits)
        sys.set_int_max_str_digits(0)
    rows = [(i, t) for i, t in enumerate(PERSONAL)] + [(3, "again c@d.e"), (None, "c@d.e"), (4, PERSONAL[4])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"base": F.lit("x"), "wide": F.lit("y"), "spans": F.lit("z"), "_email": F.lit(1)})
    found = pii.scan(docs)
    assert found.columns == ["doc_id", "text", "base", "wide", "_email", "spans"]
    got = {}
    for r in pii.digest(found).collect():
        got.setdefault((r["doc_id"], r["base_sha256"]), r)
    for i, t in rows:
        if t and len(t) > 20_000 and "1" * 100 in t:
            continue
        base = personal_by_hand(t)
        row = got[i, hashlib.sha256(",".join(base).encode()).hexdigest()]
        assert [s for s in row["spans"].split(",") if s.split(":")[0] in pii.BASE] == base
    long = next(r for r in pii.digest(found.filter("doc_id = 9")).collect())
    assert (long["n_card"], long["spans"]) == (0, "")
    assert pii.scan(docs.limit(0)).collect() == []


def test_reliabilities_are_learned():
    rng = random.Random(3)
    counted = {}
    for _ in range(5000):
        true = rng.random() < 0.3
        votes = tuple((1 if rng.random() < (0.9 if true else 0.05) else 0) if j < 3 else rng.choice((1, 0, -1)) for j in range(pii.LABELERS))
        key = ("person", votes, 1)
        counted[key] = counted.get(key, 0) + 1
    rows = [(*k, n) for k, n in sorted(counted.items())]
    chance, posterior = pii.estimate(rows)
    assert all(chance[j][0][0] > 0.7 and chance[j][1][0] < 0.25 for j in range(3))  # the good labelers
    assert abs(chance[4][0][0] - chance[4][1][0]) < 0.2  # a bad one
    # spans that look like the ones that the good labelers are for are taken, whatever is voted on them
    seen = {True: (1, 2, 3, 4, 5), False: (11, 12, 13, 14, 15)}
    weight = pii.train([(*r[:3], seen[sum(r[1][:3]) >= 2], r[3]) for r in rows], chance)
    score = lambda s: weight[list(s)].sum() + weight[pii.BUCKETS + pii.KINDS.index("person")]
    assert score(seen[True]) > 0 > score(seen[False])
    assert pii.estimate([])[1] == [] and not pii.train([], chance).any()


def test_masking(spark):
    rows = [(1, "é mail a@b.co now", None), (2, "4111 1111 1111 1111", "x"), (3, None, None), (4, "+1 (683) 555-6293 and 1.2.3.4", "y")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, extra string")
    got = {r["doc_id"]: r["text"] for r in pii.masked(pii.scan(docs)).collect()}
    assert got == {1: "é mail <EMAIL> now", 2: "<CARD>", 3: "", 4: "<PHONE> and <IP>"}
    spans = [(2, 0, "email", 6), (4, 1, "ip", 8), (10, 2, "card", 12)]
    df = spark.createDataFrame([(1, "0123456789abcdef", spans)], "doc_id int, text string, spans array<struct<start:int,rank:int,kind:string,end:int>>")
    assert pii.masked(df).first()["text"] == "01<EMAIL>89<CARD>cdef"


# pipeline


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("planted")
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()[:250]
    random.seed(8)
    good = {r["doc_id"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["quality"] == 1}
    clean = [d for d in docs if d["doc_id"] in good and len(d["text"].split()) > 150][:20]
    rows = [tuple(d.values()) for d in docs]
    for i, d in enumerate(clean[:10]):
        rows.append((5000 + i, d["text"], d["lang"], d["source"], d["n_chars"]))
        words = d["text"].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((6000 + i, " ".join(words), d["lang"], d["source"], d["n_chars"]))
    rows += [(7000, None, None, None, None), (7001, "", "en", "s", 0), (7002, "12 34", "en", "s", 5), (7003, "日本語の文章です。" * 20, None, None, None)]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, kinds).withColumns({"score": F.lit("own"), "_text": F.lit(1)}).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder), clean


def test_pipeline(spark, planted):
    folder, clean = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        if i < 4:
            assert docs.columns == columns, name
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert not seen[0] & {7000, 7001, 7002, 7003} and {d["doc_id"] for d in clean} <= seen[1]
    for i, d in enumerate(clean[:10]):
        assert len(seen[2] & {d["doc_id"], 5000 + i, 6000 + i}) <= 1
    bad = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}
    assert len(seen[1] & bad) <= 0.1 * len(seen[0] & bad) and len(seen[1] & good) >= 0.97 * len(seen[0] & good)
    masked = spark.read.parquet(f"{folder}/stage3")
    assert masked.filter(F.col("text").rlike(r"[a-z0-9]@mail\d")).count() == 0
    assert masked.filter("n_chars <> length(text)").count() == 0
    assert seen[3] == seen[2] == seen[4]


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0 and rows.count() > 0


# near copies


def shingled(text, n=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def kept_by_hand(texts):
    """Of texts by number: the smallest of each component of exact similarity 0.8 or more."""
    sets = [shingled(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0]
    return {min(i for i, r in enumerate(found) if r == root) for found in [roots(len(sets), links)] for root in set(found)}


def related():
    random.seed(12)
    fresh = lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]
    texts = []
    for share in (0.95, 0.92, 0.9, 0.88, 0.85, 0.8, 0.7, 0.6):
        for _ in range(6):
            base = fresh(300)
            # a run of fresh words at the end: similarity share / (2 - share)
            texts += [" ".join(base[: int(300 * share)] + fresh(300 - int(300 * share))) for _ in range(2)]
    line = " ".join(fresh(12))
    for _ in range(4):  # one line many times, around it different words or the same
        own = " ".join(fresh(60))
        texts += [f"{own} {line}", " ".join([own] + [line] * 40), " ".join([" ".join(fresh(60))] + [line] * 40)]
    base = fresh(200)
    for i in range(40):  # a group of near copies, whose ends drift apart, and others that only come near
        texts.append(" ".join(base[: 196 - 2 * (i % 4)] + fresh(4)))
        texts.append(" ".join(base[:170] + fresh(30)))
    return texts + [None, "", " \n", "one", "One", "one two"]


def test_near_copies_are_exact(spark, block=16):
    from patchlens.llm import copies

    texts = related()
    docs = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string").repartition(5)
    got = {r["key"] for r in copies.firsts(docs, corpus_pipeline.SHINGLE, corpus_pipeline.LEAST, corpus_pipeline.REACH, block).collect()}
    assert got == kept_by_hand(texts)


def test_pipeline_links_by_exact_similarity(spark):
    texts = related()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, "").collect()} == kept_by_hand(texts)


def test_rows_without_own_ids_stay_apart(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "x"), (1, c, None), (1, c, "y"), (2, c, "y"), (2, a + " z", "x"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((tuple(r) for r in corpus_pipeline.distinct(spark, docs, "").collect()), key=repr)
    assert [r for r in got if r[1] != c] == sorted([(None, b, "x"), (2, a + " z", "x"), (3, None, None)], key=repr)
    assert [r[0] for r in got if r[1] == c] == [1]
