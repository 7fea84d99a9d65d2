"""Further cases: other files and models, many matches in one text, planted copies at several similarities, hot shards."""

import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from patchlens.functions import scan
from patchlens.llm import copies, embdedup, graph, packing, pieces, pii, quality, secrets, simhash, spans, tiff

SF = "/root/testdata/sf0.01"


# transducers


def small_model(path, byte_fallback, seed=3):
    """A unigram model with invented scores and a public character map."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    rng = random.Random(seed)
    model = proto.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = byte_fallback
    del model.pieces[:]

    def add(piece, score, kind):
        p = model.pieces.add()
        p.piece, p.score, p.type = piece, score, kind

    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        add(name, 0.0, kind)
    for b in range(256) if byte_fallback else ():
        add(f"<0x{b:02X}>", 0.0, 6)
    letters = "abcdefghijé1"
    made = {"▁", *letters} | {("▁" if rng.random() < 0.4 else "") + "".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(300)}
    for piece in sorted(made):
        add(piece, -rng.uniform(1, 9) - 0.5 * len(piece), 1)
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_models_with_a_character_map(tmp_path, byte_fallback):
    import sentencepiece

    path = small_model(tmp_path / "m.model", byte_fallback)
    own, library = pieces.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    texts = ["", " ", "a", "ﬁ ab", "ｆｕｌｌ　width", "ab\tcd\nef", "①é", "日本 abc 😀😀", " a  b "] + ["".join(rng.choices("abcdefghij   é1ﬁ①\tz日", k=rng.randint(1, 60))) for _ in range(400)]
    assert [np.frombuffer(i, "<i4").tolist() for i in own.encode(texts)] == [library.encode(t) for t in texts]
    if byte_fallback:  # without it, what has no piece decodes to nothing
        assert [own.decode(i) for i in own.encode(texts)] == [library.decode(library.encode(t)) for t in texts]


# TIFF


def file_of(fields, data, order="<"):
    """A file of one page whose data stands behind the header; fields: tag -> (type, values)."""
    at = 8 + len(data)
    entries, tail = b"", b""
    size = {3: "H", 4: "I"}
    fixed = 2 + 12 * len(fields) + 4
    for tag, (kind, values) in sorted(fields.items()):
        packed = struct.pack(f"{order}{len(values)}{size[kind]}", *values)
        if len(packed) > 4:
            own, tail = struct.pack(order + "I", at + fixed + len(tail)), tail + packed
        else:
            own = packed.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + own
    head = b"II*\0" if order == "<" else b"MM\0*"
    return head + struct.pack(order + "I", at) + data + struct.pack(order + "H", len(fields)) + entries + bytes(4) + tail


def base(width, height, bits, size, **more):
    return {256: (3, (width,)), 257: (3, (height,)), 258: (3, (bits,)), 259: (3, (8,)), 273: (4, (8,)), 279: (4, (size,))} | {int(k[1:]): v for k, v in more.items()}


@pytest.mark.parametrize("order", ["<", ">"])
def test_wide_samples_and_their_predictors(order):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 1 << 16, (5, 7), np.uint16)
    differed = np.diff(image, axis=1, prepend=np.zeros((5, 1), np.uint16)).astype(f"{order}u2")
    data = zlib.compress(differed.tobytes())
    page = next(tiff.read_pages(file_of(base(7, 5, 16, len(data), t317=(3, (2,))), data, order)))
    assert page.error is None and page.data.tobytes() == image.astype("<u2").tobytes()
    real = rng.normal(size=(4, 6)).astype(np.float32)
    planes = real.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    data = zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((4, 1), np.uint8)).tobytes())
    page = next(tiff.read_pages(file_of(base(6, 4, 32, len(data), t317=(3, (3,)), t339=(3, (3,))), data, order)))
    assert page.error is None and page.data.tobytes() == real.astype("<f4").tobytes()


def test_small_samples_and_planes():
    bits = np.random.default_rng(2).integers(0, 2, (3, 11), np.uint8)
    data = zlib.compress(np.packbits(bits, axis=1).tobytes())
    page = next(tiff.read_pages(file_of(base(11, 3, 1, len(data)), data)))
    assert (page.data == bits).all()
    four = np.arange(15, dtype=np.uint8).reshape(3, 5)
    data = zlib.compress(np.array([[r[0] << 4 | r[1], r[2] << 4 | r[3], r[4] << 4] for r in four], np.uint8).tobytes())
    assert (next(tiff.read_pages(file_of(base(5, 3, 4, len(data)), data))).data == four).all()
    planes = [zlib.compress(bytes([k * 10 + i for i in range(6)])) for k in range(3)]
    places = tuple(8 + sum(map(len, planes[:k])) for k in range(3))
    fields = base(3, 2, 8, 0) | {258: (3, (8, 8, 8)), 277: (3, (3,)), 284: (3, (2,)), 273: (4, places), 279: (4, tuple(map(len, planes)))}
    page = next(tiff.read_pages(file_of(fields, b"".join(planes))))
    assert page.error is None and page.data.ravel().tolist() == [k * 10 + i for i in range(6) for k in range(3)]
    odd = base(3, 2, 8, 6, t317=(3, (3,)))
    assert "predictor" in next(tiff.read_pages(file_of(odd, b"abcdef"))).error


def test_the_published_lzw_example():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


# many matches in one text


def test_scans_by_hand(spark):
    rng = random.Random(1)
    rows = [(n, [rng.randint(0, 9) for _ in range(n)]) for n in (0, 1, 2, 63, 64, 65, 128, 500)]
    df = spark.createDataFrame(rows, "n int, v array<int>")
    for r in df.select("n", "v", scan.scanned(F.col("v"), lambda a, b: a + b).alias("s"), scan.before(F.col("v")).alias("b"), scan.scanned(F.col("v"), F.greatest).alias("m")).collect():
        assert r["s"] == np.cumsum(r["v"]).tolist() and r["b"] == (np.cumsum(r["v"]) - r["v"]).tolist() and r["m"] == np.maximum.accumulate(np.array(r["v"], int)).tolist()


def test_pieces_of_long_texts(spark):
    text = "".join(random.Random(2).choices("aé😀\n", k=3000))
    rows = [(a, b) for a in (0, 1, 255, 256, 257, 1000, 2999) for b in (a, a + 1, a + 256, a + 300, 3000) if b <= 3000]
    df = spark.createDataFrame([(text, a, b) for a, b in rows], "t string, a int, b int")
    got = df.select("a", "b", spans.between(spans.chunks(F.col("t")), F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r["p"] == text[r["a"] : r["b"]] for r in got)


def test_many_matches_take_time_in_proportion(spark):
    def took(n):
        docs = spark.createDataFrame([(1, "ab@cd.ef " * n)], "doc_id int, text string")
        began = time.perf_counter()
        row = pii.digest(pii.scan(docs)).first()
        assert row["n_email"] == n
        assert pii.masked(pii.scan(docs)).first()["text"] == "<EMAIL> " * n
        return time.perf_counter() - began

    took(100)
    few, many = took(5000), took(50_000)
    assert many < 12 * few


# personal data


def found_by_hand(text):
    """All candidates with their votes, from the published patterns and lists."""
    text = text or ""
    out = []

    def vote(yes, no=False):
        return -1 if no else 1 if yes else 0

    def add(kind, m, ends):
        left = text[ends : m.start()][-pii.LEFT :]
        right = text[m.end() : m.end() + 10_000]
        out.append((kind, m, left, right))

    for kind, pattern in (("email", pii.EMAIL), ("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE), ("wide", pii.WIDE)):
        every = list(regex.finditer(pattern, text))
        for i, m in enumerate(every):
            left = text[every[i - 1].end() if i else 0 : m.start()][-pii.LEFT :]
            right = text[m.end() : every[i + 1].start() if i + 1 < len(every) else len(text)][: pii.RIGHT]
            digits = regex.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + j % 2), 10)) for j, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            own = kind
            if kind == "wide":
                own = "account" if regex.match("[A-Z]{2}[0-9]{2}", m[0]) else "national" if regex.match("[0-9]{3}-[0-9]{2}-", m[0]) else "local" if regex.match("[0-9(].*[0-9]$", m[0]) else "address" if m[0][0].isdigit() else "person"
            words = m[0].lower().split(" ")
            if own in pii.BASE:
                shape = vote(*(bool(regex.search(p, m[0])) for p in pii.SHAPES[own]))
            elif own == "national":
                bad = bool(regex.search("^(?:000|666|9)|-00-|-0000$", m[0]))
                shape = vote(not bad, bad)
            elif own == "account":
                shape = vote(bool(regex.search("^(?:DE[0-9]{20}|FR[0-9]{12}[A-Z0-9]{11}[0-9]{2}|ES[0-9]{22}|GB[0-9]{2}[A-Z]{4}[0-9]{14}|NL[0-9]{2}[A-Z]{4}[0-9]{10})$", m[0])))
            elif own == "local":
                shape = vote(bool(regex.search(r"^\(?[2-9]", m[0])), bool(regex.search(r"^\(?[01]", m[0])))
            else:
                shape = 0
            listed = vote(words[0] in pii.NAMES, bool(set(words) & set(pii.NOT_NAMES))) if own == "person" else vote(bool(regex.search(f"(?<![a-z])(?:{pii.STREET_NAMES})(?![a-z])", m[0].lower())), m[0][0] == "0") if own == "address" else 0
            repeated = own == "person" and len(set(words)) < len(words)
            votes = (shape, listed, vote(bool(regex.search(pii.BEFORE, left))), vote(bool(regex.search(pii.AROUND, f"{left} {right}"))), vote(False, bool(regex.search(pii.AGAINST, left)) or repeated))
            size = m.end() - m.start()
            out.append((own, m.start(), m.end(), votes, 0 if size < 12 else 1 if size < 20 else 2))
    return out


def invented(n=400, seed=4):
    """(text, planted personal data of the further kinds) of invented letters with decoys among them."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    rows = []
    for _ in range(n):
        given, family = rng.choice(pii.NAMES).title(), "".join(rng.choices("bcdfglmnrst", k=1)).upper() + "".join(rng.choices("aeiourstln", k=6))
        real = {
            "person": f"{given} {family}", "national": f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "account": f"DE{digits(20)}",
            "local": f"({rng.randint(201, 989)}) {rng.randint(201, 989)}-{digits(4)}", "address": f"{rng.randint(1, 999)} {rng.choice(['Oak', 'Park', 'Maple', 'Church'])} Street",
        }
        cue = {"person": "Contact: ", "national": "SSN: ", "account": "IBAN ", "local": "phone: ", "address": "address: "}
        kind = rng.choice(list(real))
        said = f"Dear reader, {cue[kind]}{real[kind]}, mail x{digits(3)}@example.com, call +49 30 {digits(7)}."
        decoy = rng.choice(["On Monday January we met. ", "See page 000-00-0000 and so on. ", "The Der Und was here. ", "version 100.100-0000 is out. ", "Chapter Und Das. "])
        rows.append((decoy + said if rng.random() < 0.5 else decoy, {real[kind]}))
    return [(t, p if any(x in t for x in p) else set()) for t, p in rows]


def seen_by_hand(text, kind, start, end):
    """The hashed features of a span, from their description."""
    every = sorted((a, b) for k, a, b, _, _ in found_by_hand(text) if (k in pii.BASE and k == kind) or (k not in pii.BASE and kind not in pii.BASE))
    i = every.index((start, end))
    left = text[every[i - 1][1] if i else 0 : start][-pii.LEFT :].lower()
    right = text[end : every[i + 1][0] if i + 1 < len(every) else len(text)][: pii.RIGHT].lower()
    shape = regex.sub("[0-9]+", "0", regex.sub(r"\p{Ll}+", "a", regex.sub(r"\p{Lu}+", "A", text[start:end])))[:16]
    before, after = regex.search(r"(\p{L}+)\P{L}*$", left), regex.search(r"^\P{L}*(\p{L}+)", right)
    low = text[start:end].lower()
    each = {"shape": shape, "first": low[:3], "last": low[-3:], "before": before[1] if before else "", "after": after[1] if after else ""}
    return tuple(zlib.crc32(f"{name}|{kind}|{value}".encode()) % pii.BUCKETS for name, value in each.items())


def test_added_spans_by_hand_and_their_precision(spark):
    texts = invented()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(-1, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.scan(docs).collect()}
    each = [[(*row, seen_by_hand(t, *row[:3])) for row in found_by_hand(t)] for t, _ in texts]
    counts, sampled = {}, {}
    for row in each:
        for kind, _, _, votes, size, seen in row:
            counts[kind, votes, size] = counts.get((kind, votes, size), 0) + 1
            sampled[kind, votes, size, seen] = sampled.get((kind, votes, size, seen), 0) + 1
    counted = sorted((*k, n) for k, n in counts.items())
    found = pii.candidates(docs)
    assert counted == pii.histogram(found)
    assert sorted((*k, n) for k, n in sampled.items()) == pii.sample(found)
    assert all(n <= 5 for n in Counter(r[0] for r in pii.sample(found, 5) for _ in range(r[4])).values())
    chance, _ = pii.estimate(counted)
    weight = pii.train(pii.sample(found), chance)
    right = told = planted = 0
    for i, ((text, real), row) in enumerate(zip(texts, each, strict=True)):
        base = [(a, b) for kind, a, b, *_ in row if kind in pii.BASE]
        z = lambda kind, votes, seen: weight[list(seen)].sum() + weight[pii.BUCKETS + pii.KINDS.index(kind)] + sum(np.log(chance[j][0][{1: 0, 0: 1, -1: 2}[v]] / chance[j][1][{1: 0, 0: 1, -1: 2}[v]]) for j, v in enumerate(votes))
        added = {(kind, a, b) for kind, a, b, votes, _, seen in row if kind not in pii.BASE and z(kind, votes, seen) >= 0 and not any(x < b and a < y for x, y in base)}
        assert {(s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] not in pii.BASE} == added
        said = {text[a:b] for _, a, b in added}
        right, told, planted = right + len(said & real), told + len(said), planted + len(real)
    assert right >= 0.9 * told and right >= 0.9 * planted, (right, told, planted)


def test_spans_that_no_labeler_lists(spark):
    """Names, streets and words before them that no list has: what the listed ones among them have in common is learned."""
    rng = random.Random(8)
    strange = lambda n: rng.choice("BDFGKLMNPRTVZ") + "".join(rng.choices("aeiou", k=1)) + "".join(rng.choices("bdfgklmnprtvzaeiou", k=n))
    rows, unlisted = [], {}
    for i in range(900):
        kind, plain = rng.choice(("person", "address")), rng.random() < 0.35
        if kind == "person":
            given = strange(4) if plain else rng.choice(pii.NAMES).title()
            span, said = f"{given} {strange(5)}", "bearer {0}, residing here since"
        else:
            span, said = f"{rng.randint(1, 999)} {strange(5) if plain else rng.choice(['Oak', 'Park', 'Maple', 'Church'])} Street", "dwelling {0} until further"
        decoy = rng.choice(["The {0} were seen again", "meanwhile {0} rose in the", "under {0} nothing grew as"]).format(f"{strange(5)} {strange(6)}")
        rows.append((i, f"x {said.format(span)} {decoy} q"))
        if plain:
            unlisted[i] = span
    got = {r["doc_id"]: r["spans"] for r in pii.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    texts = dict(rows)
    told = [(i, texts[i][s["start"] : s["end"]]) for i in unlisted for s in got[i]]
    right = sum(unlisted[i] == x for i, x in told)
    assert right >= 0.9 * len(told) and right >= 0.9 * len(unlisted), (right, len(told), len(unlisted))


# near copies


def test_bands_find_near_copies():
    rng = np.random.default_rng(3)
    met = {}
    for share in (0.8, 0.85, 0.5, 0.33):
        found = 0
        for _ in range(200):
            n = 200
            common = round(2 * n * share / (1 + share))
            x = rng.integers(0, 1 << 63, (2 * n - common, 3), dtype=np.uint64)
            a, b = copies.banded(x[:n]), copies.banded(x[n - common :])
            found += bool((a == b).any())
        met[share] = found / 200
    assert met[0.8] >= 0.98 and met[0.85] >= 0.98 and 0.05 <= met[0.5] <= 0.35 and met[0.33] <= 0.05


def test_recall_of_planted_near_copies(spark):
    """Copies of real texts with words changed here and there, down to a similarity of 0.8."""
    rng = random.Random(6)
    docs = [d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist() if d["text"] and len(d["text"].split()) > 120][:150]
    rows, pairs = [], []
    for i, text in enumerate(docs):
        words = text.split()
        changed = list(words)
        for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.002, 0.02)))):
            changed[at] = f"new{rng.randrange(10**6)}"
        rows += [(2 * i, text), (2 * i + 1, " ".join(changed))]
        a, b = (set(copies.shingles(t.encode(), 5)[:, 0].tolist()) for t in (text, " ".join(changed)))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * i, 2 * i + 1))
    kept = {r["doc_id"] for r in corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    caught = sum(not (a in kept and b in kept) for a, b in pairs)
    assert len(pairs) > 80 and caught >= 0.99 * len(pairs)


def test_large_shards_are_taken_whole(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(words[:140] + [f"x{i}"] * 10) for i in range(60)] + [" ".join(f"y{rng.randrange(10**6)}" for _ in range(100)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string")
    seen = copies.cut(copies.printed(docs, 5).groupBy("set", *copies.NAMES).agg(F.min("key").alias("key"), F.any_value("bands").alias("bands")))
    names = {r["set"]: r["key"] for r in seen.collect()}
    for members in (4096, 8):
        root = {r["node"]: r["root"] for r in graph.components(copies.candidates(seen, 52, members)).collect()}
        assert len({root[s] for s, k in names.items() if k < 60}) == 1 and not any(s in root for s, k in names.items() if k >= 60)


# equal hashes of different values


def test_equal_hashes_are_told_apart(spark):
    rows = [(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "a", 3)]
    df = copies.cut(spark.createDataFrame(rows, "node bigint, v string, n int"))
    got = graph.apart(df, "node", ["v"]).collect()
    assert len(got) == 4 and len({r["node"] for r in got}) == 4 and {(r["v"], r["n"]) for r in got} == {(v, n) for _, v, n in rows}
    assert graph.apart(df.filter("n > 2"), "node", ["v"]).count() == 1


def test_embeddings_in_super_blocks(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "SUPER", 2)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12, 8))[rng.integers(12, size=300)] + rng.normal(size=(300, 8)) * 0.12
    # pairs so near the threshold that their codes leave it open
    x[:40, 0], x[:40, 1:] = 1.0, 0.0
    x[1:40:2, 1] = np.sqrt(1 / 0.93**2 - 1)
    x = np.float32(x)
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 2 if i >= 40 else 0) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(df, block=20).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.array([i % 2 if i >= 40 else 0 for i in range(300)])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    close = np.abs(unit @ unit.T - 0.93) < 1e-12
    sure = ~(close & (label[:, None] == label)).any(1)
    assert sure.sum() > 200 and all(got[i]["n_links"] == near[i].sum() for i in np.flatnonzero(sure))


def test_hot_leaves_are_cut_at_home_too(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 40)
    monkeypatch.setattr(simhash, "QUERIES", 60)
    monkeypatch.setattr(simhash, "SHARDS", 2)
    rng = np.random.default_rng(5)
    points = np.unique(np.repeat(rng.integers(0, 1 << 63, 40, dtype=np.uint64), 10) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    df = copies.cut(spark.createDataFrame([(int(p), int(p)) for p in points.view(np.int64)], "node bigint, f0 bigint"))
    edges = [(r["src"], r["dst"]) for r in simhash.links(df, 3, home=1000).collect()]
    root = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    names = points.view(np.int64).tolist()
    for i in range(len(points)):
        for j in np.flatnonzero(near[i]):
            assert i == j or root[names[i]] == root[names[j]]
    for a, b in edges:
        assert near[names.index(a)].sum() > 1 and near[names.index(b)].sum() > 1


def test_secrets_of_rows_with_one_hash(spark, monkeypatch):
    monkeypatch.setattr(secrets, "prepared", lambda docs: docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(7).cast("bigint").alias("rid")))
    docs = spark.createDataFrame([(1, "AKIA" + "Z" * 16), (2, "password=abcdefghijklmn"), (3, "none")], "doc_id int, text string")
    for most in (0, 100):
        got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(docs, broadcast=most).collect()}
        assert got == {1: ["access"], 2: ["assign"], 3: []}


# the pipeline


def test_stages_of_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_one_row_of_each_planted_group_stays(spark):
    rng = random.Random(10)
    rows = []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(160)]
        for c in range(1 + g % 4):
            own = list(words)
            own[80] = f"copy{c}"
            rows.append((100 * g + c, " ".join(own), "en", None, 1))
    rows += [(None, "alone " + " ".join(f"n{i}" for i in range(50)), None, None, None), (None, "other " + " ".join(f"m{i}" for i in range(50)), None, None, None)]
    got = corpus_pipeline.distinct(spark, spark.createDataFrame(rows * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "").collect()
    assert sorted((r["doc_id"] for r in got if r["doc_id"] is not None)) == [100 * g for g in range(12)] and sum(r["doc_id"] is None for r in got) == 2


def test_rejected_without_any_learned_language(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.language(spark, docs, "").count() == 0


def test_samples_choose_among_fitting_rows(spark):
    docs = spark.createDataFrame([(i, "x" * (100 if i % 2 else 10)) for i in range(100)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(100)], "doc_id int, quality int")
    texts, kinds = quality.sample(docs, labels, rows=20, most=50)
    assert len(texts) == 40 and kinds.sum() == 20


def test_packing_of_other_tokenizers_is_the_library(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello World, it's 1st.", "", "a  b", "Ünï\ncode"]
    own, library = packing.Tokenizer(path), Tokenizer.from_file(path)
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_sequences_hold_the_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", "one two", "word " * 300, "some, other text. " * 40] + [f"text number {i}" * (i % 7) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = packing.sequences(docs, packing.Tokenizer(path), length=64).collect()
    back = {}
    for r in rows:
        assert len(r["ids"]) <= 64 and r["offsets"][0] == 0
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], r["offsets"], [*r["offsets"][1:], len(r["ids"])], strict=True):
            back.setdefault(doc, {})[piece] = r["ids"][a:b]
    got = {doc: [x for _, part in sorted(parts.items()) for x in part] for doc, parts in back.items()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
