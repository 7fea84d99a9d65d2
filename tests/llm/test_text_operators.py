"""Language, quality, packing, TIFF, chat and pieces: brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from patchlens.llm import chat, langid, packing, pieces, quality, queries, tiff

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n", "?!", "Été, ça va.", "日本 語", "😀", "a" * 30_000, "<|endoftext|> x", "don't STOP.", "aΣ ΟΔΟΣ İ", "\x00\x1c\x85", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated id, and columns that operators use names of."""
    rows = [(i, t, "x", 1.0) for i, t in enumerate(ODD)] + [(0, "other text of id 0", "x", 1.0), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, spans string, score double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def path(name):
    return queries.vocabulary(name)


# language


def forward_by_hand(model, text):
    """All segmentations of a word, by recursion over its characters."""
    lattice = langid.Lattice(model.pieces)
    at = {p: i for i, p in enumerate(lattice.pieces)}
    letters = set("".join(p for p in lattice.pieces if len(p) == 1))
    total = np.ones(len(model.languages))
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        word = langid.EDGE + word
        alpha = [np.zeros(len(model.languages)) for _ in range(len(word) + 1)]
        alpha[0] += 1
        for end in range(1, len(word) + 1):
            for begin in range(end):
                if word[begin:end] in at:
                    alpha[end] += alpha[begin] * model.chance[at[word[begin:end]]]
            if word[end - 1] not in letters:
                alpha[end] += alpha[end - 1] * np.prod([model.chance[len(at) + b] for b in word[end - 1].encode()], axis=0)
        total = total * alpha[-1]
    return np.log(total)


@pytest.fixture(scope="module")
def model():
    docs = [d for d in table("documents") if zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2]
    counts: dict = {}
    for d in docs[:300]:
        for w in re.findall(r"[^\W\d_]+", d["text"].lower()):
            counts[d["lang"], w] = counts.get((d["lang"], w), 0) + 1
    return langid.fit([(*k, n) for k, n in counts.items()], langid.public_pieces(path(queries.PIECES)))


def test_forward_sums_all_segmentations(model):
    for text in ("the", "Die Straße.", "où est", "niño 12 x", "日 a"):
        got = model.texts(pa.array([text]))[0][0]
        assert np.allclose(got, forward_by_hand(model, text), rtol=1e-9)


def test_long_words_do_not_underflow(model):
    total = model.texts(pa.array(["ab" * 20_000]))[0][0]
    assert np.isfinite(total).all() and (total < -1000).all()


def test_language_of_odd_texts(spark, odd, none, model):
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(odd, model, ["text"]).collect()}
    assert len(got) == odd.count()
    for (_, text), r in got.items():
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.languages and 0 <= r["score"] <= 1
    assert langid.identify(none, model).collect() == []
    assert langid.word_counts(spark.createDataFrame([], "doc_id bigint, text string, lang string")) == []
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit([], ["a"])).collect()} == {"und"}


def test_held_out_language(spark):
    truth = {d["doc_id"]: d["lang"] for d in table("documents")}
    rows = queries.op8_langid(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


# quality


def test_convolution_by_hand():
    net = quality.Network(3)
    rng = np.random.default_rng(0)
    texts = [b"", b"a", b"abc abc abc abc abc abc abc", bytes(rng.integers(0, 256, 1000, dtype=np.uint8))]
    sizes = np.array(list(map(len, texts)))
    got = net.scores(np.frombuffer(b"".join(texts), np.uint8), sizes)
    for text, score in zip(texts, got, strict=True):
        marked = quality.symbols(np.frombuffer(text, np.uint8), np.array([len(text)]))
        padded = list(marked) + [quality.PAD] * 40
        starts = range(0, max(1, -(-len(text) // quality.STRIDE)) * quality.STRIDE, quality.STRIDE)
        answers = [np.concatenate([net.embed[b] for b in padded[s : s + quality.WIDTH]]) @ net.filters for s in starts]
        assert np.isclose(score, net.combine(np.max(answers, axis=0)[None])[0], atol=1e-5)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    net = quality.Network(3)
    text = np.frombuffer(b"some words and more words, " * 200 + b"***", np.uint8)
    whole = net.scores(text, np.array([len(text)]))
    monkeypatch.setattr(quality, "PIECE", 256)
    assert np.allclose(whole, net.scores(text, np.array([len(text)])))


def test_marks_follow_repeats():
    marked = quality.symbols(np.frombuffer(b"abcdefgh abcd zz", np.uint8), np.array([16]))
    assert [i for i, b in enumerate(marked) if b >= 257] == [9]


def test_quality_of_odd_texts(spark, odd, none):
    net = quality.fit([b"good words here", b"bad *** words"] * 10, np.array([1.0, 0.0] * 10), epochs=2)
    rows = quality.score(odd, net, ["text"]).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["text"] == "same text"]
    assert same[0] == same[1]
    assert quality.score(none, net).collect() == []
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.score(odd, quality.fit(*quality.sample(odd, labels))).collect()} == {0.5}


def test_held_out_quality(spark):
    truth = {r["doc_id"]: r["quality"] for r in table("labels")}
    rows = queries.op1_quality(spark, SF).collect()
    assert len(rows) == len(table("documents"))
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9


# packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(queries.WORDS))


def test_words_have_the_library_ids(library):
    texts = [t or "" for t in ODD] + [d["text"] for d in table("documents")[:300]] + ["Mr. Él, ŉ K. ﬁ. ª. ²! ¼? x'y É", "a.b,c; d!? ..."]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    for parts in (True, False):
        assert packing.Tokenizer(path(queries.WORDS), parts).encode(texts) == want


def test_words_turn_over(library, monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 50)
    texts = [d["text"] for d in table("documents")[:60]]
    own = packing.Tokenizer(path(queries.WORDS))
    got = [own.encode(texts[i : i + 7]) for i in range(0, 60, 7)]
    assert sum(got, []) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def best_fit(lengths, capacity):
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= size]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(capacity - size)
    return len(rooms)


def test_plan_is_best_fit(monkeypatch):
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 64, 100):
        for _ in range(20):
            lengths = rng.integers(1, capacity + 1, rng.integers(1, 200)).tolist()
            counts = {n: lengths.count(n) for n in set(lengths)}
            table_ = packing.plan(counts, capacity)
            size = np.array(sorted(lengths))
            rank = np.concatenate([np.arange(counts[n]) for n in sorted(counts)])
            where, offset = packing.place(table_, size, rank)
            filled: dict = {}
            for s, o, n in sorted(zip(where.tolist(), offset.tolist(), size.tolist(), strict=True)):
                assert filled.get(s, 0) == o
                filled[s] = o + n
            assert max(filled.values()) <= capacity
            assert len(filled) == best_fit(lengths, capacity)
    assert len(packing.plan({}, 8)["length"]) == 0


def test_packing(spark, odd, none, library):
    rows = packing.pack(odd, packing.Tokenizer(path(queries.WORDS)), length=512).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = []
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            want.append((doc, k // 512, k, len(ids[k : k + 512]), zlib.crc32(np.array(ids[k : k + 512], "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 512
    assert packing.pack(none, packing.Tokenizer(path(queries.WORDS))).collect() == []


# TIFF


def test_codecs():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"ab" * 9000, b"x" * 30_000, rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes(), b"aaab" * 500):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
        if data:
            assert tiff.packbits_decode(tiff.packbits_encode(data)) == data


def test_public_examples():
    # worked examples of the published format descriptions
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # 7 7 7 8 8 7 7 6 6 as the codes 256 7 258 8 8 258 6 6 257 of nine bits
    assert tiff.lzw_decode(bytes.fromhex("8001e0408044080c068080")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_every_layout_comes_back():
    seen = set()
    for n in range(64):
        payload = (b"%d some text " % n * 400)[: tiff.WIDTH * (1 + n % 9)]
        payload += b"\xff" * (-len(payload) % tiff.WIDTH)
        seen.add(zlib.crc32(payload) % len(tiff.LAYOUTS))
        found = list(tiff.read_pages(tiff.store(payload)))
        assert b"".join(p.data.tobytes() for p in found) == payload
    assert len(seen) == len(tiff.LAYOUTS)


def big_endian_rgb():
    import struct

    data = zlib.compress(np.diff(np.arange(48, dtype=np.uint8).reshape(4, 4, 3), axis=1, prepend=np.zeros((4, 1, 3), np.uint8)).tobytes())
    fields = [(256, 3, 4), (257, 3, 4), (258, 3, 8), (259, 3, 32946), (273, 4, 8), (277, 3, 3), (279, 4, len(data)), (317, 3, 2)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields)
    return b"MM\0*" + struct.pack(">I", 8 + len(data)) + data + struct.pack(">H", len(fields)) + entries + bytes(4)


def test_other_files(spark):
    page = list(tiff.read_pages(big_endian_rgb()))[0]
    assert page.error is None and (page.data.ravel() == np.arange(48)).all()
    good = tiff.store(b"x" * 576)
    rows = [(1, b"junk"), (2, None), (3, b""), (4, good), (5, good[:-20]), (6, bytearray(tiff.store(b"word " * 57_600)))]
    df = spark.createDataFrame(rows, "doc_id int, media binary")
    got = tiff.pages(df).orderBy("doc_id", "page").collect()
    assert [r["doc_id"] for r in got if r["error"] and r["data"] is None] == [1, 5]
    assert bytes(next(r for r in got if r["doc_id"] == 4)["data"]) == b"x" * 576
    many = [r for r in got if r["doc_id"] == 6]
    assert b"".join(bytes(r["data"]) for r in many) == b"word " * 57_600 and [r["page"] for r in many] == list(range(len(many))) and len(many) > 1
    assert tiff.pages(df.limit(0)).collect() == []


def test_tiff_texts(odd, none):
    rows = tiff.texts(odd).collect()
    want = {}
    for r in odd.collect():
        data = (r["text"] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        want.setdefault((r["doc_id"], len(data)), (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert len(rows) == odd.count()
    assert all(want[r["doc_id"], r["n_bytes"]] == (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
    assert tiff.texts(none).collect() == []


# chat


def test_chat_comes_back(spark):
    odd = ["", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "a < | b", "<|<|im_start|>", "é\n\n", "x" * 5000]
    rows = [(c, i, ("user", "assistant", "<|im_start|>\n\\n")[i % 3], t) for c in (7, None, 3) for i, t in enumerate(odd)]
    rows += [(9, 0, None, None), (9, None, "assistant", "first"), (9, 0, "assistant", "tie b"), (9, 0, "assistant", "tie a"), (9, 0, "assistant", "tie a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(df)).collect()}
    assert set(got) == {7, None, 3, 9}
    for conv in got:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_turns(df.limit(0))).collect() == []


def test_a_long_conversation_spreads(spark):
    df = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    parts = chat.format_turns(df)
    assert parts.count() > 1
    row = chat.digest(parts).first()
    said = "".join(f"{'assistant' if i % 2 else 'user'}\ntext {i}\n" for i in range(5000))
    assert (row["n_turns"], row["turns_sha256"]) == (5000, hashlib.sha256(said.encode()).hexdigest())


# pieces


def test_pieces_are_the_library_ones(odd, none):
    import random

    import sentencepiece

    random.seed(4)
    own, library = pieces.Transducer(path(queries.PIECES)), sentencepiece.SentencePieceProcessor(model_file=path(queries.PIECES))
    texts = [t or "" for t in ODD] + ["▁a ▁▁b", "  x  y   z", " " * 37 + "end", "www.example.com/a?b=c", "    def f(x):\n\treturn 1  # ok"]
    texts += ["".join(random.choices("abcdefghij   \n.,éüñ日▁😀", k=random.randint(1, 80))) for _ in range(500)] + [d["text"] for d in table("documents")[:200]]
    ids = own.encode(texts)
    assert [np.frombuffer(i, "<i4").tolist() for i in ids] == [library.encode(t) for t in texts]
    assert [own.decode(i) for i in ids] == [library.decode(library.encode(t)) for t in texts]
    assert own.decode(np.array([0, 1, 2, -5, 10**6], "<i4").tobytes()) == ""
    assert len(pieces.round_trip(odd, own).collect()) == odd.count()
    assert {r["same"] for r in pieces.round_trip(odd, own).collect()} == {True}
    assert pieces.encode(none, own).collect() == []


def test_unigram_paths_are_shortest():
    import itertools

    own = pieces.Transducer.__new__(pieces.Transducer)
    own.pairs, own.id_of, own.score, own.longest = False, {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, [-2.0, -2.5, -3.0, -2.0, -4.4], 3
    for word in map("".join, itertools.product("ab", repeat=6)):
        def all_paths(w):
            return [[]] if not w else [[w[:n], *rest] for n in (1, 2, 3) if w[:n] in own.id_of and len(w) >= n for rest in all_paths(w[n:])]

        cost = lambda p: -sum(own.score[own.id_of[x]] for x in p)
        assert np.isclose(cost(own.path_of(word)), min(map(cost, all_paths(word))))
