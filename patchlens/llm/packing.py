"""Best-fit packing of documents into sequences, planned over a length histogram.

Documents are tokenised (a word-level memo over a public vocabulary), ended by an id, and cut into pieces of one
sequence's length only where longer. Pieces are counted by length; best-fit decreasing runs on these counts, so the
plan's size depends on the sequence length alone (at most LENGTH lengths in at most 4 * LENGTH groups of equal
sequences, and a sequence holds at most about sqrt(2 * LENGTH) different lengths). Each piece then takes the planned
slot of its rank among the pieces of its length. Ranks come from counts by (length, salt), so no length, however
common, is ranked by one task.

Null texts count as empty: they become one piece of the end id alone. Equal rows are separate documents, of equal lengths
and interchangeable places. A text longer than a sequence is cut into full ones and a rest. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, slices

LENGTH = 4096
END = 1
#: Words that a worker remembers the ids of: so many recent ones, and as many before them.
MEMO_WORDS = 300_000
#: Fresh words encoded at once.
JOINED = 500
#: Longer runs between spaces are not remembered.
MEMO_CHARS = 64
#: Punctuation that may follow a word of letters, and the first character past the letters that are taken apart.
TAIL, PLAIN = ".,;:!?", "\u0250"
#: A full stop or comma that continues a run of marks.
PAIRED = re.compile(r"(?:[^\w\s]|_)[.,]")


#: The normaliser and the splitter of tokenizers whose words may be encoded one by one.
NORMALISER = ["NFC", "Replace", "Lowercase"]
SPLITTER = ["Split", "ByteLevel"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Tokenizer:
    """Ids by the tokenizers library.

    Where a file's normaliser and splitter are the ones above (lower case, white space dropped, letters parted from
    marks, a mark at a word's end), a word between spaces or line feeds is encoded once: no special token holds white
    space, and nothing composes across it. Fresh words are encoded many at a time, with a special token between them
    where there is one. With any other file texts are encoded whole by the library.
    """

    def __init__(self, path: str, parts: bool = True):
        self.path, self.parts, self.inner, self.plain, self.mark, self.last, self.whole = path, parts, None, None, None, None, False
        self.recent: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def __getstate__(self):
        return self.path, self.parts

    def __setstate__(self, state):
        self.__init__(*state)

    def open(self) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library
        from tokenizers import normalizers, pre_tokenizers

        self.inner, self.plain = Library.from_file(self.path), Library.from_file(self.path)
        with open(self.path, encoding="utf-8") as f:
            given = json.load(f)
        steps = lambda part, inside: part.get(inside, [part]) if part else []
        normal, split = steps(given.get("normalizer"), "normalizers"), steps(given.get("pre_tokenizer"), "pretokenizers")
        known = [x["type"] for x in normal] == NORMALISER and [x["type"] for x in split] == SPLITTER and split[0].get("pattern") == {"Regex": SPLIT} and not given.get("post_processor")
        special = all(t.special and not t.normalized and not t.lstrip and not t.rstrip for t in self.inner.get_added_tokens_decoder().values())
        self.whole = not (known and special and getattr(self.inner.model, "end_of_word_suffix", None))
        if self.whole:
            return
        # the same merges without the normaliser and the splitting pattern, which change nothing in a stem
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.inner.model, "end_of_word_suffix", None)
        if self.parts:
            self.last = np.zeros(self.inner.get_vocab_size() + 1, bool)
            self.last[[i for token, i in self.inner.get_vocab().items() if token.endswith(suffix)]] = True
        self.mark = next(((i, t.content) for i, t in self.inner.get_added_tokens_decoder().items() if t.special and not t.normalized), None)

    def stems(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters."""
        out = []
        for k in range(0, len(words), JOINED):
            part = words[k : k + JOINED]
            found = self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    def fresh(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        alone = list(range(len(words)))
        if self.mark:
            mark, text = self.mark
            alone = [i for i, w in enumerate(words) if text in w]
            joined = [i for i, w in enumerate(words) if text not in w]
            for k in range(0, len(joined), JOINED):
                part = joined[k : k + JOINED]
                ids = np.array(self.inner.encode_batch_fast([text.join(words[i] for i in part)], add_special_tokens=False)[0].ids, "<u4")
                ends = 4 * np.append(np.flatnonzero(ids == mark), len(ids))
                data, at = ids.tobytes(), 0
                for i, end in zip(part, ends.tolist(), strict=True):
                    out[i] = data[at:end]
                    at = end + 4
        for i, found in zip(alone, self.inner.encode_batch_fast([words[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out

    def learn(self, words: set[str]) -> None:
        """Adds words to the recent ones.

        A word of letters with punctuation behind it, or with upper-case letters, has the ids of the parts: letters and
        punctuation are never in one piece, and the tokenizer lower-cases letter by letter.
        """
        recent, before = self.recent, self.before
        apart, lost, stems = [], set(), set()
        for w in words:
            if (ids := before.get(w)) is not None:
                recent[w] = ids
                continue
            if self.parts and w.isascii() and w.isalpha() and w.islower():
                stems.add(w)
                continue
            stem = w.rstrip(TAIL)
            low = stem.lower()
            if self.parts and stem.isalpha() and (stem.isascii() or max(stem) < PLAIN and len(low) == len(stem) and unicodedata.is_normalized("NFC", stem)):
                if low == w:
                    stems.add(w)
                    continue
                tail = w[len(stem) :]
                apart.append((w, low, tail))
                for part, missing in ((low, stems), (tail, lost)):
                    if part not in recent:
                        if (ids := before.get(part)) is not None:
                            recent[part] = ids
                        else:
                            missing.add(part)
            else:
                lost.add(w)
        for some, encoded in ((list(lost), self.fresh), (list(stems), self.stems)):
            recent.update(zip(some, encoded(some), strict=True))
        for w, low, tail in apart:
            recent[w] = recent[low] + recent[tail]

    def spaced(self, text: str) -> str:
        """A text whose words are fewer and that has the same ids.

        Where no special token and no odd letter can be, it is lower-cased here; where no full stop or comma continues
        a run of marks, each begins a piece of its own anyway, and gets a space before it.
        """
        if self.parts and (text.isascii() or max(text) < PLAIN and "\u0130" not in text and unicodedata.is_normalized("NFC", text)) and "<|" not in text:
            text = text.lower()
            if not PAIRED.search(text):
                text = text.replace(".", " .").replace(",", " ,")
        return text.replace("\n", " ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; nothing for null."""
        if self.inner is None:
            self.open()
        if self.whole:
            return [np.array(e.ids, "<u4").tobytes() for e in self.inner.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        split = [self.spaced(t or "").split(" ") for t in texts]
        if len(self.recent) > MEMO_WORDS:
            self.before, self.recent = self.recent, {}
        fresh = set().union(*split).difference(self.recent)
        self.learn(fresh)
        out = [b"".join(map(self.recent.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > MEMO_CHARS:
                self.recent.pop(w, None)
        return out


def pieces(docs: DataFrame, tokenizer: Tokenizer, length: int = LENGTH, end: int = END, carry: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; carry: and its ids, 32 bits each, little-endian."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, place, start, size, crc, kept = [], [], [], [], [], []
            for row, ids in enumerate(shared.value.encode(column(batch, "text").to_pylist())):
                ids += last
                for k in range(0, len(ids), 4 * length):
                    part = ids[k : k + 4 * length]
                    owner.append(row)
                    place.append(k // (4 * length))
                    start.append(k // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if carry:
                        kept.append(part)
            out = {
                "doc_id": column(batch, "doc_id").take(pa.array(owner, pa.int64())),
                "piece": pa.array(place, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(kept, pa.binary())} if carry else {}))

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{', ids binary' if carry else ''}")


def plan(counts: dict[int, int], capacity: int = LENGTH) -> dict[str, np.ndarray]:
    """Best-fit decreasing over a histogram {length: pieces}.

    A group is a run of sequences with equal contents. Rows of the plan, by length and first rank: pieces of `length`
    ranked from `first` on go to the sequences from `sequence` on, `each` to a sequence, the first of them at `offset`.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left: groups (first sequence, sequences)
    rooms = np.zeros(capacity + 1, bool)
    rows: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            free.setdefault(room, []).append((first, many))
            rooms[room] = True

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = int(fits[0]) + length
                first, many = free[room].pop()
                if not free[room]:
                    rooms[room] = False
            else:
                room, first, many = capacity, made, -(-left // (capacity // length))
                made += many
            each = room // length
            full = min(many, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < many and left:  # one sequence takes what is left
                rows.append((length, rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, many - full - 1)
                rank, left = rank + left, 0
            elif full < many:
                put(room, first + full, many - full)
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T, strict=True))


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by their length and their rank within it."""
    wide = np.int64(1) << 48
    at = np.searchsorted(table["length"] * wide + table["first"], length * wide + rank, "right") - 1
    nth = rank - table["first"][at]
    return table["sequence"][at] + nth // table["each"][at], table["offset"][at] + nth % table["each"][at] * length


def ranked(found: DataFrame, salts: int) -> DataFrame:
    """Adds each piece's rank (from 0) among those of its length; found: cut, so that rows keep their places.

    Salts come from the place of a stored row, so rows that are equal in all columns spread as others do.
    """
    # doc_id and piece order a salt's pieces; equal rows are interchangeable
    salted = found.withColumn("_salt", F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("_nth", F.row_number().over(own) - 1)
    return numbered.join(bases, ["length", "_salt"]).withColumn("rank", F.col("_base") + F.col("_nth")).drop("_salt", "_base", "_nth")


def pack(docs: DataFrame, tokenizer: Tokenizer, length: int = LENGTH, end: int = END, carry: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; carry: and its ids."""
    spark = docs.sparkSession
    found = cut(pieces(docs, tokenizer, length, end, carry))
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(plan(histogram, length))
    salts = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ["ids"] if carry else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part["sequence_id"], part["offset"] = place(table.value, part["length"].to_numpy(), part.pop("rank").to_numpy())
            yield part

    rows = ranked(found, salts).select("doc_id", "piece", "start", "length", "ids_crc32", *ids, "rank")
    return rows.mapInPandas(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, {'ids binary, ' if carry else ''}sequence_id bigint, `offset` bigint")


def sequences(docs: DataFrame, tokenizer: Tokenizer, length: int = LENGTH, end: int = END) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and where each document begins (doc_ids, pieces, offsets).

    A sequence has at most `length` ids, so it is put together in memory whatever the table's size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), "<u4").astype(np.int32)
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iat[0]], "ids": [ids], "doc_ids": [pdf["doc_id"].tolist()], "pieces": [pdf["piece"].to_numpy()], "offsets": [pdf["offset"].to_numpy()]})

    packed = pack(docs, tokenizer, length, end, carry=True)
    return packed.groupBy("sequence_id").applyInPandas(run, f"sequence_id bigint, ids array<int>, doc_ids array<{kind}>, pieces array<int>, offsets array<bigint>")
