"""SentencePiece encoding and decoding as shortest paths of weighted finite-state transducers.

A model file is compiled into transducers over the tropical semiring:

* the normaliser rewrites by the model's character map (longest match in a trie; no map: every character to itself),
  folds spaces, adds the leading space and writes spaces as the boundary mark;
* the piece transducer is a trie over the vocabulary; reading a piece to its end emits its id for the piece's weight and
  goes back to the root;
* byte fallback reads a character that is no piece and emits the ids of its UTF-8 bytes, for a weight above any piece's;
* for byte-pair models the merge transducer reads ids, its state being the last one.

An input word is an acceptor of its characters. It is composed with the pieces and the bytes, and their output with the
merges, on the fly: a state is a place in the word and a state of the merges. The shortest path through the composition
from the first place to the last is the encoding, found in the order of places, which is a topological one.

Unigram models weigh a piece with its negated score, and the merge transducer has one state. Byte-pair models have no
additive scores: a segmentation is what merging gives if and only if merging would leave every two neighbouring pieces as
they are. So there a piece weighs 1, the merge transducer weighs nothing for a pair that merging leaves apart and
infinitely much for any other.

No piece crosses from another character to a boundary mark, so inputs are composed word by word, and a word is cut
wherever no piece holds its two characters side by side. Words and these parts are remembered within a bound.

Null and empty texts have no ids. Equal texts have equal ids, repeated rows stay separate rows, an empty table gives no
rows. A long text is composed word by word; a word of any length needs memory in proportion to it. Decoding gives the
normalised text back without the leading space; a boundary mark in a text reads back as a space. Ids that are no pieces,
and control pieces, decode to nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices

MARK = "▁"
#: Words and pairs of pieces that a worker remembers: so many recent ones (of words, as many before them).
MEMO_WORDS, MEMO_PAIRS, MEMO_CHARS = 200_000, 1_000_000, 64
#: Types of pieces and of models, and what a character without a piece weighs above the dearest piece.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, PAIRS = 1, 2
PENALTY = 10.0
#: Characters up to which merging looks through all pairs; a heap gives the same beyond.
SHORT = 40


def character_map(blob: bytes) -> dict[str, str]:
    """What a model's character map rewrites: a double-array trie over UTF-8, whose leaves are places in a pool of strings."""
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    pool = blob[4 + size :]
    labels = np.arange(1, 256, dtype=np.int64)
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    out: dict[str, str] = {}
    queue = [(offset(int(units[0])), b"")]
    while queue:
        base, key = queue.pop()
        places = base ^ labels
        inside = places < len(units)
        places, read = places[inside], labels[inside]
        for place, label in zip(*(x[(units[places] & 0x800000FF) == read].tolist() for x in (places, read)), strict=True):
            unit = int(units[place])
            after, longer = place ^ offset(unit), key + bytes((label,))
            if unit >> 8 & 1:
                at = int(units[after]) & 0x7FFFFFFF
                out[longer.decode("utf-8", "replace")] = pool[at : pool.index(b"\0", at)].decode()
            queue.append((after, longer))
    return out


class Normaliser:
    """The first transducer: text to what the pieces read."""

    def __init__(self, rules):
        if not rules.escape_whitespaces:
            raise ValueError("only models that escape spaces are compiled")
        self.prefix, self.fold = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        # a node of the trie is (children, what is written or None)
        self.trie: list = [{}, None]
        rewritten = character_map(rules.precompiled_charsmap) if rules.precompiled_charsmap else {}
        for read, write in rewritten.items():
            node = self.trie
            for c in read:
                node = node[0].setdefault(c, [{}, None])
            node[1] = write
        self.begins = re.compile(f"[{''.join(map(re.escape, sorted(self.trie[0])))}]") if rewritten else None

    def rewrite(self, text: str) -> str:
        if self.begins is None:
            return text
        out, done = [], 0
        for m in self.begins.finditer(text):
            if m.start() < done:
                continue
            node, at, found = self.trie, m.start(), None
            while at < len(text) and (node := node[0].get(text[at])) is not None:
                at += 1
                if node[1] is not None:
                    found = at, node[1]
            if found:
                out += [text[done : m.start()], found[1]]
                done = found[0]
        return "".join([*out, text[done:]])

    def __call__(self, text: str) -> str:
        text = self.rewrite(text)
        if self.fold:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)


class Merges:
    """The last transducer of byte-pair models: reads ids, its state is the last one (-1: none, below: a character without a piece)."""

    def __init__(self, spelling: list[str], id_of: dict[str, int], score: list[float]):
        self.spelling, self.id_of, self.score = spelling, id_of, score
        self.known: dict[int, float] = {}
        self.sound: dict[str, bool] = {}

    def weight(self, last: int, piece: int) -> float:
        """0 if merging leaves the two apart, and gives the piece from its characters; else infinite."""
        if piece < -1:
            return 0.0
        key = (max(last, -1) + 1 << 24) + piece
        found = self.known.get(key)
        if found is None:
            if len(self.known) > MEMO_PAIRS:
                self.known.clear()
            right = self.spelling[piece]
            fine = self.whole(right) and (last < 0 or self.stay(self.spelling[last], right))
            found = self.known[key] = 0.0 if fine else math.inf
        return found

    def merged(self, text: str) -> list[str]:
        """What merging does, by its definition: the best scored pair first, the leftmost of equals."""
        if len(text) > SHORT:
            return self.merged_by_heap(text)
        id_of, score = self.id_of, self.score
        parts = list(text)
        rank = [-score[at] if (at := id_of.get(a + b)) is not None else math.inf for a, b in pairwise(parts)]
        while rank and (best := min(rank)) < math.inf:
            i = rank.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            for k in (i - 1, i):
                if 0 <= k < len(rank):
                    rank[k] = -score[at] if (at := id_of.get(parts[k] + parts[k + 1])) is not None else math.inf
        return parts

    def merged_by_heap(self, text: str) -> list[str]:
        """The same in time that hardly grows beyond the text's length."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1]
        ahead = [*range(-1, len(parts) - 1)]
        heap: list = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (at := self.id_of.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-self.score[at], i, parts[i], parts[after[i]]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if parts[i] != left or after[i] < 0 or parts[after[i]] != right:
                continue
            j = after[i]
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] >= 0:
                ahead[after[j]] = i
            offer(ahead[i])
            offer(i)
        return [p for p in parts if p is not None]

    def whole(self, piece: str) -> bool:
        """Merging a piece's characters gives the piece."""
        found = self.sound.get(piece)
        if found is None:
            found = self.sound[piece] = self.merged(piece) == [piece]
        return found

    def stay(self, left: str, right: str) -> bool:
        """Merging leaves two pieces apart."""
        return left + right not in self.id_of and self.merged(left + right) == [left, right]


class Transducer:
    """A compiled model; it travels as the path of its file."""

    merges: Merges | None = None
    trie: list | None = None

    def __init__(self, path: str):
        self.path, self.ready = path, False

    def __getstate__(self):
        return self.path

    def __setstate__(self, path):
        self.__init__(path)

    def compile(self) -> Transducer:
        if self.ready:
            return self
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(self.path, "rb") as f:
            model.ParseFromString(f.read())
        kind = model.trainer_spec.model_type
        if kind not in (UNIGRAM, PAIRS) or model.trainer_spec.treat_whitespace_as_suffix or any(p.type == USER for p in model.pieces):
            raise ValueError("only unigram and byte-pair models without pieces of users are compiled")
        self.normalise = Normaliser(model.normalizer_spec)
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = [p.score for p in model.pieces]
        self.merges = Merges([p.piece for p in model.pieces], self.id_of, self.score) if kind == PAIRS else None
        self.link()
        self.bytes_at = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece goes across a boundary")
        inside = {c for p in self.id_of if len(p) > 1 for c in p}
        lone = "".join(c for c in map(chr, range(32)) if c not in inside)
        self.words = re.compile(f"{MARK}*[^{MARK}{re.escape(lone)}]+|{MARK}+|[{re.escape(lone)}]")
        spelled = [p.piece.encode() if p.type == NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" for p in model.pieces]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_sizes = np.array([*map(len, spelled), 0], np.int64)  # the last is for ids out of range
        self.spelled_at = np.cumsum(self.spelled_sizes) - self.spelled_sizes
        self.recent: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.touching = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.ready = True
        return self

    def link(self) -> None:
        """The piece transducer, read from a piece's end: a node is (children, id or -1, weight)."""
        self.trie = [{}, -1, 0.0]
        for piece, at in self.id_of.items():
            node = self.trie
            for c in reversed(piece):
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1:] = at, 1.0 if self.merges else -self.score[at]
        self.longest = max(map(len, self.id_of))
        self.dearest = 1.0 if self.merges else PENALTY - min(self.score[i] for i in self.id_of.values())

    def shortest(self, word: str) -> list[tuple[int, int]]:
        """(end, label) along the shortest path through the composition, in the tropical semiring.

        The label of a character without a piece is -2 less its code. A place of the word is met in one state of the
        merges at most, so a state of the composition is a place: merging splits each beginning of a word in one way.
        Ties go to the arc that begins first.
        """
        if self.trie is None:
            self.link()
        size, trie, merges, longest, inf = len(word), self.trie, self.merges, self.longest, math.inf
        known = merges.known if merges else {}
        weight, labels, begins = [0.0] + [inf] * size, [-1] * (size + 1), [0] * (size + 1)
        back = word[::-1]
        for end in range(1, size + 1):
            node, arcs, begin = trie, [], end
            for c in back[size - end : size - end + longest]:
                node = node[0].get(c)
                if node is None:
                    break
                begin -= 1
                if node[1] >= 0:
                    arcs.append((begin, node))
            if not arcs or arcs[0][0] != end - 1:
                arcs.insert(0, (end - 1, (None, -2 - ord(word[end - 1]), self.dearest)))
            if merges is not None:
                # the first finite arc is the only one
                for begin, node in reversed(arcs):
                    last, label = labels[begin], node[1]
                    apart = known.get((last + 1 << 24) + label) if last >= -1 and label >= 0 else None
                    if (merges.weight(last, label) if apart is None else apart) < inf:
                        weight[end], labels[end], begins[end] = weight[begin] + node[2], label, begin
                        break
            else:
                least = inf
                for begin, node in reversed(arcs):
                    total = weight[begin] + node[2]
                    if total < least:
                        least, labels[end], begins[end] = total, node[1], begin
                weight[end] = least
        if weight[size] == inf:
            raise ValueError("no path")
        out, at = [], size
        while at:
            out.append((at, labels[at]))
            at = begins[at]
        return out[::-1]

    def path_of(self, word: str) -> list[str]:
        """The pieces of the shortest path, as the word spells them."""
        ends = [end for end, _ in self.shortest(word)]
        return [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def parts(self, word: str) -> list[str]:
        """A word cut where no piece could go across."""
        touching, out, at = self.touching, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in touching:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for _, label in self.shortest(word):
            if label >= 0:
                out.append(label)
            elif self.bytes_at:
                out += [self.bytes_at[b] for b in chr(-2 - label).encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def learn(self, word: str) -> bytes:
        parts = self.parts(word)
        if len(parts) == 1 or not self.bytes_at:  # without bytes, characters without a piece side by side are one id
            return array("i", self.ids(word)).tobytes()
        out = []
        for part in parts:
            found = self.recent.get(part) or self.before.get(part)
            if found is None:
                found = array("i", self.ids(part)).tobytes()
                if len(part) <= MEMO_CHARS:
                    self.recent[part] = found
            out.append(found)
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self.compile()
        if len(self.recent) > MEMO_WORDS:
            self.before, self.recent = self.recent, {}
        split = [self.words.findall(self.normalise(t or "")) for t in texts]
        fresh = set().union(*split).difference(self.recent)
        for w in fresh:
            found = self.before.get(w)
            self.recent[w] = self.learn(w) if found is None else found
        out = [b"".join(map(self.recent.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > MEMO_CHARS:
                self.recent.pop(w, None)
        return out

    def decode(self, ids: bytes) -> str:
        self.compile()
        found = np.frombuffer(ids, "<i4").astype(np.int64)
        found = np.where((found < 0) | (found >= len(self.spelled_sizes) - 1), len(self.spelled_sizes) - 1, found)
        sizes = self.spelled_sizes[found]
        ends = np.cumsum(sizes)
        place = np.arange(sizes.sum()) + np.repeat(self.spelled_at[found] - (ends - sizes), sizes)
        text = self.spelled[place].tobytes().decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.normalise.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: Transducer) -> DataFrame:
    """doc_id, ids (array of int) of each row."""
    return _mapped(docs, model, "ids array<int>", lambda ids, text: {"ids": pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32()))})


def round_trip(docs: DataFrame, model: Transducer) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_sha256, same (decoding gave the text back)."""

    def digest(ids: list[bytes], texts: list[str | None]) -> dict[str, pa.Array]:
        back = [model_of().decode(i) for i in ids]
        return {
            "n_ids": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
            "decoded_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()), "same": pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)], pa.bool_()),
        }

    shared = docs.sparkSession.sparkContext.broadcast(model)
    model_of = lambda: shared.value
    return _mapped(docs, model, "n_ids bigint, ids_crc32 bigint, decoded_sha256 string, same boolean", digest, shared)


def _mapped(docs: DataFrame, model: Transducer, fields: str, made, shared=None) -> DataFrame:
    shared = shared or docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = column(batch, "text").to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id")} | made(shared.value.encode(texts), texts))

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {fields}")
