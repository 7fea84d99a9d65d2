"""A quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes, each with a mark if four bytes from it on repeat what stands shortly before, are embedded and cut
into overlapping chunks, WIDTH bytes every STRIDE bytes, over the whole document. Learned filters answer to each chunk, the strongest answer of each filter over the document is kept, and one
logistic unit combines these into a probability. Scoring holds a bounded piece of a document at a time, so very long
texts cost time but no memory.

Null and empty texts are scored as one chunk of padding. Equal texts give equal scores, equal rows stay separate rows.
With labels of one kind only, or none, every score is the share of label 1 in the sample (0.5 for none). An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lengths, slices

WIDTH, STRIDE, DIM, FILTERS = 16, 8, 8, 32
PAD = 256
#: A byte is marked if its four bytes occurred this many bytes before, or fewer.
LAGS = 24
#: Bound of the sample that a model is fitted on: texts of each label, bytes of a text.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 40_000
EPOCHS, BATCH, RATE, DECAY = 10, 50, 0.01, 1e-4
#: Bytes convolved at once.
PIECE = 1 << 19


def symbols(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of texts laid end to end; marked ones are higher by 257."""
    gap = LAGS + 8
    place = np.arange(len(data)) + np.repeat((np.arange(len(sizes)) + 1) * gap, sizes)
    wide = np.zeros(len(data) + (len(sizes) + 1) * gap, np.uint32)
    wide[place] = data
    four = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    seen = np.zeros(len(wide), bool)
    for lag in range(1, LAGS + 1):
        seen[lag : len(four)] |= four[lag:] == four[:-lag]
    return data + np.where(seen[place], 257, 0)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (2 * 257, DIM)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.fixed: float | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weight, self.base]

    def strongest(self, data: np.ndarray, sizes: np.ndarray, going_on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of symbols of texts laid end to end: each filter's strongest answer [text, filter], all answers, the padded symbols, first blocks.

        going_on: texts whose last STRIDE bytes begin no chunk, as the next piece has them.
        """
        blocks = np.maximum(1, -(-sizes // STRIDE)) + 1  # the last is padding: no chunk reaches into the next text
        first = np.cumsum(blocks) - blocks
        padded = np.full(blocks.sum() * STRIDE, PAD, np.int64)
        padded[np.arange(len(data)) + np.repeat(first * STRIDE - (np.cumsum(sizes) - sizes), sizes)] = data
        rows = self.embed[padded].reshape(-1, STRIDE * DIM)
        half = STRIDE * DIM
        answer = rows @ self.filters[:half]
        answer[:-1] += rows[1:] @ self.filters[half:]
        answer[first + blocks - 1] = -np.inf
        if going_on is not None:
            answer[(first + blocks - 2)[going_on]] = -np.inf
        return np.maximum.reduceat(answer, first, axis=0), answer, padded, first

    def combine(self, strongest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.maximum(strongest + self.bias, 0) @ self.weight + self.base).astype(np.float64)))

    def scores(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(sizes), self.fixed)
        # long texts are cut where chunks begin, each piece with the bytes that its last chunk covers
        pieces = np.maximum(1, -(-sizes // PIECE))
        owner = np.repeat(np.arange(len(sizes)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        after = np.cumsum(sizes)[owner]
        starts = after - sizes[owner] + place * PIECE
        ends = np.minimum(starts + PIECE + WIDTH - STRIDE, after)
        # marks look at the LAGS bytes before a byte and at the three after it
        early, late = np.maximum(starts - LAGS, after - sizes[owner]), np.minimum(ends + 3, after)
        best = np.full((len(sizes), FILTERS), -np.inf, np.float32)
        at = 0
        while at < len(owner):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(ends[at:] - starts[at:]), PIECE, "right")) + at)
            wide = late[at:upto] - early[at:upto]
            part = symbols(np.concatenate([data[a:b] for a, b in zip(early[at:upto], late[at:upto], strict=True)]), wide)
            spot = np.arange(len(part)) - np.repeat(np.cumsum(wide) - wide, wide)
            part = part[(spot >= np.repeat((starts - early)[at:upto], wide)) & (spot < np.repeat((ends - early)[at:upto], wide))]
            going_on = place[at:upto] < pieces[owner[at:upto]] - 1
            np.maximum.at(best, owner[at:upto], self.strongest(part, ends[at:upto] - starts[at:upto], going_on)[0])
            at = upto
        return self.combine(best)

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        best, answer, padded, first = self.strongest(symbols(np.frombuffer(b"".join(texts), np.uint8), sizes), sizes)
        off = (self.combine(best) - labels).astype(np.float32) / len(texts)
        active = np.maximum(best + self.bias, 0)
        back = off[:, None] * self.weight * (active > 0)
        ends = np.append(first[1:], len(answer))
        where = np.stack([first[i] + answer[first[i] : ends[i]].argmax(0) for i in range(len(texts))])
        window = padded[where[..., None] * STRIDE + np.arange(WIDTH)]  # [text, filter, byte]
        seen = self.embed[window].reshape(*window.shape[:2], -1)
        embed = np.zeros_like(self.embed)
        np.add.at(embed, window.ravel(), (back[..., None] * self.filters.T).reshape(-1, DIM))
        embed[PAD] = 0
        return [embed, np.einsum("tf,tfx->xf", back, seen), back.sum(0), active.T @ off, np.array([off.sum()], np.float32)]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over mini-batches; the same rows in the same order give the same network."""
    network = Network(seed)
    if len(set(labels.tolist())) < 2:
        network.fixed = float(labels[0]) if len(labels) else 0.5
        return network
    rng = np.random.default_rng(seed)
    parts = network.parts()
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for p, g, m, s in zip(parts, network.gradients([texts[i] for i in rows], labels[rows]), mean, square, strict=True):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return network


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most `rows` texts of each label, the first by a hash of their ids among those of at most `most` bytes.

    A document labelled both ways counts as neither, a repeated id brings one text.
    """
    clear = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    fitting = docs.select("doc_id", F.encode("text", "UTF-8").alias("bytes")).filter(F.length("bytes") <= most)
    known = fitting.select("doc_id").join(clear.select("doc_id", "quality"), "doc_id").distinct()
    ids = [tuple(r) for value in (0, 1) for r in known.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    picked = docs.sparkSession.createDataFrame(ids, known.schema)
    found = fitting.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("bytes").alias("bytes"), F.min("quality").alias("quality")).orderBy("doc_id").collect()
    return [bytes(r["bytes"]) for r in found], np.array([r["quality"] for r in found], np.float64)


def score(docs: DataFrame, network: Network, more: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of `more`, and score, for each row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(network)
    names = list(dict.fromkeys(["doc_id", *(more or [])]))
    picked = docs.select(*names, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            text = column(batch, "_text").fill_null("")
            sizes = lengths(text)
            begin = np.frombuffer(text.buffers()[1], np.int32, 1, text.offset * 4)[0]
            data = np.frombuffer(text.buffers()[2], np.uint8, sizes.sum(), begin) if sizes.sum() else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_pydict({n: column(batch, n) for n in names} | {"score": pa.array(shared.value.scores(data, sizes))})

    return picked.mapInArrow(run, f"{schema}, score double")
