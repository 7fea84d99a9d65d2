"""Near-duplicates by SimHash: exact Hamming neighbours through vantage-point trees.

A text's fingerprint is the majority vote, bit by bit, of the hashes of its word shingles. Distinct fingerprints are
dealt to shards by a vantage-point tree, built on the driver from a sample of bounded size: a node sends what lies
within a radius of its vantage point inside and the rest outside. A fingerprint that the triangle bound lets have
neighbours across a boundary is also sent over as a query; as each pair needs one meeting, only the inner side crosses.
A shard with more rows than a task should hold is dealt again into parts: its points at home into some pieces, its
queries into others, and every piece meets every other. Within a part a tree of the same kind prunes the search down to small tiles that are compared in full. A part returns a
spanning forest of its links, at most a row for each of its fingerprints, however dense they lie; the components of
these forests are found by distributed rounds.

Null and empty texts and texts without words have fingerprint zero and are linked with each other like any others.
Rows with equal ids stay separate rows; the smallest doc_id of a component names it (null if it has none). Equal texts
are one fingerprint, however many. A long text is hashed whole, a bounded number of shingles at a time. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, slices
from .graph import components, hottest, lookup, union

SEED = 42
#: Fingerprints that the driver sees to build the tree.
SAMPLE = 16_384
#: Fingerprints at home in a shard, queries in a part of one, and points and queries that are compared in full at once.
HOME, QUERIES, TILE, ASKED = 4096, 32_768, 256, 512
#: Points at home of a part, at most about: more than a leaf should have, reached only where the sample has no more leaves.
PIECE = 8 * HOME
#: The least number of shards, so that a task never holds a large share of the rows.
SHARDS = 32
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = 3, words: int = 1) -> np.ndarray:
    """Unsigned 64-bit parts of the fingerprint; the part k votes with hashes of seed SEED + k."""
    parts = text.translate(ASCII_LOWER).split()  # bytes.split() splits at space and \\t \\n \\v \\f \\r
    if not parts:
        return np.zeros(words, np.uint64)
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.append(0, ends[:-1]).tolist()
    last = (ends - 1).tolist()
    many = max(1, len(parts) - shingle + 1)
    spans = list(zip(starts[:many], last[min(shingle, len(parts)) - 1 :], strict=True))
    out = np.empty(words, np.uint64)
    for k in range(words):
        digest = xxhash.xxh64_intdigest
        votes = np.zeros(64, np.int64)
        for at in range(0, many, 1 << 15):
            hashes = np.array([digest(whole[a:b], SEED + k) for a, b in spans[at : at + (1 << 15)]], "<u8")
            votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(votes * 2 > many, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id and f0, f1, ... (the fingerprint's parts as signed longs) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.stack([fingerprint(t or b"", shingle, words) for t in column(batch, "text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id")} | {f"f{k}": pa.array(found[:, k].view(np.int64)) for k in range(words)})

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"f{k} bigint" for k in range(words))]))


def distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints [..., part]."""
    return np.bitwise_count(points ^ to).sum(-1, dtype=np.int16)


class Tree:
    """Vantage points and radii down to numbered leaves."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 3):
        self.nodes: list[tuple] = []  # (vantage, radius, inner, outer), or (None, leaf, 0, 0)
        self.leaves = 0
        self.build(sample, max(1, len(sample) // max(1, leaves)), np.random.default_rng(seed))

    def build(self, points: np.ndarray, most: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append((None, self.leaves, 0, 0))
        best = None
        if len(points) > most:
            for vantage in points[rng.choice(len(points), min(8, len(points)), replace=False)]:
                away = distance(points, vantage)
                radius = int(np.median(away))
                if (away > radius).any() and (best is None or away.std() > best[0]):
                    best = (away.std(), vantage, radius, away <= radius)
        if best is None:
            self.leaves += 1
            return at
        _, vantage, radius, inside = best
        inner = self.build(points[inside], most, rng)
        self.nodes[at] = (vantage, radius, inner, self.build(points[~inside], most, rng))
        return at

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, at home) for every leaf that a point must meet."""
        found = []
        queue = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while queue:
            node, rows, home = queue.pop()
            vantage, radius, inner, outer = self.nodes[node]
            if vantage is None:
                found.append((rows, np.full(len(rows), radius), home))
                continue
            away = distance(points[rows], vantage)
            inside = np.where(home, away <= radius, away <= radius + reach)
            outside = away > radius - reach
            crossing = home & inside & outside
            for child, goes, own in ((inner, inside, home), (outer, outside, home & ~crossing)):
                if goes.any():
                    queue.append((child, rows[goes], own[goes]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def meet(home: np.ndarray, queries: np.ndarray, reach: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(home rows, query rows) of all pairs within reach, tile by tile."""
    queue = [(np.arange(len(home)), np.arange(len(queries)))]
    # these stay in the cache
    differ, counts, more = (np.empty(TILE * ASKED, kind) for kind in (np.uint64, np.uint8, np.uint8))
    while queue:
        rows, asked = queue.pop()
        if not len(asked):
            continue
        if len(rows) > TILE:
            vantage = home[rows[rng.integers(len(rows))]]
            away = distance(home[rows], vantage)
            radius = int(np.median(away))
            inside = away <= radius
            from_ = distance(queries[asked], vantage)
            into, out = from_ <= radius + reach, from_ > radius - reach
            # a split that keeps nearly all queries on both sides only costs
            if not inside.all() and into.sum() + out.sum() < 1.9 * len(asked):
                queue += [(rows[inside], asked[into]), (rows[~inside], asked[out])]
                continue
        for k in range(0, len(rows), TILE):
            part = rows[k : k + TILE]
            for j in range(0, len(asked), ASKED):
                some = asked[j : j + ASKED]
                shape = len(part), len(some)
                bits, near = (x[: shape[0] * shape[1]].reshape(shape) for x in (differ, counts))
                for word in range(home.shape[1]):
                    np.bitwise_xor(home[part, word][:, None], queries[some, word], out=bits)
                    if word:
                        near += np.bitwise_count(bits, out=more[: bits.size].reshape(shape))
                    else:
                        np.bitwise_count(bits, out=near)
                found = np.flatnonzero(near <= reach)
                if len(found):
                    yield part[found // shape[1]], some[found % shape[1]]


def forest(points: np.ndarray, home: np.ndarray, reach: int) -> np.ndarray:
    """For each of the distinct points of a part the row of the first it is linked with, through any number of links."""
    root = np.arange(len(points))
    at_home = np.flatnonzero(home)
    for a, b in meet(points[at_home], points, reach, np.random.default_rng(5)):
        union(root, at_home[a], b)
    return root


def links(distinct: DataFrame, reach: int, words: int = 1, home: int = HOME) -> DataFrame:
    """Forest edges (src, dst) between distinct fingerprints `node`, f0, ... at `reach` or fewer differing bits."""
    spark = distinct.sparkSession
    names = [f"f{k}" for k in range(words)]
    total = distinct.count()
    seen = distinct.orderBy(F.xxhash64(*names), *names).limit(SAMPLE).select(*names).collect()
    sample = np.array([tuple(r) for r in seen], np.int64).reshape(-1, words).view(np.uint64)
    tree = Tree(sample, max(SHARDS, -(-total // home)))
    _, leaf, own_leaf = tree.route(sample, reach) if len(sample) else (None, np.zeros(0, np.int64), np.zeros(0, bool))
    share = total / max(1, len(sample))
    pieces = lambda rows, most: np.maximum(1, np.ceil(np.bincount(rows, minlength=max(1, tree.leaves)) * share / most)).astype(np.int64)
    dealt = spark.sparkContext.broadcast((tree, pieces(leaf[own_leaf], PIECE), pieces(leaf, QUERIES)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, homes, asks = dealt.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = np.stack([np.asarray(column(batch, n)) for n in names], 1).view(np.uint64)
            every = np.asarray(column(batch, "node"))
            point, to, at_home = own.route(points, reach)
            # parts of a shard: (piece of what is at home, piece of all queries); a point at home asks the other pieces
            h, q = homes[to], asks[to]
            copies = np.where(at_home, q + h - 1, h)
            nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            point, to, at_home, h, q = (np.repeat(x, copies) for x in (point, to, at_home, h, q))
            nodes = every[point].view(np.uint64)
            piece, asking = (nodes % h.astype(np.uint64)).astype(np.int64), ((nodes >> np.uint64(20)) % q.astype(np.uint64)).astype(np.int64)
            staying = at_home & (nth < q)
            other = nth - q
            i = np.where(staying, piece, np.where(at_home, other + (other >= piece), nth))
            j = np.where(staying, nth, asking)
            out = {"leaf": pa.array(to.astype(np.int32)), "part": pa.array(i * q + j, pa.int64()), "home": pa.array(staying), "node": pa.array(nodes.view(np.int64))}
            yield pa.RecordBatch.from_pydict(out | {n: pa.array(points[point, k].view(np.int64)) for k, n in enumerate(names)})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf[names].to_numpy(np.int64).view(np.uint64)
        node = pdf["node"].to_numpy()
        root = forest(points, pdf["home"].to_numpy(bool), reach)
        linked = root != np.arange(len(root))
        return pd.DataFrame({"src": node[linked], "dst": node[root[linked]]})

    fields = ", ".join(f"{n} bigint" for n in names)
    sent = distinct.select("node", *names).mapInArrow(route, f"leaf int, part bigint, home boolean, node bigint, {fields}")
    return sent.groupBy("leaf", "part").applyInPandas(search, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 3, words: int = 1, home: int = HOME) -> DataFrame:
    """doc_id, f0, ..., component_id for each row of docs."""
    names = [f"f{k}" for k in range(words)]
    printed = fingerprints(docs, shingle, words)
    node = F.col("f0") if words == 1 else F.xxhash64(*names)
    printed = cut(printed.withColumn("node", node))
    distinct = cut(printed.groupBy("node", *names).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    found = components(links(distinct, reach, words, home))
    # the smallest doc_id of each component, then of each fingerprint
    member = cut(distinct.select("node", "first").join(found, "node"))
    least = cut(member.groupBy("root").agg(F.min("first").alias("_id"), F.count("*").alias("_n")))
    named = lookup(member.select("node", "root"), least.select("root", "_id"), "root", hottest(least, "_n")).select("node", "_id")
    every = cut(distinct.select("node", "first", "rows").join(named, "node", "left").select("node", F.coalesce("_id", "first").alias("component_id"), "rows"))
    return lookup(printed, every.select("node", "component_id"), "node", hottest(every, "rows")).select("doc_id", *names, "component_id")
