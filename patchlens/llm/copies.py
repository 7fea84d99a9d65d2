"""Near copies: texts linked by the exact Jaccard similarity of their sets of word shingles.

Texts with equal sets are one. Candidates come in two steps. At a similarity of 0.8 a fingerprint of either text differs
in so many bits that a vantage-point tree over all of them prunes nothing; so sets are first dealt to shards by bands of
min-hashes of the same shingles, which two sets of similarity s share with a chance of 1 - (1 - s^ROWS)^BANDS: 0.9995 at
0.8, 0.22 at 0.5, 0.015 at a third. A shard that has the members of another one is dropped. Within a shard vantage-point
trees over SimHash fingerprints, each shingle voting once, find the pairs within reach; a shard of more than MEMBERS sets
is taken as it is. What these links join, through any number of them, is one candidate group, and every pair inside a
group that no link joins yet is compared by its sets. A group of up to BLOCK sets is compared in one task. In a larger
one, members are first compared with a few hubs; only those that no hub is linked with (the rest) then meet all members,
block by block, so a group of copies never becomes all its pairs. Links come as spanning forests.

Work and bytes grow with the number of distinct texts (BANDS rows of two longs each), not with its square.

Null and empty texts and texts without words have the empty set and are copies of each other and of nothing else; a
text with fewer words than a shingle has one shingle. Rows with equal texts are one set, however many; an empty table
gives no rows. A long text is shingled whole, its votes and min-hashes in bounded pieces.
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
from .graph import LEAST, apart, components, hottest, lookup, near, union
from .simhash import ASCII_LOWER, forest

#: Sets of a group that are compared in one task; so many times that on each side of a task in larger groups; hubs of these.
BLOCK, SIDE, HUBS = 256, 4, 3
#: 64-bit parts of a fingerprint.
PARTS = 3
NAMES = [f"f{k}" for k in range(PARTS)]
#: Bits of a fingerprint are voted by so many shingles at once, and so many are min-hashed at once.
VOTES, HASHED = 1 << 15, 256
#: Bands of min-hashes, and min-hashes of a band.
BANDS, ROWS = 32, 7
#: Sets of a shard that are searched in one task; rows of shards in a task, about.
MEMBERS, TASK_ROWS = 4096, 8192
#: Shingles of the sets that a task compares, about; groups that are broadcast at most.
SHINGLES, HOT_GROUPS = 500_000, 64
_rng = np.random.default_rng(11)
TIMES, PLUS = (_rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1) for _ in range(2))
MIX = _rng.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Hashes [n, 3] of a text's distinct shingles, in order of their first parts, which tell them apart."""
    parts = text.translate(ASCII_LOWER).split()
    if not parts:
        return np.zeros((0, PARTS), np.uint64)
    many = max(1, len(parts) - size + 1)
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.append(0, ends[:-1]).tolist()[:many]
    last = (ends - 1).tolist()[min(size, len(parts)) - 1 :]
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(starts, last, strict=True)]), "<u8").reshape(-1, 2)
    hashes = hashes[np.unique(hashes[:, 0], return_index=True)[1]]
    # a third part mixed from the two (splitmix64)
    more = hashes[:, 0] ^ (hashes[:, 1] * np.uint64(0x9E3779B97F4A7C15))
    more = (more ^ (more >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    more = (more ^ (more >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.column_stack([hashes, more ^ (more >> np.uint64(31))])


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit parts: the majority of the distinct shingles, bit by bit."""
    votes = np.zeros(64 * PARTS, np.int64)
    for at in range(0, len(hashes), VOTES):
        votes += np.unpackbits(np.ascontiguousarray(hashes[at : at + VOTES]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")


def banded(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of min-hashes; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    low = hashes[:, 1].astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), HASHED):
        np.minimum(least, (low[at : at + HASHED] * TIMES + PLUS).min(1), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for part, by in zip(least.reshape(BANDS, ROWS).T, MIX, strict=True):
        keys = (keys ^ part) * by
        keys ^= keys >> np.uint64(29)
    return keys


def named(hashes: np.ndarray) -> int:
    """64 bits that stand for the set."""
    return xxhash.xxh3_64_intdigest(hashes[:, 0].tobytes())


def printed(docs: DataFrame, size: int) -> DataFrame:
    """key, set (a hash of the set of shingles), the fingerprint f0, f1, f2 and the bands of each row of docs (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(t or b"", size) for t in column(batch, "text").cast(pa.binary()).to_pylist()]
            whole = np.array([named(x) for x in found], np.uint64)
            bits = np.stack([fingerprint(x) for x in found])
            bands = [banded(x) for x in found]
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            out = {"key": column(batch, "key"), "set": pa.array(whole.view(np.int64))} | {n: pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k, n in enumerate(NAMES)}
            yield pa.RecordBatch.from_pydict(out | {"bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands).view(np.int64)))})

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, set bigint, {', '.join(f'{n} bigint' for n in NAMES)}, bands array<bigint>")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """set, group, n and the shingles of each row of docs (set, group, n, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(t or b"", size)[:, 0] for t in column(batch, "text").cast(pa.binary()).to_pylist()]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_pydict({c: column(batch, c) for c in ("set", "group", "n")} | {"shingles": pa.ListArray.from_arrays(pa.array(offsets), values)})

    return docs.mapInArrow(run, "set bigint, group bigint, n bigint, shingles array<bigint>")


def candidates(every: DataFrame, reach: int, members: int = MEMBERS) -> DataFrame:
    """Forest edges (src, dst) of sets that share a band and whose fingerprints differ in at most `reach` bits.

    every: set, f0, f1, f2, bands, cut. Sets of a shard of more than `members` are linked whatever their fingerprints.
    """
    dealt = every.select("set", F.posexplode("bands").alias("_k", "_band")).select("set", F.xxhash64("_k", "_band").alias("shard"))
    most = BANDS * every.count()
    counted = cut(dealt.groupBy("shard").agg(F.count("*").alias("n"), F.min("set").alias("low"), F.bit_xor("set").alias("all")).filter("n > 1"), most // 2)
    prints = every.select("set", *NAMES)
    # a shard of two is its least set and what is left of it
    two = counted.filter("n = 2").select(F.col("low").alias("src"), F.col("low").bitwiseXOR(F.col("all")).alias("dst")).distinct()
    for end in ("src", "dst"):
        two = two.join(prints.select(F.col("set").alias(end), F.struct(*NAMES).alias(f"_{end}")), end)
    differ = sum((F.bit_count(F.col(f"_src.{n}").bitwiseXOR(F.col(f"_dst.{n}"))) for n in NAMES), F.lit(0))
    two = two.filter(differ <= reach).select("src", "dst")
    # shards with the same members are one
    shards = cut(counted.filter("n > 2").groupBy("n", "low", "all").agg(F.min("shard").alias("shard")).select("shard", "n", "low"), most // 3)
    few = near(shards)
    placed = cut(dealt.join(few, "shard") if few is not shards else lookup(dealt, shards, "shard", hottest(shards, "n")), most)
    large = placed.filter((F.col("n") > members) & (F.col("set") != F.col("low"))).select(F.col("set").alias("src"), F.col("low").alias("dst"))
    rows = placed.filter(F.col("n") <= members).select("shard", "set").join(prints, "set")
    tasks = max(1, -(-placed.count() // TASK_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        name, points = pdf["set"].to_numpy(), pdf[NAMES].to_numpy(np.int64).view(np.uint64)
        first = np.flatnonzero(np.append(True, np.diff(pdf["shard"].to_numpy()) != 0))
        sizes = np.diff(np.append(first, len(name)))
        src, dst = [], []
        for at, many in zip(first.tolist(), sizes.tolist(), strict=True):
            root = forest(points[at : at + many], np.ones(many, bool), reach)
            moved = np.flatnonzero(root != np.arange(many))
            src.append(name[at + moved])
            dst.append(name[at + root[moved]])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    found = rows.groupBy(F.pmod(F.xxhash64("shard"), F.lit(tasks)).alias("_task")).applyInPandas(run, "src bigint, dst bigint")
    return two.unionByName(found).unionByName(large)


def linked(found: list[np.ndarray], asked: np.ndarray, joined: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """For each set the first that it is linked with, through any number of links of asked sets; joined: those known to be one."""
    over, under = least
    root = np.arange(len(found))
    root[joined] = np.flatnonzero(joined)[0] if joined.any() else 0
    sizes = np.array([len(x) for x in found])
    owner = np.repeat(np.arange(len(found)), sizes)
    _, name = np.unique(np.concatenate(found), return_inverse=True)
    posts = owner[np.argsort(name, kind="stable")]
    counts = np.bincount(name, minlength=1)
    ends = np.cumsum(counts)
    at = np.append(0, np.cumsum(sizes))
    for a in np.flatnonzero(asked):
        if (root == root[a]).all():
            continue
        mine = name[at[a] : at[a + 1]]
        many = counts[mine]
        first = np.repeat(ends[mine] - np.cumsum(many), many)
        both = np.bincount(posts[first + np.arange(many.sum())], minlength=len(found))
        # both / (all - both) >= over / under
        near = np.flatnonzero(((under + over) * both >= over * (sizes + sizes[a])) & (both > 0) & (root != root[a]))
        if len(near):
            union(root, np.full(len(near), a), near)
    return root


def compared(jobs: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Forest edges (src, dst) of jobs: group, i, j, set, shingles, asked, joined; a set may come twice, as asked and not.

    A task takes many jobs, of SHINGLES shingles together, about.
    """
    total = jobs.agg(F.sum(F.size("shingles") + 1)).first()[0] or 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, job in pdf.groupby(["group", "i", "j"], sort=False):
            job = job.sort_values("asked", ascending=False).drop_duplicates("set")
            name = job["set"].to_numpy()
            root = linked([np.asarray(x, np.int64) for x in job["shingles"]], job["asked"].to_numpy(bool), job["joined"].to_numpy(bool), least)
            moved = root != np.arange(len(root))
            src.append(name[moved])
            dst.append(name[root[moved]])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    task = F.pmod(F.xxhash64("group", "i", "j"), F.lit(max(1, -(-total // SHINGLES))))
    return jobs.groupBy(task.alias("_task")).applyInPandas(run, "src bigint, dst bigint")


def beside(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with what a table of groups (group, ..., _n: their sizes) says."""
    table = cut(table)
    return lookup(rows, table, "group", hottest(table, "_n", HOT_GROUPS), "left").drop("_n")


def large(rows: DataFrame, least: tuple[int, int], block: int) -> DataFrame:
    """Edges (src, dst) that give the components of groups of more than `block` sets; rows: set, group, n, shingles."""
    over, under = least
    rows = rows.withColumn("hub", F.lit(None).cast("bigint"))
    found = []
    for _ in range(HUBS):
        # of those that no hub is linked with, the first by hash is the next; a hub meets all members
        hubs = rows.filter("hub IS NULL").groupBy("group").agg(F.min_by(F.struct("set", "shingles"), F.struct(F.xxhash64("set"), "set")).alias("h"), F.max("n").alias("_n"))
        both = F.size(F.array_intersect("shingles", "_shingles"))
        near = (both > 0) & ((under + over) * both >= over * (F.size("shingles") + F.size("_shingles")))
        met = beside(rows, hubs.select("group", F.col("h.set").alias("_set"), F.col("h.shingles").alias("_shingles"), "_n")).withColumn("_to", F.when(near, F.col("_set")))
        met = cut(met.select("set", "group", "n", "shingles", F.coalesce("hub", "_to").alias("hub"), "_to"))
        found.append(met.filter("_to <> set").select(F.col("set").alias("src"), F.col("_to").alias("dst")))
        rows = met.drop("_to")
    # what is linked with the hub of most links is one component already; all others are asked
    main = rows.filter("hub IS NOT NULL").groupBy("group", "hub").agg(F.count("*").alias("_m"), F.max("n").alias("_n"))
    main = main.groupBy("group").agg(F.max(F.struct("_m", "hub"))["hub"].alias("main"), F.max("_n").alias("_n"))
    rows = beside(rows, main).withColumn("joined", F.coalesce(F.col("hub") == F.col("main"), F.lit(False)))
    rows = cut(beside(rows, rows.groupBy("group").agg(F.count_if(~F.col("joined")).alias("rest"), F.max("n").alias("_n"))).filter("rest > 0").select("set", "group", "n", "rest", "shingles", "joined"))
    parts = lambda c: F.ceil(F.col(c) / (SIDE * block)).cast("int")
    place = lambda c: F.pmod(F.xxhash64("set", F.lit(7)), parts(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    asked = rows.filter("NOT joined").select("group", place("rest").alias("i"), each("n").alias("j"), "set", "shingles", F.lit(True).alias("asked"), "joined")
    others = rows.select("group", each("rest").alias("i"), place("n").alias("j"), "set", "shingles", F.lit(False).alias("asked"), "joined")
    out = compared(asked.unionByName(others), least)
    for more in found:
        out = out.unionByName(more)
    return out


def firsts(docs: DataFrame, size: int, least: tuple[int, int], reach: int, block: int = BLOCK) -> DataFrame:
    """The smallest key of each component of near copies; docs: key (any ordered type), text.

    least: the Jaccard similarity of a link, as a fraction; reach: differing bits of candidates at most.
    """
    docs = docs.select("key", F.col("text").cast("string").alias("text"))
    seen = cut(printed(docs, size).groupBy("set", *NAMES).agg(F.min("key").alias("key"), F.any_value("bands").alias("bands")))
    every = apart(seen, "set", NAMES)
    total = every.count()
    group = components(candidates(every, reach)).withColumnRenamed("node", "set").withColumnRenamed("root", "group")
    every = cut(every.select("set", "key").join(group, "set", "left").select("set", "key", F.coalesce("group", "set").alias("group")), total)
    sizes = cut(every.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1"), total)
    some = cut(lookup(every, sizes, "group", hottest(sizes, "n")).select(F.col("key").alias("_key"), "set", "group", F.col("n").cast("bigint").alias("n")), total)
    # rows that share a key are equal: those of the most rows meet a broadcast, where they lie
    few = near(some)
    if few is some:
        many = cut(docs.groupBy("key").agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= LEAST))
        hot = hottest(many.join(some, F.col("key") == F.col("_key")).select(F.col("_key").alias("key"), "set", "group", "n", "_rows"), "_rows")
        texts = lookup(docs, some.select(F.col("_key").alias("key"), "set", "group", "n"), "key", hot)
    else:
        texts = docs.join(few, F.col("key") == F.col("_key"))
    texts = texts.select("set", "group", "n", "text").dropDuplicates(["set"])
    rows = cut(sets(texts, size))
    few = rows.filter(F.col("n") <= block).select("group", F.lit(0).alias("i"), F.lit(0).alias("j"), "set", "shingles", F.lit(True).alias("asked"), F.lit(False).alias("joined"))
    edges = compared(few, least)
    if sizes.filter(F.col("n") > block).limit(1).count():
        edges = edges.unionByName(large(rows.filter(F.col("n") > block), least, block))
    root = components(edges)
    every = every.join(root.withColumnRenamed("node", "set"), "set", "left")
    return every.groupBy(F.coalesce("root", "set").alias("_c")).agg(F.min("key").alias("key")).select("key")
