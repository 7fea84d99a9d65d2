"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors of a label are one class with a count. Each class's unit vector is quantised once, to int8 with a scale;
only these codes travel. The classes of a label are dealt by a hash to blocks of bounded size, SUPER blocks make a super
block, and each pair of super blocks is one task, which multiplies them block by block. The norm of what quantising
drops bounds the error of every product: for u = a + e and v = b + f with products of a and b known,
|u.v - a.b| <= |e| (|b| + |f|) + |a| |f|. Products certainly below the threshold are done, products certainly above it
are links. What lies in between stays open: a tile names the classes that have an open product in it, never the pairs,
and these classes' vectors are fetched to be compared again in double precision. A task returns, for each class with
links, their number and one edge of a spanning forest.

Codes are integers, so their products are exact in whichever way they are summed; they are multiplied as float32, whose
24 bits hold every sum, because numpy has no fast integer product. Shuffled bytes: one a component and 40 a class, as
often as a label has super blocks.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing: no links, a component of their own. Vectors of different sizes do not link. Repeated rows are separate
vectors. The smallest vec_id of a component names it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut
from .graph import apart, components, hottest, lookup, union

THRESHOLD = 0.93
#: Classes of a block, about, and blocks of a super block.
BLOCK, SUPER = 1024, 16
#: What rounding in double precision may add to a product of unit vectors.
SLACK = 1e-9
#: Products that are computed again at a time.
AGAIN = 1 << 15
#: A class's quantised form: codes, scale, norm of the quantised vector, norm of what was dropped.
PARTS = ("codes", "scale", "norm", "lost")


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale, norm of the quantised vector and norm of what was dropped, of each unit vector."""
    top = np.abs(vectors).max(1, keepdims=True)
    unit = vectors / top  # large and small components stay within range
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    back = small * scale[:, None]
    return small, scale, np.sqrt((back * back).sum(1)), np.sqrt(((unit - back) ** 2).sum(1))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, in double precision."""
    x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def judged(x: tuple, y: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, open products) of quantised rows, as matrices."""
    (a, s, n, e), (b, t, m, f) = x, y
    # sums of int8 products stay below 2**24 up to 1,040 components
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    about = (a.astype(kind) @ b.astype(kind).T) * (s[:, None] * t)
    error = e[:, None] * (m + f) + n[:, None] * f + SLACK
    sure = about - error >= threshold
    return sure, ~sure & (about + error >= threshold)


def again(x: np.ndarray, y: np.ndarray, open_: np.ndarray, threshold: float) -> np.ndarray:
    """The links among open products, in double precision."""
    out = np.zeros_like(open_)
    at, to = np.nonzero(open_)
    for k in range(0, len(at), AGAIN):
        i, j = at[k : k + AGAIN], to[k : k + AGAIN]
        out[i, j] = cosine(x[i], y[j]) >= threshold
    return out


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with its class `node` (null if it links with nothing), and a row for each class; both cut."""
    kind = vectors.schema["embedding"].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    whole = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(whole, lambda x: x != 0)
    # a negative zero equals zero
    rows = vectors.select("vec_id", "label", F.when(F.coalesce(sound, F.lit(False)), F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))).alias("embedding"))
    rows = rows.withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")))
    hashed = cut(rows.filter("node is not null").groupBy("node", "label", "embedding").agg(F.count("*").alias("rows"), F.min("vec_id").alias("first")))
    found = apart(hashed, "node", ["label", "embedding"])
    if found is not hashed:
        moved = found.select(F.xxhash64("label", "embedding").alias("node"), "label", "embedding", F.col("node").alias("_fresh")).filter("node <> _fresh")
        rows = rows.join(F.broadcast(moved), ["node", "label", "embedding"], "left").withColumn("node", F.coalesce("_fresh", "node"))
    return cut(rows.select("vec_id", "node")), found.withColumn("dims", F.size("embedding")).withColumn("kind", F.xxhash64("label", "dims"))


def quantised(found: DataFrame) -> DataFrame:
    """label, dims, kind, node, rows and the quantised form of each class."""
    label = found.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(column(batch, "dims"))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                vectors = np.asarray(column(part, "embedding").flatten(), np.float64).reshape(-1, d)
                small, *rest = quantise(vectors)
                own = {c: column(part, c) for c in ("label", "dims", "kind", "node", "rows")}
                yield pa.RecordBatch.from_pydict(own | {"codes": pa.array([x.tobytes() for x in small], pa.binary())} | {c: pa.array(x) for c, x in zip(PARTS[1:], rest, strict=True)})

    return found.select("label", "dims", "kind", "node", "rows", "embedding").mapInArrow(run, f"label {label}, dims int, kind bigint, node bigint, rows bigint, codes binary, scale double, norm double, lost double")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    rows, found = classes(vectors)
    label = found.schema["label"].dataType.simpleString()
    sizes = cut(found.groupBy("kind").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("_n")))
    dealt = lookup(quantised(found), sizes.select("kind", "blocks"), "kind", hottest(sizes, "_n"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    numbers = {"nodes": ("node", np.int64), "counts": ("rows", np.int64)} | {c: (c, np.float64) for c in PARTS[1:]}

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row for a block."""
        row = {c: pdf[c].iat[0] for c in ("label", "dims", "kind", "block", "blocks")} | {"codes": b"".join(pdf["codes"])}
        return pd.DataFrame([row | {c: pdf[own].to_numpy(kind).tobytes() for c, (own, kind) in numbers.items()}])

    packed = dealt.groupBy("label", "dims", "kind", "block").applyInPandas(pack, f"label {label}, dims int, kind bigint, block int, blocks int, codes binary, {', '.join(f'{c} binary' for c in numbers)}")
    own = F.floor(F.col("block") / SUPER).cast("int")
    each = packed.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / SUPER).cast("int"))))
    pairs = each.select("label", "dims", "kind", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "block", "codes", *numbers)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        d, i, j = int(pdf["dims"].iat[0]), pdf["i"].iat[0], pdf["j"].iat[0]
        nodes = [np.frombuffer(x, np.int64) for x in pdf["nodes"]]
        counts = [np.frombuffer(x, np.int64) for x in pdf["counts"]]
        forms = [(np.frombuffer(r.codes, np.int8).reshape(-1, d), *(np.frombuffer(getattr(r, c), np.float64) for c in PARTS[1:])) for r in pdf.itertuples()]
        number = pdf["block"].to_numpy()
        starts = np.cumsum([0, *map(len, nodes)])
        total, root, asked = np.zeros(starts[-1], np.int64), np.arange(starts[-1]), []
        for a in np.flatnonzero(number // SUPER == i):
            for b in np.flatnonzero(number // SUPER == j):
                if a > b:
                    continue
                near, open_ = judged(forms[a], forms[b], threshold)
                if a == b:
                    np.fill_diagonal(near, False)
                    np.fill_diagonal(open_, False)
                total[starts[a] : starts[a + 1]] += near @ counts[b]
                if a != b:
                    total[starts[b] : starts[b + 1]] += near.T @ counts[a]
                at, to = np.nonzero(near)
                union(root, starts[a] + at, starts[b] + to)
                for side, x, some in ((0, a, open_.any(1)), (1, b, open_.any(0))):
                    if some.any() and (side == 0 or a != b):
                        asked.append(pd.DataFrame({"node": nodes[x][some], "a": number[a], "b": number[b], "side": side}))
        every, some = np.concatenate(nodes), np.flatnonzero(total)
        out = pd.DataFrame({"node": every[some], "links": total[some], "to": every[root[some]], "a": -1, "b": -1, "side": 0})
        return pd.concat([out, *(x.assign(links=0, to=0) for x in asked)])[["node", "links", "to", "a", "b", "side"]]

    first = cut(pairs.groupBy("label", "dims", "kind", "i", "j").applyInPandas(tile, "node bigint, links bigint, to bigint, a int, b int, side int"))

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        """The open products of a tile, from the vectors of the classes that have any."""
        sides = [pdf[pdf["side"] == k] for k in (0, 1)]
        same = sides[1].empty
        (x, y), left, right = ([np.stack(s["embedding"].to_numpy()).astype(np.float64) for s in ([sides[0]] * 2 if same else sides)]), sides[0], sides[0 if same else 1]
        open_ = judged(quantise(x), quantise(y), threshold)[1]
        if same:
            np.fill_diagonal(open_, False)
        near = again(x, y, open_, threshold)
        total = near @ right["rows"].to_numpy()
        at, to = np.nonzero(near)
        name = left["node"].to_numpy()
        if not same:
            total, name, to = np.concatenate([total, near.T @ left["rows"].to_numpy()]), np.concatenate([name, right["node"].to_numpy()]), to + len(left)
        root = np.arange(len(name))
        union(root, at, to)
        some = np.flatnonzero(total)
        return pd.DataFrame({"node": name[some], "links": total[some], "to": name[root[some]]})

    fetched = first.filter("a >= 0").select("node", "a", "b", "side").join(found, "node")
    second = fetched.groupBy("label", "dims", "kind", "a", "b").applyInPandas(exact, "node bigint, links bigint, to bigint")
    partial = cut(first.filter("a < 0").select("node", "links", "to").unionByName(second))
    known = components(partial.select(F.col("node").alias("src"), F.col("to").alias("dst")))
    counted = partial.groupBy("node").agg(F.sum("links").alias("links"))
    member = cut(found.select("node", "first").join(known, "node"))
    least = cut(member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_n")))
    named = lookup(member.select("node", "root"), least.select("root", "component_id"), "root", hottest(least, "_n")).select("node", "component_id")
    every = cut(
        found.select("node", "first", "rows").join(counted, "node", "left").join(named, "node", "left")
        .select("node", "rows", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    )
    out = lookup(rows.filter("node is not null"), every.drop("rows"), "node", hottest(every, "rows")).select("vec_id", "n_links", "component_id")
    alone = rows.filter("node is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
