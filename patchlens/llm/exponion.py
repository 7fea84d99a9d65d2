"""Centroid clustering with Exponion search.

Components x become integers floor(256 * x), so that distances and means are exact. Every vector carries its centroid, an
upper bound u of the distance to it and a lower bound l of the distance to any other. A vector with u < l, or u under half
of the distance s from its centroid to the nearest other one, keeps its centroid unseen. All others scan only the
centroids inside the ball of radius 2u + s around their own, found in that centroid's list of the others sorted by
distance; what may be nearest or second nearest lies inside. The radius is inclusive and both tests are strict, so
centroids at equal distance are all seen and the smaller number wins, as in a full scan.

A round reads the table of the round before and writes the next one into the shared folder (one copy of the vectors, the
older one is deleted); sums by cluster are added up in the tasks before they are shuffled, so however many vectors a
cluster has, a task sends one row for it. Only centroids, at most k rows, pass through the driver.

Vectors that are null, have another number of components than asked for, or hold null or non-finite ones are left out, and so are
those with a component of 2**19 or more in absolute value, whose squared distances would not fit into 64 bits. Null ids
cannot be hashed: such vectors are clustered, but start no centroid. Vectors with one id are ordered by their components
as starts. Equal vectors get equal results. With fewer vectors than k there are as many centroids as vectors with an id;
without any the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, shared_dir

SCALE = 256
#: Components of integer vectors stay below it: 64 squared differences then fit into 63 bits.
MOST = 1 << 27
#: Share that bounds give way, for their rounding.
SLACK = 1e-9
STATE = "vec_id bigint, q array<int>, cluster int, upper double, lower double, distance bigint"


def integers(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id and q, the integer components of the vectors that are clustered."""
    whole = F.col("embedding").cast("array<double>")
    fit = (F.size(whole) == size) & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST / SCALE))
    return vectors.filter(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("bigint"), F.transform(whole, lambda x: F.floor(SCALE * x).cast("int")).alias("q"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose "seed:vec_id" has the smallest SHA-256."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hashed")
    rows = vectors.filter("vec_id IS NOT NULL").select(hashed, "q").orderBy("hashed", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


class Search:
    """Nearest centroids of vectors. moved: how far each centroid went since the bounds were made, or None: no bounds yet."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centroids = centroids
        k = len(centroids)
        apart = np.sqrt(np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids], np.float64))
        #: for each centroid all of them, itself first, by distance from it
        self.order = np.argsort(apart + np.where(np.eye(k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")
        self.sorted = np.take_along_axis(apart, self.order, axis=1)
        self.nearest = self.sorted[:, 1] if k > 1 else np.full(1, np.inf)
        if before is not None:
            self.moved = np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
            far = np.argsort(self.moved)
            #: the most that any other centroid moved
            self.others = np.where(np.arange(k) == far[-1], self.moved[far[-2]] if k > 1 else 0.0, self.moved[far[-1]])
        #: of the last call: vectors, and distances computed
        self.looked = 0

    def scan(self, q: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest of the centroids among, the squared distance to it, and the distance to the second nearest."""
        squares = np.empty((len(q), len(among)), np.int64)
        for j, c in enumerate(among):
            diff = q - self.centroids[c]
            squares[:, j] = np.einsum("ij,ij->i", diff, diff)
        self.looked += squares.size
        least = squares.min(axis=1)
        best = np.where(squares == least[:, None], among, len(self.centroids)).min(axis=1)
        squares[np.arange(len(q)), np.argmax(among == best[:, None], axis=1)] = np.iinfo(np.int64).max
        second = np.sqrt(squares.min(axis=1).astype(np.float64)) if len(among) > 1 else np.full(len(q), np.inf)
        return best, least, second

    def first(self, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, upper, lower, distance by looking at all centroids."""
        best, least, second = self.scan(q, np.arange(len(self.centroids)))
        return best, np.sqrt(least.astype(np.float64)) * (1 + SLACK), second * (1 - SLACK), least

    def next(self, q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same from the round before."""
        cluster, upper, lower, distance = cluster.copy(), upper + self.moved[cluster], lower - self.others[cluster], distance.copy()
        moved = self.moved[cluster] > 0

        def settled() -> np.ndarray:
            return (upper < lower) | (2 * upper < self.nearest[cluster] * (1 - SLACK))

        # the exact distance first: it is part of the result, and the tighter bound settles more
        open_ = np.flatnonzero(moved)
        diff = q[open_] - self.centroids[cluster[open_]]
        distance[open_] = np.einsum("ij,ij->i", diff, diff)
        self.looked += len(open_)
        upper[open_] = np.sqrt(distance[open_].astype(np.float64)) * (1 + SLACK)
        open_ = np.flatnonzero(~settled())
        radius = (2 * upper[open_] + self.nearest[cluster[open_]]) * (1 + SLACK)
        for a in np.unique(cluster[open_]):
            mine = open_[cluster[open_] == a]
            inside = np.searchsorted(self.sorted[a], radius[cluster[open_] == a], "right")
            # vectors whose balls hold about as many centroids go together
            width = np.maximum(1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(int), 2)
            for w in np.unique(width):
                rows = mine[width == w]
                best, least, second = self.scan(q[rows], self.order[a][: inside[width == w].max()])
                # a ball that holds its own centroid alone has no second nearest within the radius
                beyond = np.where(np.isinf(second), radius_of(upper[rows], self.nearest[a]), second)
                cluster[rows], distance[rows] = best, least
                upper[rows], lower[rows] = np.sqrt(least.astype(np.float64)) * (1 + SLACK), beyond * (1 - SLACK)
        return cluster, upper, lower, distance


def radius_of(upper: np.ndarray, nearest: float) -> np.ndarray:
    """How far at least any centroid outside the ball is from its vector."""
    return upper + nearest


def assigned(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """rows (vec_id, q, and from the second round on their bounds) with their nearest centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = column(batch, "q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            if before is None:
                found = search.first(q)
            else:
                found = search.next(q, *(column(batch, c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower", "distance")))
            cluster, upper, lower, distance = found
            yield pa.record_batch([column(batch, "vec_id"), column(batch, "q"), pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), pa.array(lower, pa.float64()), pa.array(distance, pa.int64())], ["vec_id", "q", "cluster", "upper", "lower", "distance"])

    return rows.mapInArrow(run, STATE)


def summed(values: Column) -> Column:
    return F.sum(values.cast("decimal(38,0)"))


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster's vectors; centroids without any stay."""
    size = centroids.shape[1]
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("q")[i].cast("bigint")) for i in range(size))).alias("sums"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster] = [s // r.n for s in r.sums]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of the vectors of (vec_id, embedding)."""
    spark = vectors.sparkSession
    shared_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/exponion-{uuid.uuid4().hex}"
    rows = integers(vectors, size)
    centroids, before = starts(rows, k, seed), None
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for i in range(rounds + 1):
        assigned(rows, centroids, before).write.parquet(f"{folder}/{i}")
        rows = spark.read.schema(STATE).parquet(f"{folder}/{i}")
        if i:
            discard(spark, f"{folder}/{i - 1}")
        if i < rounds:
            before, centroids = centroids, means(rows, centroids)
    own = {r.cluster: int(r.inertia) for r in rows.groupBy("cluster").agg(summed(F.col("distance")).alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    found = spark.createDataFrame([(c, own[c], sum(own.values()), digests[c]) for c in sorted(own)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def duck_sql(k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> str:
    """The same in DuckDB, by looking at all centroids."""
    squares = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    text = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {MOST // SCALE})) = {size}),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1)::INTEGER AS cluster, q FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {k})"""
    for i in range(rounds + 1):
        text += f""",
a{i} AS MATERIALIZED (SELECT v.vec_id, v.q, unnest(min(struct_pack(distance := {squares}, cluster := c.cluster))) FROM (SELECT *, row_number() OVER () AS r FROM v) v CROSS JOIN c{i} c GROUP BY v.r, v.vec_id, v.q)"""
        if i < rounds:
            text += f""",
m{i} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range({size})) AS i FROM a{i}) GROUP BY cluster, i),
n{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM m{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.q, c.q) AS q FROM c{i} c LEFT JOIN n{i} n USING (cluster))"""
    return text + f"""
SELECT a.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""
