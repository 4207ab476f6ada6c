"""Clustering of vectors around centroids, with an annulus search for the nearest one.

Vectors and centroids are integers, so every distance, sum and tie is exact. Centroids stand in order of their norms. A
vector's distance to the centroids whose norms are next to its own bounds its distance to the nearest one; by the
triangle inequality that one's norm differs from the vector's by no more than the bound. Binary searches find the
centroids in that ring, ends included, and they alone are compared exactly. The ring is widened by more than its rounding error,
so no centroid and no tie at its border is lost.

On Spark: vectors are written once, as integers. Every round scans them with the centroids in the task's closure (k rows,
a parameter), adds each task's vectors up per centroid, and sums the tasks' sums by a shuffle on (centroid, dimension), so a
centroid that most vectors choose is no hot key. Only k x dimensions totals come to the driver. No state passes from
round to round but the centroids, so a lost executor costs its own tasks.

Edge cases: vectors that are null, of another length, or that hold null or non-finite components take no part. A row
without an id is assigned and counted but never a first centroid. Repeated rows count each; where the hashes of first
centroids tie, the smaller vector comes first. Fewer vectors than k: as many centroids; none: no rows. Squared distances
must fit a long (components within about 180,000 for 64 dimensions), else it is an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import written
from lociflow.llm.topk_search import usable

SCALE = 1024
K = 8
ROUNDS = 10
DIMENSIONS = 64
SEED = 3
#: Neighbours by norm, on each side, whose distances bound a vector's distance to its nearest centroid.
PROBES = 1


class Rings:
    """Centroids in order of their norms."""

    def __init__(self, centroids: np.ndarray) -> None:
        norms = np.sqrt((centroids.astype(float) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.centroids = centroids[self.order]
        self.largest = int(np.abs(centroids).max(initial=0))

    def distances(self, vectors: np.ndarray, place: np.ndarray) -> np.ndarray:
        gap = vectors - self.centroids[place]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, the smaller of those that tie, and the squared distance."""
        m, d = vectors.shape
        if d * (int(np.abs(vectors).max(initial=0)) + self.largest) ** 2 >= 1 << 63:
            raise OverflowError("squared distances do not fit a long")
        norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
        at = np.searchsorted(self.norms, norms)
        bound = np.full(m, np.iinfo(np.int64).max)
        for step in range(-PROBES, PROBES):
            bound = np.minimum(bound, self.distances(vectors, np.clip(at + step, 0, len(self.norms) - 1)))
        reach = np.sqrt(bound.astype(float))
        reach += (reach + norms + self.norms[-1]) * 1e-12 + 1e-6
        first, last = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        best, chosen = np.full(m, np.iinfo(np.int64).max), np.full(m, len(self.norms))
        for step in range(int((last - first).max(initial=0))):
            rows = np.flatnonzero(first + step < last)
            place = first[rows] + step
            distance, number = self.distances(vectors[rows], place), self.order[place]
            closer = (distance < best[rows]) | ((distance == best[rows]) & (number < chosen[rows]))
            best[rows[closer]], chosen[rows[closer]] = distance[closer], number[closer]
        return chosen, best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    rows = batch.num_rows
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 1), np.int64)


def _totals(vectors: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums of the vectors nearest to each centroid by (centroid, dimension); their number at dimension -1."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings, sums, counts = Rings(centroids), np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch)
            if len(x):
                chosen, _ = rings.nearest(x)
                counts += np.bincount(chosen, minlength=k)
                for c in np.unique(chosen):
                    sums[c] += x[chosen == c].sum(0)
        used = np.flatnonzero(counts)
        total = np.concatenate([counts[used, None], sums[used]], 1).ravel()
        yield pa.record_batch([pa.array(np.repeat(used, d + 1), pa.int32()), pa.array(np.tile(np.arange(-1, d), len(used)), pa.int32()), pa.array(total)], ["c", "i", "total"])

    parts = vectors.select("x").mapInArrow(run, "c int, i int, total long")
    return {(r["c"], r["i"]): r["total"] for r in parts.groupBy("c", "i").agg(F.sum("total").alias("total")).collect()}


def fit(vectors: DataFrame, seed: int = SEED, k: int = K, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds over (vec_id, x): first the k vectors of smallest sha256 of ``seed:vec_id``, then the
    means of the vectors nearest to each, rounded down; a centroid without vectors stays."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").orderBy(rank, "x").limit(k).select("x").collect()
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds if len(centroids) else 0):
        totals = _totals(vectors, centroids)
        for c in range(len(centroids)):
            if n := totals.get((c, -1)):
                centroids[c] = [totals[c, i] // n for i in range(centroids.shape[1])]
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) for (vec_id, x): the nearest centroid of each vector."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = Rings(centroids)
        for batch in batches:
            if batch.num_rows:
                chosen, distance = rings.nearest(_matrix(batch))
                yield pa.record_batch([batch.column("vec_id"), pa.array(chosen, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def clusters(rows: DataFrame, vector: str = "embedding", seed: int = SEED, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia (sums of distances over the cluster
    and over all), centroid_sha256 (of the cluster's centroid, as integers joined by commas)."""
    spark = rows.sparkSession
    kept = rows.where((F.size(vector) == dimensions) & usable(F.col(vector)))
    vectors = written(kept.select("vec_id", F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x")))
    centroids = fit(vectors, seed, k, rounds)
    if not len(centroids):
        # Rows without an id alone: nothing to be a centroid.
        return vectors.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    found = written(assigned(vectors, centroids))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid, so its size is bounded by k.
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """DuckDB SQL for ``clusters`` of all embeddings: every round is a table."""
    nearest = """SELECT v.r, v.vec_id, v.x, min_by(c.c, (list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.c)) AS c,
    min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))::BIGINT AS distance FROM v, {at} c GROUP BY ALL"""
    out = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL QUALIFY c < {K}
)"""
    for n in range(ROUNDS):
        out += f""", a{n} AS MATERIALIZED ({nearest.format(at=f"c{n}")}), d{n} AS (
  SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{n}, generate_series(1, {DIMENSIONS}) g(i) GROUP BY c, i
), c{n + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM d{n} GROUP BY c) m USING (c)
)"""
    return out + f""", a AS MATERIALIZED ({nearest.format(at=f"c{ROUNDS}")})
SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a JOIN c{ROUNDS} k USING (c)
"""
