"""Centroid clustering of integer vectors by equal-average equal-variance search.

Vectors become integers by scale and floor.  A search keeps the centroids sorted by their
component sum and scans outward from the vector's own: for vectors of d components, d times
the squared distance is at least (difference of sums)^2, which ends the scan, and at least
that plus (difference of d^0.5 times the lengths about the mean)^2, which rejects a centroid.
What neither rejects is compared by its exact integer distance.  A round sends one partial sum
per task and centroid; only the centroids, k rows, reach the driver.

Defined cases: vectors that are null, of another length, or hold null or non-finite components
are left out; scaled components are limited to +-2^27, so that distances fit a long; a null id
hashes as an empty one; rows that share an id are vectors of their own, ties among the first
centroids go by the components; fewer vectors than k make fewer centroids; a sum of distances
beyond a long is null; no rows, no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

LIMIT = 1 << 27
_LONG = (1 << 63) - 1
_ROUNDING = 1e-9  # share by which a bound in floating point may be off, many times over


def _spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square root of d times the length of each row about its mean, and a bound of its error."""
    d = x.shape[1]
    centred = x - x.mean(axis=1, keepdims=True)
    spread = np.sqrt(d * np.einsum("nd,nd->n", centred, centred))
    return spread, 1e-12 * (spread + d * (1.0 + np.abs(x).max(axis=1)))


class Centroids:
    """Centroids sorted by component sum for the search of nearest ones."""

    def __init__(self, points: np.ndarray):
        self.number = np.argsort(points.sum(axis=1), kind="stable")
        self.points = points[self.number]
        self.sums = self.points.sum(axis=1).astype(np.float64)
        self.spread, self.slack = _spread(self.points)
        self.compared = 0  # exact distances so far

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smallest) and the squared distance, for each row."""
        k, d = self.points.shape
        sums = x.sum(axis=1).astype(np.float64)
        spread, slack = _spread(x)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best = np.full(len(x), _LONG)
        number = np.full(len(x), k)
        rows = np.arange(len(x))
        while len(rows):
            below, above = left[rows], right[rows]
            down = np.where(below >= 0, sums[rows] - self.sums[below], np.inf)
            up = np.where(above < k, self.sums[np.minimum(above, k - 1)] - sums[rows], np.inf)
            leftward, gap = down <= up, np.minimum(down, up)
            # the nearer side is beyond the best distance, so both are
            going = gap * gap * (1 - _ROUNDING) <= d * best[rows].astype(np.float64)
            going &= gap < np.inf
            rows, leftward, gap = rows[going], leftward[going], gap[going]
            at = np.where(leftward, below[going], above[going])
            left[rows[leftward]] -= 1
            right[rows[~leftward]] += 1
            apart = np.maximum(np.abs(spread[rows] - self.spread[at]) - slack[rows] - self.slack[at], 0)
            near = (gap * gap + apart * apart) * (1 - _ROUNDING) <= d * best[rows].astype(np.float64)
            r, c = rows[near], at[near]
            self.compared += len(r)
            diff = x[r] - self.points[c]
            distance = np.einsum("nd,nd->n", diff, diff)
            better = (distance < best[r]) | ((distance == best[r]) & (self.number[c] < number[r]))
            best[r[better]] = distance[better]
            number[r[better]] = self.number[c[better]]
        return number, best


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 1024) -> DataFrame:
    """(id, q): the vectors of ``dim`` finite components, scaled and floored."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = src.where((F.size("v") == dim) & F.forall("v", fine))
    whole = lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x * F.lit(float(scale))))).cast("int")
    return kept.select("id", F.transform("v", whole).alias("q"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _next(vectors: DataFrame, points: np.ndarray) -> np.ndarray:
    """Every centroid replaced by the exact floor of its vectors' mean; one without vectors stays."""
    k, dim = points.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, n, sums = Centroids(points), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = _matrix(batch, dim)
            number, _ = search.nearest(x)
            n += np.bincount(number, minlength=k)
            np.add.at(sums, number, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    parts = vectors.select("q").mapInArrow(partial, "cluster long, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
    out = points.copy()
    for row in total.collect():  # at most k
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    dim: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: str = "3",
) -> DataFrame:
    """(id, cluster, distance, size, cluster_inertia, inertia, centroid) for every vector that is kept.

    The first centroids are the k vectors with the smallest hash of ``seed:id``.
    """
    spark = vectors.sparkSession
    held = staged(integer_vectors(vectors, id_col, vector_col, dim, scale))
    label = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = held.orderBy(label, "q").limit(k).select("q").collect()
    points = np.array([r["q"] for r in first], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(points) else 0):
        after = _next(held, points)
        if (after == points).all():  # every later round would repeat this one
            break
        points = after

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(points)
        for batch in batches:
            number, distance = search.nearest(_matrix(batch, dim))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    got = staged(held.mapInArrow(assign, f"id {dict(held.dtypes)['id']}, cluster int, distance long"))
    sums = got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # at most k
    fits = lambda n: int(n) if n <= _LONG else None
    inertia = fits(sum(r["d"] for r in sums))
    about = [(r["cluster"], r["n"], fits(r["d"]), inertia, points[r["cluster"]].tolist()) for r in sums]
    table = spark.createDataFrame(about, "cluster int, size long, cluster_inertia long, inertia long, centroid array<long>")
    return got.join(F.broadcast(table), "cluster").select("id", "cluster", "distance", "size", "cluster_inertia", "inertia", "centroid")


def text_digest(components: list[int]) -> str:
    """What ``centroid_sha256`` is for a list of components."""
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
