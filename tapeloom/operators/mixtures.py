"""Mixtures of Gaussians with diagonal variances: expectation-maximisation as repeated grouped sums.

A round is one pass over the vectors.  Every task sends its sums of responsibilities, of
deviations and of their squares, k rows of them; Spark adds these up, and only the k means and
variances reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIANCE_FLOOR = 1e-6  # added to every variance
TOLERANCE = 1e-3  # gain of mean log likelihood below which the rounds end


@dataclass
class Mixture:
    weights: np.ndarray  # by cluster
    means: np.ndarray  # (cluster, component)
    variances: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """(row, cluster): log of weight times density."""
        out = np.empty((len(x), len(self.weights)))
        for k, (weight, mean, variance) in enumerate(zip(self.weights, self.means, self.variances)):
            norm = np.log(weight) - 0.5 * np.log(2 * np.pi * variance).sum() if weight > 0 else -np.inf
            out[:, k] = norm - 0.5 * ((x - mean) ** 2 / variance).sum(axis=1)
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the clusters in every row, and the row's log likelihood."""
        log = self.log_densities(x)
        top = log.max(axis=1, keepdims=True)
        share = np.exp(log - top)
        total = share.sum(axis=1, keepdims=True)
        return share / total, (top + np.log(total))[:, 0]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _moments(df: DataFrame, vec: str, about: np.ndarray, share: Callable, *more: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums over all rows by cluster: shares, share * (x - about), share * (x - about)^2; and of the log likelihood."""
    k, d = about.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, likelihood = np.zeros((k, 2 * d + 1)), 0.0
        for batch in batches:
            x = _matrix(batch.column("vec"))
            r, log = share(x, batch)
            likelihood += float(log.sum())
            for c in range(k):
                off = x - about[c]
                sums[c, 0] += r[:, c].sum()
                sums[c, 1 : d + 1] += r[:, c] @ off
                sums[c, d + 1 :] += r[:, c] @ (off * off)
        cluster = np.append(np.repeat(np.arange(k), 2 * d + 1), -1)
        at = np.append(np.tile(np.arange(2 * d + 1), k), 0)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(at), pa.array(np.append(sums.reshape(-1), likelihood))], ["cluster", "at", "value"])

    parts = df.select(F.col(vec).alias("vec"), *more).mapInArrow(partial, "cluster long, at long, value double")
    total, likelihood = np.zeros((k, 2 * d + 1)), 0.0
    for c, at, value in parts.groupBy("cluster", "at").agg(F.sum("value")).collect():  # k rows of each
        if c < 0:
            likelihood = value
        else:
            total[c, at] = value
    return total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :], likelihood


def _mixture(n: np.ndarray, first: np.ndarray, second: np.ndarray, about: np.ndarray) -> Mixture:
    some = np.maximum(n, 10 * np.finfo(np.float64).eps)[:, None]
    shift = first / some
    return Mixture(n / n.sum(), about + shift, np.maximum(second / some - shift * shift, 0) + VARIANCE_FLOOR)


def from_groups(df: DataFrame, vec: str, group: str, k: int) -> Mixture:
    """The mixture of given clusters 0 .. k - 1, by the moments of their members."""
    width = df.agg(F.max(F.size(vec))).first()[0] or 0

    def member(x, batch):
        own = batch.column("g").to_numpy(zero_copy_only=False)
        return (own[:, None] == np.arange(k)).astype(np.float64), np.zeros(len(x))

    about = np.zeros((k, width))
    return _mixture(*_moments(df.withColumn("g", F.col(group).cast("int")), vec, about, member, "g")[:3], about)


def step(df: DataFrame, vec: str, start: Mixture) -> tuple[Mixture, float]:
    """The mixture after one round, and the log likelihood of all rows before it."""
    n, first, second, likelihood = _moments(df, vec, start.means, lambda x, _: start.responsibilities(x))
    return _mixture(n, first, second, start.means), likelihood


def fit(df: DataFrame, vec: str, start: Mixture, max_iter: int = 100, tolerance: float = TOLERANCE) -> tuple[Mixture, list[float]]:
    """Rounds until the mean log likelihood gains less than ``tolerance``: the mixture and the mean before each round."""
    rows, trace = df.count(), []
    for _ in range(max_iter if rows else 0):
        after, likelihood = step(df, vec, start)
        trace.append(likelihood / rows)
        if len(trace) > 1 and trace[-1] - trace[-2] < tolerance:
            break
        start = after
    return start, trace


def assign(df: DataFrame, vec: str, model: Mixture, out: str = "prediction") -> DataFrame:
    """Adds the cluster with the largest share (ties: the smallest number)."""

    @F.arrow_udf("int")
    def best(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.int32())
        return pa.array(model.log_densities(_matrix(v)).argmax(axis=1).astype(np.int32))

    return df.withColumn(out, best(F.col(vec)))
