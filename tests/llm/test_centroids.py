import hashlib
import random

import duckdb
import numpy as np
import pytest

from tapeloom.llm import centroids, queries

NAN, INF = float("nan"), float("inf")


def brute(rows, dim, k, rounds):
    """Rows of (id, vector) as (id, cluster, distance, size, cluster inertia, inertia, centroid), in Python integers."""
    kept = [(i, [int(np.floor(1024 * min(max(x, -(2.0**40)), 2.0**40))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [min(max(x, -centroids.LIMIT), centroids.LIMIT) for x in v]) for i, v in kept]
    label = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    points = [v for _, v in sorted(kept, key=lambda r: (label(r[0]), r[1]))[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(points)) for _, v in kept]

    for _ in range(rounds):
        near = [n for _, n in assigned()]
        for n in range(len(points)):
            own = [v for (_, v), m in zip(kept, near) if m == n]
            if own:
                points[n] = [sum(c) // len(own) for c in zip(*own)]
    near = assigned()
    sums, sizes = {}, {}
    for d, n in near:
        sums[n], sizes[n] = sums.get(n, 0) + d, sizes.get(n, 0) + 1
    return [(i, n, d, sizes[n], sums[n], sum(sums.values()), points[n]) for (i, _), (d, n) in zip(kept, near)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "q", 2) for i, v in rows], "vec_id long, embedding array<double>, id int, q string, cluster int")


def check(spark, rows, dim=4, k=3, rounds=10):
    got = [tuple(r) for r in centroids.cluster(table(spark, rows), dim=dim, k=k, rounds=rounds).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, dim, k, rounds), key=repr)


def test_clusters_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 2]), 0.3) for _ in range(4)]) for i in range(150)]
    check(spark, rows)
    check(spark, rows, k=20, rounds=3)


def test_odd_vectors(spark):
    same = [(i, [0.5, 0.25, -0.5, 0.0]) for i in range(20)]
    odd = [(30, None), (31, []), (32, [1.0]), (33, [1.0, None, 0.0, 0.0]), (34, [NAN, 0.0, 0.0, 0.0]), (35, [INF, 0.0, 0.0, 0.0]),
           (36, [0.0] * 4), (36, [0.0] * 4), (36, [1.0] * 4), (None, [0.1, 0.2, 0.3, 0.4]), (None, [0.3, 0.2, 0.3, 0.4]),
           (37, [1e300, -1e300, 1e200, 0.0]), (38, [-0.0001, 0.0, -0.0, 0.0009])]
    check(spark, same + odd, k=5)
    check(spark, same, k=8)
    check(spark, odd[:6])
    check(spark, [])
    check(spark, odd[-1:], k=8)


def test_ties_go_to_the_smaller_number():
    points = np.array([[2, 0], [0, 0], [0, 0], [1, 1], [0, 2]], np.int64)
    number, distance = centroids.Centroids(points).nearest(np.array([[1, 0], [0, 1], [5, 5], [0, 0]], np.int64))
    assert number.tolist() == [0, 1, 3, 1] and distance.tolist() == [1, 1, 32, 0]


def test_search_is_exact_and_rejects():
    rng = np.random.default_rng(1)
    for spread in (3, 1000, 1 << 26):
        points = rng.integers(-spread, spread, (200, 8))
        x = np.concatenate([rng.integers(-spread, spread, (500, 8)), points + 1])
        search = centroids.Centroids(points)
        number, distance = search.nearest(x)
        table = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (number == table.argmin(axis=1)).all() and (distance == table.min(axis=1)).all()
        if spread > 3:
            assert search.compared < 0.8 * len(x) * len(points)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    rel = con.sql(queries.ORACLES["op13_centroid_clustering"])
    got = queries.op13_centroid_clustering(spark, folder)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
