import tracemalloc

import numpy as np
import pytest

from tapeloom.llm import embeddings


def brute(rows, threshold=0.9):
    """(id, n_links, component) by all pairs."""
    vectors = []
    for i, v in rows:
        ok = i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vectors.append(np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64)) if ok else None)
    n = len(rows)
    linked = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= threshold - 1e-12
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j and linked(vectors[i], vectors[j]):
                links[i] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, links[i], least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def made(rng, n, dim=24):
    centres = rng.normal(size=(n // 5, dim))
    x = np.concatenate([rng.normal(size=(n // 2, dim)), centres[rng.integers(0, len(centres), n // 2)] + rng.normal(size=(n // 2, dim)) * 0.25])
    return [[float(c) for c in v] for v in x.astype(np.float32)]


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(made(rng, 400))]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # many exact copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] + [1.0] * 23), (2004, [None] + [1.0] * 23)]
    rows += [(2005, [float("inf")] + [1.0] * 23), (None, rows[7][1]), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (7, rows[7][1])]
    return rows


def test_equals_all_pairs(spark, vector_rows):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vector_rows], "vec_id long, embedding array<float>, node int, n int")
    got = embeddings.near_duplicates(df).collect()
    assert sorted(((r.id, r.n_links, r.component) for r in got), key=repr) == brute(vector_rows)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_and_audit():
    rng = np.random.default_rng(5)
    x = np.array(made(rng, 3000), np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    truth = x @ x.T >= 0.9
    graph = embeddings.Graph(x, embeddings._level(np.arange(len(x))))
    q, n = embeddings.find_links(graph, x, x, 0.9, beam=2)  # the audit has to widen this beam
    assert truth[q, n].all()
    assert len(set(zip(q.tolist(), n.tolist()))) >= 0.97 * truth.sum()


def test_beam_widens_over_a_dense_group():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1, 16)) + rng.normal(size=(300, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = embeddings.Graph(x, embeddings._level(np.arange(300)))
    q, n = embeddings.find_links(graph, x, x, 0.9, beam=8)
    assert len(set(zip(q.tolist(), n.tolist()))) >= 0.99 * 300 * 300


class Blind:
    """A graph whose searches find the query's own node at most, as long as the beam is narrow."""

    def __init__(self, unit):
        self.unit = unit

    def search(self, x, beam):
        sims = (x @ self.unit.T).astype(np.float32)
        ids = np.argsort(-sims, axis=1)[:, :beam].astype(np.int32)
        sims = np.take_along_axis(sims, ids, 1)
        return np.where(sims > 1 - 1e-6, ids, -1), np.where(sims > 1 - 1e-6, sims, -np.inf)


def turned(rng, x, cosine):
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=-1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=-1, keepdims=True)


def units(rng, n, dim=32):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_audit_does_not_count_self_matches():
    rng = np.random.default_rng(8)
    x = units(rng, 600)
    x[300:304] = turned(rng, x[:4], 0.95)
    q, n = embeddings.find_links(Blind(x), x, x, 0.9)
    assert {(a, a + 300) for a in range(4)} <= set(zip(q.tolist(), n.tolist()))


def test_audit_where_no_sampled_query_has_a_link():
    rng = np.random.default_rng(9)
    x, y = units(rng, 600), units(rng, 600)
    sampled = np.unique(np.linspace(0, 599, embeddings.AUDIT).astype(np.int64))
    one = np.setdiff1d(np.arange(600), sampled)[5]
    y[one] = turned(rng, x[10], 0.95)
    q, n = embeddings.find_links(Blind(x), x, y, 0.9)
    assert (one, 10) in set(zip(q.tolist(), n.tolist()))


def test_audit_is_not_carried_by_a_crowded_group():
    rng = np.random.default_rng(10)
    x = units(rng, 900)
    x[600:] = turned(rng, np.repeat(x[:1], 300, axis=0), 0.999)
    x[300:310] = turned(rng, x[1:11], 0.95)

    class Crowd(Blind):
        def search(self, q, beam):
            ids, sims = super().search(q, beam)
            hot = np.flatnonzero(q @ self.unit[0] > 0.99)
            many = min(beam, 300)
            ids[hot, :many], sims[hot, :many] = np.arange(600, 600 + many), 0.998
            return ids, sims

    q, n = embeddings.find_links(Crowd(x), x, x, 0.9)
    assert {(a, a + 299) for a in range(1, 11)} <= set(zip(q.tolist(), n.tolist()))


@pytest.mark.parametrize("apart", [False, True])
def test_a_crowded_group_is_counted_without_its_pairs(apart):
    rng = np.random.default_rng(11)
    x = units(rng, 5000)
    x[:4000] = turned(rng, np.repeat(x[:1], 4000, axis=0), 0.99)
    x[4000:4100] = turned(rng, x[4100:4200], 0.95)
    weight = rng.integers(1, 4, len(x))
    sides = [np.arange(0, 5000, 2), np.arange(1, 5000, 2)] if apart else [np.arange(5000)]
    left, right = [(rows, weight[rows], x[rows], embeddings.Graph(x[rows], embeddings._level(rows))) for rows in (sides * 2)[:2]]
    tracemalloc.start()
    others_x, others_y, a, b = embeddings._between(left, right if apart else left, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # the pairs alone, from both sides, are more
    truth = x @ x.T >= 0.9
    np.fill_diagonal(truth, False)
    if apart:
        truth[::2, ::2] = truth[1::2, 1::2] = False
        assert (others_x == (truth @ weight)[::2]).all() and (others_y == (truth @ weight)[1::2]).all()
    else:
        assert (others_x == truth @ weight).all()
    members = np.concatenate(sides)
    assert truth[members[a], members[b]].all()
    label = np.arange(5000)
    for one, other in zip(members[a], members[b]):
        assert label[one] != label[other]
        label[label == label[one]] = label[other]
    one, other = np.nonzero(truth[:, :])
    assert (label[one] == label[other]).all()
