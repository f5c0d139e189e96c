"""Near-duplicate embeddings: a small-world graph per shard, every shard queried, cosine verified.

Equal vectors are one node with a count.  Nodes are spread over shards of bounded size by
hash; each shard becomes a graph, and each pair of shards is one task, in which the vectors of
either query the other's graph.  Beams widen per task until the recall of brute-force audits
passes; a query whose beam is full of links, or that has many, is compared with every node
instead.  Only pairs whose cosine in double precision reaches the threshold are links.  A task
holds and sends the number of links of each node and a spanning forest of them, so that its
memory and its output grow with its nodes, not with the links.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null id, link with nothing and are components of their own; vectors of different
lengths don't link; rows that share an id are one member; no rows, no rows; other columns are
not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged
from .components import connected_components
from .hnsw import WIDTH, Graph

THRESHOLD = 0.9
SHARDS = 8  # at least; more from this many nodes a shard on
SHARD_NODES = 50_000
BEAM = 32
AUDIT = 256  # audited queries of each task, and as many planted ones
RECALL = 0.98
WIDEST = 512  # beams; beyond, exact products cost less than a search
CROWDED = 64  # links of a query from which on they are counted by exact products
SLICE = 4096  # queries searched at a time
CELLS = 1 << 22  # of a block of exact products


def _unit(vectors: pd.Series) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no norm overflows."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _level(node: np.ndarray) -> np.ndarray:
    """A geometric level for each node, from a hash of its id."""
    h = (node.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype(np.float64)
    return np.floor(-np.log((u + 0.5) / 2**53) / np.log(WIDTH)).astype(np.int64)


def _build(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("node")
    unit = _unit(part["vector"])
    nodes = part["node"].to_numpy(np.int64)
    held = (nodes, part["n"].to_numpy(np.int64), unit, Graph(unit, _level(nodes)))
    return pd.DataFrame({"dim": [part["dim"].iloc[0]], "shard": [part["shard"].iloc[0]], "graph": [pickle.dumps(held, protocol=5)]})


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and of y are linked; products next to the threshold are decided as those of the search."""
    cosine = x @ y.T
    out = cosine >= threshold
    i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)
    out[i, j] = np.einsum("pd,pd->p", x[i], y[j]) >= threshold
    return out


def _exact(unit: np.ndarray, queries: np.ndarray, rows: np.ndarray, threshold: float):
    """(rows, their links to all of ``unit`` as a table) in blocks of bounded size, without a node's link to itself."""
    for part in np.array_split(rows, -(-len(rows) * len(unit) // CELLS)) if len(rows) else ():
        table = _linked(queries[part], unit, threshold)
        if queries is unit:
            table[np.arange(len(part)), part] = False
        yield part, table


def _searched(graph: Graph, unit: np.ndarray, queries: np.ndarray, rows: np.ndarray, threshold: float, beam: int):
    """(query, node) links of the queries that have few, and which queries have a full beam or many."""
    own, got_q, got_n, crowded = queries is unit, [], [], [rows[:0]]
    for part in np.array_split(rows, max(1, -(-len(rows) // SLICE))):
        ids, sims = graph.search(queries[part], min(beam, len(unit)))
        near = (ids >= 0) & (sims >= threshold - 1e-4)  # for single precision; the verification decides
        r, c = np.nonzero(near)
        q, n = part[r], ids[r, c].astype(np.int64)
        ok = np.einsum("pd,pd->p", queries[q], unit[n]) >= threshold
        if own:
            ok &= q != n
        many = near.all(axis=1) | (np.bincount(r[ok], minlength=len(part)) >= CROWDED)
        ok &= ~many[r]
        got_q.append(q[ok])
        got_n.append(n[ok])
        crowded.append(part[many])
    return np.concatenate(got_q), np.concatenate(got_n), np.concatenate(crowded)


def _planted(unit: np.ndarray, audit: int, threshold: float) -> np.ndarray:
    """Near copies of some nodes, little above the threshold from them."""
    of = unit[np.unique(np.linspace(0, len(unit) - 1, min(audit, len(unit))).astype(np.int64))]
    aside = np.random.default_rng(0).normal(size=of.shape)
    aside -= np.einsum("nd,nd->n", aside, of)[:, None] * of
    aside /= np.maximum(np.sqrt(np.einsum("nd,nd->n", aside, aside)), 1e-300)[:, None]
    cosine = threshold + 0.1 * (1 - threshold)
    out = cosine * of + np.sqrt(max(0.0, 1 - cosine * cosine)) * aside
    return out / np.sqrt(np.einsum("nd,nd->n", out, out))[:, None]


def _missed(graph, unit, queries, sample, threshold, beam) -> float:
    """Mean share of links missed by the audited queries that have links and are not searched exactly."""
    q, _, crowded = _searched(graph, unit, queries, sample, threshold, beam)
    truth, found = np.zeros(len(queries)), np.bincount(q, minlength=len(queries))
    for part, table in _exact(unit, queries, np.setdiff1d(sample, crowded), threshold):
        truth[part] = table.sum(axis=1)
    some = truth > 0
    return float((1 - found[some] / truth[some]).mean()) if some.any() else 0.0


def _search(graph: Graph, unit: np.ndarray, queries: np.ndarray, threshold: float, beam: int, audit: int, recall: float):
    """As ``_searched`` for all queries, with a beam that passes its audits; beyond ``WIDEST`` every query is crowded.

    Audited are queries, by their links to other nodes, and planted near copies of nodes, as
    the sampled queries may have no link.
    """
    every = np.arange(len(queries))
    sample = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(np.int64))
    planted = _planted(unit, audit, threshold)
    audits = ((queries, sample), (planted, np.arange(len(planted))))
    while beam < len(unit) and beam <= WIDEST:
        if all(_missed(graph, unit, x, rows, threshold, beam) <= 1 - recall for x, rows in audits):
            return _searched(graph, unit, queries, every, threshold, beam)
        beam *= 2
    return every[:0], every[:0], every


def find_links(graph: Graph, unit: np.ndarray, queries: np.ndarray, threshold: float, beam: int = BEAM, audit: int = AUDIT, recall: float = RECALL):
    """(query, node) of the pairs found with cosine of ``threshold`` or more; a node of ``queries`` itself is its own."""
    q, n, crowded = _search(graph, unit, queries, threshold, beam, audit, recall)
    tables = [(part[t[0]], t[1]) for part, table in _exact(unit, queries, crowded, threshold) for t in [np.nonzero(table)]]
    itself = np.arange(len(unit) if queries is unit else 0)
    return np.concatenate([q, itself, *(t[0] for t in tables)]), np.concatenate([n, itself, *(t[1] for t in tables)])


class _Forest:
    """Spanning links of the components of n members."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.a, self.b = [], []

    def add(self, one: int, others: np.ndarray):
        """Links of one member to others."""
        own = self.label[one]
        new = others[self.label[others] != own]
        if len(new):
            labels, first = np.unique(self.label[new], return_index=True)
            self.a += [one] * len(first)
            self.b += new[first].tolist()
            merged = np.zeros(len(self.label), bool)
            merged[labels] = True
            self.label[merged[self.label]] = own

    def add_pairs(self, a: np.ndarray, b: np.ndarray):
        root = self.label.tolist()
        for at in range(0, len(a), 1 << 16):
            for one, other in zip(a[at : at + (1 << 16)].tolist(), b[at : at + (1 << 16)].tolist()):
                x, y = one, other
                while root[x] != x:
                    root[x] = x = root[root[x]]
                while root[y] != y:
                    root[y] = y = root[root[y]]
                if x != y:
                    root[x] = y
                    self.a.append(one)
                    self.b.append(other)
        label = np.array(root)
        while (label != label[label]).any():
            label = label[label]
        self.label = label


def _between(left, right, threshold: float):
    """Rows linked to each node of two shards (or of one) by the other, and a spanning forest as (member, member).

    Members are the nodes of the left, then those of the right shard.  Pairs are held only
    between nodes that both have few links; a crowded node's links are counted from a block
    of exact products, for itself and for the nodes with few, and not kept.
    """
    same = left is right
    (_, weight_x, x, g), (_, weight_y, y, h) = left, right
    shift = 0 if same else len(x)
    q, n, crowded_x = _search(h, y, x, threshold, BEAM, AUDIT, RECALL)
    others_x = np.zeros(len(x), np.int64)
    if same:
        others_y, crowded_y = others_x, crowded_x
        keys = np.concatenate([q * len(y) + n, n * len(y) + q])
    else:
        others_y = np.zeros(len(y), np.int64)
        n2, q2, crowded_y = _search(g, x, y, threshold, BEAM, AUDIT, RECALL)
        keys = np.concatenate([q * len(y) + n, q2 * len(y) + n2])
    few_x, few_y = np.ones(len(x), bool), np.ones(len(y), bool)
    few_x[crowded_x], few_y[crowded_y] = False, False
    keys = keys[few_x[keys // len(y)] & few_y[keys % len(y)]]
    keys = np.unique(keys)
    i, j = keys // len(y), keys % len(y)
    forest = _Forest(shift + len(y))
    forest.add_pairs(i, j + shift)
    others_x += np.bincount(i, weight_y[j], minlength=len(x)).astype(np.int64)
    if not same:
        others_y += np.bincount(j, weight_x[i], minlength=len(y)).astype(np.int64)
    sides = ((crowded_x, x, weight_x, others_x, 0, few_y, y, weight_y, others_y, shift), (crowded_y, y, weight_y, others_y, shift, few_x, x, weight_x, others_x, 0))
    for rows, own, weight, others, at, few, far, far_weight, far_others, far_at in sides[: 1 if same else 2]:
        for part, table in _exact(far, own, rows, threshold):
            others[part] += np.where(table, far_weight, 0).sum(axis=1)
            far_others[few] += np.where(table, weight[part][:, None], 0).sum(axis=0)[few]
            for one, linked in zip(part.tolist(), table):
                forest.add(one + at, np.flatnonzero(linked) + far_at)
    return others_x, others_y, np.array(forest.a, np.int64), np.array(forest.b, np.int64)


def shard_links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, others) of a written table (node, vector, n) of distinct vectors.

    With b: a link of a spanning forest of some pair of shards.  Without: the number of rows
    that node ``a`` links to in some shard.
    """
    shards = max(SHARDS, -(-nodes.count() // SHARD_NODES))
    placed = nodes.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("node", F.lit("shard")), F.lit(shards)))
    graphs = staged(placed.groupBy("dim", "shard").applyInPandas(_build, "dim int, shard long, graph binary"))
    other = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("other")
    copies = graphs.select("dim", "shard", "graph", other)
    copies = copies.select("dim", "shard", "graph", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        held = {int(s): g for s, g in zip(part["shard"], part["graph"])}
        low, high = int(part["low"].iloc[0]), int(part["high"].iloc[0])
        if low not in held or high not in held:  # the other shard has no vectors of this length
            return pd.DataFrame({"a": [], "b": [], "others": []})
        left = pickle.loads(held[low])
        right = left if low == high else pickle.loads(held[high])
        others_x, others_y, a, b = _between(left, right, threshold)
        out = []
        for own, others in ((left, others_x), (right, others_y))[: 1 if left is right else 2]:
            some = others > 0
            out.append(pd.DataFrame({"a": own[0][some], "b": None, "others": others[some]}))
        members = left[0] if left is right else np.concatenate([left[0], right[0]])
        out.append(pd.DataFrame({"a": members[a], "b": members[b], "others": None}))
        return pd.concat(out, ignore_index=True).astype("Int64")

    found = staged(copies.groupBy("dim", "low", "high").applyInPandas(search, "a long, b long, others long"))
    discard(graphs)
    return found


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component) for every row: links count rows; component is the smallest id reachable."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0)
    src = src.withColumn("vector", F.when(valid, F.col("vector")))
    classes = src.where("vector is not null").groupBy("vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    classes = staged(classes)
    found = shard_links(classes, threshold)
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    pairs = found.where("b IS NOT NULL").select("a", "b")
    # rows of one vector, and vectors of one id, belong together without a search
    same = src.where("vector is not null").join(classes.select("vector", "node"), "vector").select(F.col("id").alias("a"), F.col("node").alias("b"))
    joined = connected_components(pairs.unionAll(same.where("a != b").distinct())).toDF("id", "component")
    named = classes.join(linked, "node", "left").select("vector", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    got = src.join(named, "vector", "left").join(joined, "id", "left")
    return got.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
