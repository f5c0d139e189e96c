"""Hierarchical navigable small-world graph of one bounded shard, searched for many queries in step.

All vectors have unit length; similarity is the inner product.  Node levels come from the
caller, so that a graph depends on nothing but its nodes.
"""

from __future__ import annotations

import numpy as np

WIDTH = 16  # links of a node on an upper layer; twice as many on the lowest
BUILD_BEAM = 48
BATCH = 512
VISITED_CELLS = 1 << 24  # of the table of visited nodes of one search batch


class Graph:
    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        order = np.argsort(-levels, kind="stable")
        self.layers = [np.full((n, 2 * WIDTH if k == 0 else WIDTH), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)]
        self.levels = levels
        self.entry = int(order[0]) if n else -1
        # the highest nodes come first, so the entry never changes; batches at most double the graph
        at = 1
        while at < n:
            stop = min(n, at + min(BATCH, at))
            self._insert(order[at:stop])
            at = stop

    def _insert(self, nodes: np.ndarray):
        x = self.vectors[nodes]
        start = np.full((len(nodes), 1), self.entry, np.int32)
        for k in range(len(self.layers) - 1, -1, -1):
            own = self.levels[nodes] >= k
            beam = BUILD_BEAM if own.any() else 1
            ids, sims = self._layer(x, start, beam, k)
            start = ids
            if not own.any():
                continue
            new = nodes[own]
            # neighbours of the same batch, which the graph doesn't hold yet
            inside = x[own] @ x[own].T
            np.fill_diagonal(inside, -np.inf)
            m = min(WIDTH, len(new))
            near = np.argpartition(-inside, m - 1, axis=1)[:, :m]
            ids = np.concatenate([ids[own], new[near].astype(np.int32)], axis=1)
            sims = np.concatenate([sims[own], np.take_along_axis(inside, near, 1)], axis=1)
            ids = np.where(np.isfinite(sims), ids, -1)
            links = self.layers[k]
            links[new] = self._select(ids, sims, links.shape[1])
            self._link_back(new, k)

    def _link_back(self, new: np.ndarray, k: int):
        links = self.layers[k]
        to = links[new].ravel()
        by = np.repeat(new, links.shape[1])
        ok = to >= 0
        to, by = to[ok], by[ok]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        targets, first, many = np.unique(to, return_index=True, return_counts=True)
        for part in np.array_split(np.arange(len(targets)), max(1, len(targets) // 1024)):
            if not len(part):
                continue
            more = np.full((len(part), int(many[part].max())), -1, np.int32)
            row = np.repeat(np.arange(len(part)), many[part])
            col = np.arange(many[part].sum()) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
            more[row, col] = by[np.concatenate([np.arange(f, f + m) for f, m in zip(first[part], many[part])])]
            own = links[targets[part]]
            more[(more[:, :, None] == own[:, None, :]).any(axis=2)] = -1  # links that are there already
            ids = np.concatenate([own, more], axis=1)
            sims = np.einsum("qmd,qd->qm", self.vectors[ids], self.vectors[targets[part]])
            sims = np.where(ids >= 0, sims, -np.inf)
            links[targets[part]] = self._select(ids, sims, links.shape[1])

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Per row the most similar candidates that are nearer to the node than to a chosen one, then the rest by similarity."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.vectors[ids]
        between = v @ v.transpose(0, 2, 1)
        rows, n = ids.shape
        chosen = np.zeros((rows, n), bool)
        for j in range(n):
            hidden = (np.where(chosen[:, :j], between[:, j, :j], -np.inf) > sims[:, j : j + 1]).any(axis=1)
            chosen[:, j] = ~hidden & (ids[:, j] >= 0) & (chosen[:, :j].sum(axis=1) < most)
        rank = np.argsort(np.where(chosen, -2.0, np.where(ids >= 0, -1.0, 0.0)), axis=1, kind="stable")[:, :most]
        got = np.take_along_axis(ids, rank, 1)
        out = np.full((rows, most), -1, np.int32)
        out[:, : got.shape[1]] = got
        return out

    def _layer(self, x: np.ndarray, start: np.ndarray, beam: int, k: int):
        """Beam search on one layer from each row's starts: (ids, similarities), best first; -1 where none."""
        links, q = self.layers[k], len(x)
        size = max(1, VISITED_CELLS // max(1, len(self.vectors)))
        if q > size:
            parts = [self._layer(x[i : i + size], start[i : i + size], beam, k) for i in range(0, q, size)]
            return tuple(np.concatenate(c) for c in zip(*parts))
        visited = np.zeros((q, len(self.vectors)), bool)
        rows = np.arange(q)[:, None]
        ids = np.full((q, beam), -1, np.int32)
        sims = np.full((q, beam), -np.inf, np.float32)
        s = start[:, :beam]
        found = np.einsum("qmd,qd->qm", self.vectors[s], x)
        ids[:, : s.shape[1]] = s
        sims[:, : s.shape[1]] = np.where(s >= 0, found, -np.inf)
        visited[np.broadcast_to(rows, s.shape)[s >= 0], s[s >= 0]] = True
        todo = ids >= 0
        active = np.flatnonzero(todo.any(axis=1))
        while len(active):
            best = np.where(todo[active], sims[active], -np.inf).argmax(axis=1)
            todo[active, best] = False
            near = links[ids[active, best]]
            fresh = (near >= 0) & ~visited[active[:, None], near]
            r, c = np.nonzero(fresh)
            visited[active[r], near[r, c]] = True
            got = np.where(fresh, np.einsum("qmd,qd->qm", self.vectors[near], x[active]), -np.inf).astype(np.float32)
            all_sims = np.concatenate([sims[active], got], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, top, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1), top, 1)
            todo[active] = np.take_along_axis(np.concatenate([todo[active], fresh], axis=1), top, 1)
            active = active[todo[active].any(axis=1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(np.isfinite(sims), np.take_along_axis(ids, order, 1), -1), sims

    def search(self, x: np.ndarray, beam: int):
        """(ids, similarities) of the ``beam`` nodes found for each query, best first."""
        x = np.ascontiguousarray(x, np.float32)
        at = np.full((len(x), 1), self.entry, np.int32)
        for k in range(len(self.layers) - 1, 0, -1):
            at, _ = self._layer(x, at, 1, k)
        return self._layer(x, at, beam, 0)
