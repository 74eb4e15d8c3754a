"""A robust-pruned directed graph over one shard of unit vectors (NumPy, all points of a block at once).

Greedy beam searches propose neighbours for every point, relaxed distance
pruning keeps diverse edges, and reverse edges are added; queries are answered
by beam search from the medoid and a few fixed entry points.
"""

from __future__ import annotations

import numpy as np

DEGREE = 24
BEAM = 32
ALPHA = 1.2  # relaxation of the pruning, on distances
ENTRIES = 8
BLOCK = 512
EXPAND = 4  # beam entries expanded at once


class Graph:
    """Index of the rows of x (unit length, float32); passes are the relaxations of the pruning, one round over all points each."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, passes: tuple[float, ...] = (1.0, ALPHA), seed: int = 0):
        self.x = np.ascontiguousarray(x, np.float32)
        self.degree, self.beam = degree, beam
        n = len(x)
        rng = np.random.default_rng(seed)
        medoid = int(np.argmax(self.x @ self.x.mean(0))) if n else 0
        spread = np.linspace(0, max(n - 1, 0), num=min(ENTRIES, n), dtype=np.int64)
        self.entries = np.unique(np.concatenate([[medoid], spread])) if n else np.empty(0, np.int64)
        self.links = np.full((n, degree), -1, np.int32)
        if n <= 1:
            return
        k = min(degree, n - 1)
        self.links[:, :k] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, k))) % n
        for relax in passes:
            order = rng.permutation(n)
            for start in range(0, n, BLOCK):
                block = order[start : start + BLOCK]
                ids, _ = self.search(self.x[block], self.beam)
                self._replace(block, np.concatenate([ids, self.links[block]], 1), relax)
                self._reverse(block, relax)

    def _replace(self, block: np.ndarray, candidates: np.ndarray, relax: float) -> None:
        self.links[block] = self._prune(block, candidates, relax)

    def _prune(self, points: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
        """degree links of each point out of its candidates (-1 is none)."""
        c = np.sort(candidates, 1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == points[:, None]] = -1
        vectors = self.x[c]  # rows of -1 are masked below
        to_point = np.einsum("bcd,bd->bc", vectors, self.x[points])
        to_point[c < 0] = -np.inf
        order = np.argsort(-to_point, 1)
        rows = np.arange(len(c))[:, None]
        c, to_point, vectors = c[rows, order], to_point[rows, order], vectors[rows, order]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        alive = np.isfinite(to_point)
        d_point = np.where(alive, 2 - 2 * to_point, np.inf)
        out = np.full((len(c), self.degree), -1, np.int32)
        flat = np.arange(len(c))
        for r in range(self.degree):
            first = np.argmax(alive, 1)
            got = alive[flat, first]
            if not got.any():
                break
            out[got, r] = c[flat, first][got]
            d_first = 2 - 2 * between[flat, first]
            alive &= ~(relax * relax * d_first <= d_point)
            alive[flat, first] = False
        return out

    def _reverse(self, block: np.ndarray, relax: float) -> None:
        """Adds the links of the block the other way round; overfull points are pruned."""
        target = self.links[block].ravel()
        source = np.repeat(block, self.degree)[target >= 0]
        target = target[target >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        heads, starts, counts = np.unique(target, return_index=True, return_counts=True)
        width = min(int(counts.max()), 2 * self.degree) if len(counts) else 0
        if not width:
            return
        at = starts[:, None] + np.arange(width)
        incoming = np.where(np.arange(width) < counts[:, None], source[np.minimum(at, len(source) - 1)], -1)
        for start in range(0, len(heads), BLOCK):
            part = slice(start, start + BLOCK)
            self._replace(heads[part], np.concatenate([self.links[heads[part]], incoming[part].astype(np.int32)], 1), relax)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam of each query, best first; -1 fills up."""
        parts = [self._search(queries[i : i + BLOCK], beam) for i in range(0, len(queries), BLOCK)]
        if not parts:
            return np.empty((0, beam), np.int32), np.empty((0, beam), np.float32)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        b, n = len(q), len(self.x)
        ids = np.full((b, beam), -1, np.int32)
        sims = np.full((b, beam), -np.inf, np.float32)
        if not n:
            return ids, sims
        e = self.entries[:beam]
        ids[:, : len(e)], sims[:, : len(e)] = e, q @ self.x[e].T
        seen = np.zeros((b, n), bool)
        seen[:, e] = True
        opened = np.zeros((b, beam), bool)
        active = np.arange(b)
        while len(active):
            pending = np.where(opened[active] | (ids[active] < 0), -np.inf, sims[active])
            top = np.argpartition(-pending, EXPAND - 1, 1)[:, :EXPAND] if beam > EXPAND else np.tile(np.arange(beam), (len(active), 1))
            live = np.isfinite(np.take_along_axis(pending, top, 1))
            some = live.any(1)
            active, top, live = active[some], top[some], live[some]
            if not len(active):
                break
            opened[active[:, None], top] |= live
            nodes = np.where(live, ids[active[:, None], top], -1)
            near = np.where(nodes[:, :, None] >= 0, self.links[nodes], -1).reshape(len(active), -1)
            fresh = (near >= 0) & ~seen[active[:, None], near]
            row, col = np.nonzero(fresh)
            target = near[row, col]
            seen[active[row], target] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[row, col] = np.einsum("kd,kd->k", self.x[target], q[active[row]])
            # a node reached twice in one step keeps one entry
            dup = np.sort(np.where(fresh, near, -1 - np.arange(near.shape[1])), 1)
            if (dup[:, 1:] == dup[:, :-1]).any():
                o = np.argsort(near, 1, kind="stable")
                sorted_near = np.take_along_axis(near, o, 1)
                again = np.zeros_like(fresh)
                again[:, 1:] = sorted_near[:, 1:] == sorted_near[:, :-1]
                back = np.zeros_like(fresh)
                np.put_along_axis(back, o, again, 1)
                s[back] = -np.inf
            all_ids = np.concatenate([ids[active], near], 1)
            all_sims = np.concatenate([sims[active], s], 1)
            all_open = np.concatenate([opened[active], np.zeros(near.shape, bool)], 1)
            keep = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            ids[active] = np.where(np.isfinite(np.take_along_axis(all_sims, keep, 1)), np.take_along_axis(all_ids, keep, 1), -1)
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            opened[active] = np.take_along_axis(all_open, keep, 1)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
