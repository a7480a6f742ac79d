"""A robust-pruned directed graph over unit vectors, in numpy batches.

Points are inserted in growing batches. A greedy beam search over the graph so far proposes the
neighbours of each new point; relaxed distance pruning keeps a diverse few of them (a candidate goes
if some kept neighbour is nearer to it by the factor alpha than the point itself is); each kept edge
is answered by one back, and nodes with too many edges are pruned the same way. Queries are beam
searches from the pivots nearest to them; a member's own query starts at its edges and at what the
search at its insertion found.
"""

from __future__ import annotations

import numpy as np

DEGREE, SLACK, BEAM, EXPAND, ALPHA, PIVOTS = 18, 8, 32, 4, 1.15, 64


def _prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (-1: none), nearest first, the diverse `degree`; -1 fills up."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = cand.shape
    vec = x[np.maximum(cand, 0)]
    between = 2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1))
    own = 2 - 2 * sims
    alive = cand >= 0
    out = np.full((rows, degree), -1, np.int32)
    at = np.arange(rows)
    for k in range(degree):
        first = alive.argmax(1)
        ok = alive[at, first]
        if not ok.any():
            break
        out[:, k] = np.where(ok, cand[at, first], -1)
        near = between[at, first]
        alive &= ~((alpha * near <= own) & ok[:, None])
        alive[at, first] = False
    return out


class Graph:
    """The index over the rows of x (float32, unit length)."""

    def __init__(self, x: np.ndarray, seed: int = 0, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        self.x, self.n = np.ascontiguousarray(x, np.float32), len(x)
        self.degree, self.most, self.beam, self.alpha = degree, degree + SLACK, beam, alpha
        self.edges = np.full((self.n, self.most), -1, np.int32)
        self.pool = np.full((self.n, beam), -1, np.int32)
        rng = np.random.default_rng(seed)
        order = rng.permutation(self.n)
        self.pivots = np.sort(order[:PIVOTS])
        first = order[: min(self.n, 4 * PIVOTS)]
        self._link_all(first)
        done = len(first)
        while done < self.n:
            batch = order[done : done + max(64, int(done * 0.3))]
            for a in range(0, len(batch), 1024):
                part = batch[a : a + 1024]
                ids, sims = self.search(self.x[part], self.beam)
                self.pool[part] = ids
                self._insert(part, ids, sims)
            done += len(batch)

    def _link_all(self, ids: np.ndarray) -> None:
        sims = self.x[ids] @ self.x[ids].T
        np.fill_diagonal(sims, -9)
        width = min(len(ids) - 1, self.beam)
        if width <= 0:
            return
        near = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        self.pool[ids, :width] = ids[near]
        self._insert(ids, ids[near].astype(np.int32), np.take_along_axis(sims, near, 1))

    def _insert(self, points: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
        keep = _prune(self.x, points, cand, np.where(cand >= 0, sims, -9), self.degree, self.alpha)
        self.edges[points, : self.degree] = keep
        src, col = np.nonzero(keep >= 0)
        to, back = keep[src, col], points[src]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        node, start, count = np.unique(to, return_index=True, return_counts=True)
        new = np.full((len(node), int(count.max()) if len(node) else 0), -1, np.int32)
        new[np.repeat(np.arange(len(node)), count), np.arange(len(to)) - np.repeat(start, count)] = back
        for a in range(0, len(node), 1024):
            self._answer(node[a : a + 1024], new[a : a + 1024])

    def _answer(self, node: np.ndarray, new: np.ndarray) -> None:
        new = new[:, : max(1, int((new >= 0).sum(1).max()))]
        if new.shape[1] > 64:  # a hub: the nearest 64 of the new ones compete
            sims = np.where(new >= 0, np.matmul(self.x[np.maximum(new, 0)], self.x[node][:, :, None])[:, :, 0], -9)
            new = np.take_along_axis(new, np.argsort(-sims, axis=1)[:, :64], 1)
        old = self.edges[node]
        new = np.where((new[:, :, None] == old[:, None, :]).any(2), -1, new)
        have, more = (old >= 0).sum(1), (new >= 0).sum(1)
        fits = have + more <= self.most
        both = np.concatenate([old, new], 1)
        if fits.any():
            b = both[fits]
            order = np.argsort(b < 0, axis=1, kind="stable")
            self.edges[node[fits]] = np.take_along_axis(b, order, 1)[:, : self.most]
        over = ~fits
        if over.any():
            b, p = both[over], node[over]
            sims = np.where(b >= 0, np.matmul(self.x[np.maximum(b, 0)], self.x[p][:, :, None])[:, :, 0], -9)
            self.edges[p, : self.degree] = _prune(self.x, p, b, sims, self.degree, self.alpha)
            self.edges[p, self.degree :] = -1

    def search(self, q: np.ndarray, beam: int, start: np.ndarray | None = None, own: np.ndarray | None = None, expand: int = EXPAND, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam, nearest first; own: rows that must not find themselves."""
        ids, sims = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -9, np.float32)
        for a in range(0, len(q), block):
            b = slice(a, min(a + block, len(q)))
            ids[b], sims[b] = self._search(q[b], beam, None if start is None else start[b], None if own is None else own[b], expand)
        return ids, sims

    def _search(self, q: np.ndarray, beam: int, start: np.ndarray | None, own: np.ndarray | None, expand: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(q)
        at = np.arange(rows)[:, None]
        stamp = np.full((rows, self.n), -1, np.int16)
        if own is not None:
            stamp[at[:, 0], own] = 0
        if start is None:
            near = q @ self.x[self.pivots].T
            top = np.argpartition(-near, min(3, len(self.pivots) - 1), axis=1)[:, :4]
            start = self.pivots[top].astype(np.int32)
        ids = np.full((rows, beam), -1, np.int32)
        sims = np.full((rows, beam), -9, np.float32)
        open_ = np.zeros((rows, beam), bool)
        fresh = start
        live = np.arange(rows)
        while True:
            # One step: score what is new, merge it into the beam.
            f = fresh
            r = live[:, None]
            col = np.arange(f.shape[1], dtype=np.int16)[None, :]
            safe = np.maximum(f, 0)
            unseen = (stamp[r, safe] < 0) & (f >= 0)
            rr, cc = np.nonzero(unseen)
            g = live[rr]
            cell = f[rr, cc]
            stamp[g, cell] = cc
            once = stamp[g, cell] == cc
            rr, cc, g, cell = rr[once], cc[once], g[once], cell[once]
            score = np.full(f.shape, -9, np.float32)
            score[rr, cc] = np.einsum("ij,ij->i", self.x[cell], q[g])
            all_s = np.concatenate([sims[live], score], 1)
            all_i = np.concatenate([ids[live], f], 1)
            all_o = np.concatenate([open_[live], score > -9], 1)
            if all_s.shape[1] > 2 * beam:
                top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_s, top, 1), axis=1, kind="stable"), 1)
            else:
                top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            s, i, o = (np.take_along_axis(v, top, 1) for v in (all_s, all_i, all_o))
            i = np.where(s > -9, i, -1)
            o &= s > -9
            # The nearest open entries of each row are expanded next.
            rank = np.cumsum(o, axis=1)
            chosen = o & (rank <= expand)
            o &= ~chosen
            sims[live], ids[live], open_[live] = s, i, o
            go = chosen.any(1)
            if not go.any():
                return ids, sims
            chosen, i, live = chosen[go], i[go], live[go]
            order = np.argsort(~chosen, axis=1, kind="stable")[:, :expand]
            picked = np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(i, order, 1), -1)
            fresh = np.where(picked[:, :, None] >= 0, self.edges[np.maximum(picked, 0)], -1).reshape(len(live), -1)

    def of_members(self, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest other members of each member."""
        start = np.concatenate([self.edges, self.pool], 1)
        ids, sims = self.search(self.x, beam, start, np.arange(self.n))
        return ids[:, :k], sims[:, :k]
