"""Navigable small-world graph of one shard, as flat neighbour arrays.

Spark decides which rows form a shard; this file only builds and searches the
graph of one shard inside a task. Every step handles a whole batch of rows with
NumPy. The points of layer ``l`` are the first ``ceil(n / M**l)`` rows, so one
``(rows, degree)`` array of row numbers per layer is the entire index.
"""

from __future__ import annotations

import numpy as np

_SCALE = float((1 << 30) - 128)  # exact in single precision, and a similarity of 1 does not reach the sign bit


def _pack(sim: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Similarity, row number and an `expanded` bit in one sortable integer."""
    s = ((np.clip(sim, -1.0, 1.0) + 1.0) * _SCALE).astype(np.int64)
    return (s << 32) | (node.astype(np.int64) << 1)


def _node(key: np.ndarray) -> np.ndarray:
    return (key & 0xFFFFFFFF) >> 1


def _sim(key: np.ndarray) -> np.ndarray:
    return ((key >> 32) / _SCALE - 1.0).astype(np.float32)


class Shard:
    """Unit vectors `x` and their layered neighbour arrays (-1 is an empty slot)."""

    def __init__(self, x: np.ndarray, m: int = 12, ef: int = 32, batch: int = 1024, seed: int = 7):
        order = np.random.default_rng(seed).permutation(len(x))
        self.order, self.x = order, np.ascontiguousarray(x[order], dtype=np.float32)
        self.m, self.ef, self.batch = m, ef, batch
        sizes = [len(x)]
        while sizes[-1] > 4 * m:
            sizes.append(-(-sizes[-1] // m))
        self.sizes = sizes
        self.layers = [np.full((s, 2 * m), -1, dtype=np.int32) for s in sizes]
        #: Row numbers and similarities found while a row was inserted: the first half of the self-join.
        self.found = np.zeros((len(x), ef), dtype=np.int64)
        self._build()

    # -- search ---------------------------------------------------------------
    def _beam(self, layer: int, q: np.ndarray, keys: np.ndarray, ef: int, known: int) -> np.ndarray:
        """Best-first search of one layer for all rows of `q` at once; `known` rows are linked so far."""
        links, rows = self.layers[layer], np.arange(len(q))
        seen = np.zeros((len(q), known), dtype=bool)
        seen[rows[:, None], _node(keys)] = True
        best = np.zeros((len(q), ef), dtype=np.int64)
        best[:, : keys.shape[1]] = keys[:, :ef]
        best.sort(axis=1)
        live = rows
        while len(live):
            cur = best[live]
            fresh = ((cur & 1) == 0) & (cur > 0)
            rank = np.cumsum(fresh[:, ::-1], axis=1)[:, ::-1]
            pick = fresh & (rank <= 3)
            r, c = np.nonzero(pick)
            node = _node(cur[r, c])
            cur[r, c] |= 1
            near = links[node]
            row = np.repeat(r, near.shape[1])
            near = near.ravel()
            ok = near >= 0
            row, near = row[ok], near[ok]
            ok = ~seen[live[row], near]
            row, near = row[ok], near[ok]
            seen[live[row], near] = True
            sim = np.einsum("ij,ij->i", q[live[row]], self.x[near])
            # pad the new keys of each row to a rectangle
            count = np.bincount(row, minlength=len(live))
            start = np.cumsum(count) - count
            wide = np.zeros((len(live), ef + (count.max() if len(row) else 0)), dtype=np.int64)
            wide[:, :ef] = cur
            wide[row, ef + np.arange(len(row)) - start[row]] = _pack(sim, near)
            wide.sort(axis=1)
            wide[:, 1:][(wide[:, 1:] | 1) == (wide[:, :-1] | 1)] = 0  # reached twice in one step
            cur = wide[:, -ef:]
            best[live] = cur
            live = live[(((cur & 1) == 0) & (cur > 0)).any(axis=1)]
        best.sort(axis=1)
        return best[:, ::-1] & ~np.int64(1)

    def _descend(self, q: np.ndarray, low: int, known: int) -> np.ndarray:
        """Entry keys for layer `low`: greedy search of the layers above it."""
        first = np.zeros((len(q), 1), dtype=np.int64)
        keys = _pack(q @ self.x[0], first[:, 0])[:, None]
        for layer in range(len(self.sizes) - 1, low, -1):
            keys = self._beam(layer, q, keys, 4, min(known, self.sizes[layer]))
            keys = np.where(keys > 0, keys, keys[:, :1])
        return keys

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Original row numbers (-1: none) and similarities of the `ef` best rows for each row of `q`."""
        ids, sims = [], []
        for at in range(0, len(q), self.batch):
            part = np.ascontiguousarray(q[at : at + self.batch], dtype=np.float32)
            keys = self._beam(0, part, self._unique(self._descend(part, 0, len(self.x))), ef, len(self.x))
            ids.append(np.where(keys > 0, self.order[_node(keys)], -1))
            sims.append(_sim(keys))
        return np.concatenate(ids), np.concatenate(sims)

    def again(self, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `links`, from the finished graph: every row is searched once more, from itself and the rows near to it so far."""
        rows, near, sims = [], [], []
        for at in range(0, len(self.x), self.batch):
            part = self.x[at : at + self.batch]
            me = np.arange(at, at + len(part))
            so_far = np.sort(self.found[at : at + self.batch], axis=1)[:, ::-1][:, : ef - 1]
            keys = self._beam(0, part, np.concatenate([_pack(np.ones(len(part)), me)[:, None], so_far], axis=1), ef, len(self.x))
            i, j = np.nonzero((keys > 0) & (_node(keys) != me[:, None]))
            rows.append(self.order[me[i]])
            near.append(self.order[_node(keys[i, j])])
            sims.append(_sim(keys[i, j]))
        return np.concatenate(rows), np.concatenate(near), np.concatenate(sims)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Original row numbers and similarities of the near rows met while each row was inserted."""
        i, j = np.nonzero(self.found)
        keys = self.found[i, j]
        return self.order[i], self.order[_node(keys)], _sim(keys)

    @staticmethod
    def _unique(keys: np.ndarray) -> np.ndarray:
        keys = np.sort(keys, axis=1)
        keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = 0
        return np.sort(keys, axis=1)[:, ::-1]

    # -- construction ---------------------------------------------------------
    def _build(self) -> None:
        n, at = len(self.x), 0
        while at < n:
            upto = min(n, at + max(2 * self.m, min(at, self.batch)))
            upto = min([upto, *(s for s in self.sizes if s > at)])
            self._insert(at, upto)
            at = upto

    def _insert(self, a: int, b: int) -> None:
        q, new = self.x[a:b], np.arange(a, b)
        near = q @ q.T
        np.fill_diagonal(near, -1.0)
        near[np.triu_indices(b - a, 1)] = -1.0  # a row links to rows before it; later rows link back
        width = min(self.ef, b - a)
        col = np.argpartition(near, -width, axis=1)[:, -width:] if width < b - a else np.tile(np.arange(b - a), (b - a, 1))
        sims = np.take_along_axis(near, col, axis=1)
        mates = np.where(sims > -1.0, _pack(sims, col + a), 0)
        for layer in range(len(self.sizes)):
            if a >= self.sizes[layer]:
                continue
            if a:
                entry = self._unique(self._descend(q, layer, a))
                old = self._beam(layer, q, entry, self.ef, a)
                keys = np.concatenate([old, mates], axis=1)
            else:
                keys = mates
            keys = np.sort(keys, axis=1)[:, ::-1][:, : self.ef]
            if layer == 0:
                self.found[a:b, : keys.shape[1]] = keys
            chosen = self._diverse(keys, self.m)
            self.layers[layer][a:b, : chosen.shape[1]] = np.where(chosen > 0, _node(chosen), -1)
            self._link_back(layer, new, chosen)

    def _diverse(self, keys: np.ndarray, m: int) -> np.ndarray:
        """Of candidates sorted by similarity, those nearer to the row than to any candidate kept before."""
        node, sim, ok = _node(keys), _sim(keys), keys > 0
        v = self.x[node]
        pair = v @ v.transpose(0, 2, 1)
        kept = np.zeros(keys.shape, dtype=bool)
        count = np.zeros(len(keys), dtype=np.int64)
        for j in range(keys.shape[1]):
            good = ok[:, j] & (count < m) & ~((pair[:, j, :] > sim[:, j, None]) & kept).any(axis=1)
            kept[:, j] = good
            count += good
        spare = ok & ~kept
        kept |= spare & (np.cumsum(spare, axis=1) <= (m - count)[:, None])
        out = np.where(kept, keys, 0)
        return np.sort(out, axis=1)[:, ::-1][:, :m]

    def _link_back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        links, wide = self.layers[layer], 2 * self.m
        r, c = np.nonzero(chosen > 0)
        if not len(r):
            return
        to, back = _node(chosen[r, c]), _pack(_sim(chosen[r, c]), new[r])
        by = np.lexsort((-back, to))
        to, back = to[by], back[by]
        u, start, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(start, count)
        have = (links[u] >= 0).sum(axis=1)
        slot = np.repeat(have, count) + place
        fits = slot < wide
        links[to[fits], slot[fits]] = _node(back[fits])
        full = have + count > wide
        if full.any():
            rows = u[full]
            old = links[rows]
            keys = np.zeros((len(rows), wide + min(int(count[full].max()), wide)), dtype=np.int64)
            sims = np.einsum("ij,ikj->ik", self.x[rows], self.x[old])
            keys[:, :wide] = np.where(old >= 0, _pack(sims, old), 0)
            where = np.full(len(u), -1)
            where[full] = np.arange(len(rows))
            t = np.repeat(where, count)
            extra = (t >= 0) & ~fits & (place < keys.shape[1])
            spot = np.arange(len(to))[extra]
            k = spot - np.repeat(start, count)[extra]
            good = k < keys.shape[1] - wide
            keys[t[extra][good], wide + k[good]] = back[extra][good]
            best = self._diverse(np.sort(keys, axis=1)[:, ::-1], wide)
            links[rows] = -1
            links[rows, : best.shape[1]] = np.where(best > 0, _node(best), -1)
