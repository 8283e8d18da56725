"""A hierarchical navigable small-world graph over one shard of unit vectors, built and searched in batches."""

from __future__ import annotations

import numpy as np

FULL_BATCH = 512  # vectors inserted or searched at once
EDGES = 1 << 17  # hits whose neighbours are looked at together


class SmallWorld:
    """Vectors in order of falling level, so layer l holds the first ``counts[l]`` of them; row 0 is the entry.

    Vectors enter in batches that double, each linked to what the graph finds for it and to its batch. Neighbours are chosen
    by the diversity rule (one is taken if it is nearer to the vector than to those taken before), the rest fills up.
    """

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 32, seed: int = 7):
        draw = np.random.default_rng(seed).random(len(vectors))
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int)
        self.order = np.argsort(-level, kind="stable")  # row of the graph -> row given
        self.vectors = np.ascontiguousarray(vectors[self.order], np.float32)
        top = int(level.max()) if len(level) else 0
        self.counts = [int((level >= l).sum()) for l in range(top + 1)]
        self.width = [2 * links if l == 0 else links for l in range(top + 1)]
        self.near = [np.full((c, w), -1, np.int32) for c, w in zip(self.counts, self.width)]
        self.links = None
        done, batch = min(1, len(vectors)), 1
        while done < len(vectors):
            rows = np.arange(done, min(len(vectors), done + batch))
            self._insert(rows, done, beam)
            done, batch = done + len(rows), min(2 * batch, FULL_BATCH)

    @classmethod
    def restored(cls, order: np.ndarray, vectors: np.ndarray, near: list[np.ndarray]) -> "SmallWorld":
        self = cls.__new__(cls)
        self.order, self.vectors, self.near, self.links = order, vectors, near, None
        self.counts, self.width = [len(n) for n in near], [n.shape[1] for n in near]
        return self

    def _insert(self, rows: np.ndarray, there: int, beam: int) -> None:
        query = self.vectors[rows]
        entry = np.zeros((len(rows), 1), np.int32)
        for layer in range(len(self.counts) - 1, -1, -1):
            inside = min(there, self.counts[layer])
            found, score = self._beam(query, entry, layer, beam if layer == 0 or self.counts[layer] > there else 1)
            entry = found
            new = np.flatnonzero(rows < self.counts[layer])
            if not len(new) or not inside:
                continue
            own = rows[new]
            among = query[new] @ query[new].T
            np.fill_diagonal(among, -np.inf)
            most = min(self.width[layer], len(new) - 1)
            if most > 0:
                best = np.argpartition(-among, most - 1, axis=1)[:, :most]
                candidates = np.concatenate([found[new], own[best]], axis=1)
                scores = np.concatenate([score[new], np.take_along_axis(among, best, 1)], axis=1)
            else:
                candidates, scores = found[new], score[new]
            self.near[layer][own] = self._diverse(candidates, scores, self.width[layer])
            self._link_back(own, layer)

    def _diverse(self, candidates: np.ndarray, scores: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` neighbours of each row out of candidates (-1: none), by the diversity rule, then by nearness."""
        order = np.argsort(-scores, axis=1, kind="stable")
        candidates, scores = np.take_along_axis(candidates, order, 1), np.take_along_axis(scores, order, 1)
        valid = (candidates >= 0) & np.isfinite(scores)
        v = self.vectors[np.maximum(candidates, 0)]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros(candidates.shape, bool)
        for j in range(candidates.shape[1]):
            closest = np.where(taken, between[:, j, :], -np.inf).max(axis=1)
            taken[:, j] = valid[:, j] & (scores[:, j] > closest) & (taken.sum(axis=1) < width)
        rank = np.where(taken, 0, np.where(valid, 1, 2))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(np.where(valid, candidates, -1), pick, 1)
        if out.shape[1] < width:
            out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _link_back(self, own: np.ndarray, layer: int) -> None:
        near, width = self.near[layer], self.width[layer]
        source = np.repeat(own, width)
        target = near[own].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        most = int(count.max()) if len(count) else 0
        for block in range(0, len(nodes), FULL_BATCH):
            n, f, c = nodes[block : block + FULL_BATCH], first[block : block + FULL_BATCH], count[block : block + FULL_BATCH]
            added = np.full((len(n), most), -1, np.int64)
            column = np.arange(most)
            filled = column < c[:, None]
            added[filled] = source[(f[:, None] + column)[filled]]
            known = (added[:, :, None] == near[n][:, None, :]).any(axis=2)
            candidates = np.concatenate([near[n].astype(np.int64), np.where(known, -1, added)], axis=1)
            width_used = int((candidates >= 0).sum(axis=1).max())
            pack = np.argsort(candidates < 0, axis=1, kind="stable")[:, :max(1, width_used)]
            candidates = np.take_along_axis(candidates, pack, 1)
            scores = np.einsum("ncd,nd->nc", self.vectors[np.maximum(candidates, 0)], self.vectors[n])
            near[n] = self._diverse(candidates, np.where(candidates >= 0, scores, -np.inf), width)

    def _beam(self, query: np.ndarray, entry: np.ndarray, layer: int, beam: int, open_: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best rows that a best-first walk from ``entry`` finds, for all queries in step; -1 and -inf fill up."""
        near, n = self.near[layer], len(query)
        seen = np.zeros((n, self.counts[layer] + 1), bool)  # the last column stands for "no neighbour"
        line = np.arange(n)[:, None]
        ids = np.where(entry < self.counts[layer], entry, -1)
        seen[line, ids] = True
        score = np.where(ids >= 0, np.einsum("ncd,nd->nc", self.vectors[np.maximum(ids, 0)], query), -np.inf)
        wide = max(beam, ids.shape[1])
        ids = np.pad(ids, ((0, 0), (0, wide - ids.shape[1])), constant_values=-1)
        score = np.pad(score, ((0, 0), (0, wide - score.shape[1])), constant_values=-np.inf)
        fresh = ids >= 0
        rows = np.arange(n)
        while len(rows):
            waiting = np.where(fresh[rows], score[rows], -np.inf)
            take = min(open_, wide)
            pick = np.argpartition(-waiting, take - 1, axis=1)[:, :take]
            good = np.isfinite(np.take_along_axis(waiting, pick, 1))
            alive = good.any(axis=1)
            rows, pick, good = rows[alive], pick[alive], good[alive]
            if not len(rows):
                break
            chosen = np.where(good, ids[rows[:, None], pick], -1)
            marks = fresh[rows]
            np.put_along_axis(marks, pick, False, 1)
            fresh[rows] = marks
            more = np.where((chosen >= 0)[:, :, None], near[np.maximum(chosen, 0)], -1).reshape(len(rows), -1)
            more = np.sort(more, axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            more = np.where(seen[rows[:, None], more], -1, more)
            seen[rows[:, None], more] = True
            fit = np.where(more >= 0, np.einsum("ncd,nd->nc", self.vectors[np.maximum(more, 0)], query[rows]), -np.inf)
            all_ids, all_scores = np.concatenate([ids[rows], more], axis=1), np.concatenate([score[rows], fit], axis=1)
            all_fresh = np.concatenate([fresh[rows], more >= 0], axis=1)
            best = np.argpartition(-all_scores, wide - 1, axis=1)[:, :wide]
            ids[rows], score[rows] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_scores, best, 1)
            fresh[rows] = np.take_along_axis(all_fresh, best, 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)

    def _both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours of each row on the lowest layer, whichever of the two holds the link."""
        if self.links is None:
            source, column = np.nonzero(self.near[0] >= 0)
            target = self.near[0][source, column].astype(np.int64)
            pair = np.unique(np.concatenate([source * self.counts[0] + target, target * self.counts[0] + source]))
            self.links = pair % self.counts[0], np.searchsorted(pair, np.arange(self.counts[0] + 1) * self.counts[0])
        return self.links

    def search(self, query: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(query), 1), np.int32)
        for layer in range(len(self.counts) - 1, 0, -1):
            entry, _ = self._beam(query, entry, layer, 1)
        return self._beam(query, entry, 0, beam)

    def within(self, query: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, graph row) pairs with dot product >= ``least`` that a beam of that width reaches.

        Where such rows are found, the beam is widened over their neighbours until no new one turns up.
        """
        found, score = self.search(query, beam)
        number, column = np.nonzero(score >= least)
        row = found[number, column]
        size = self.counts[0]
        linked, first = self._both_ways()
        key = np.unique(number.astype(np.int64) * size + row)
        edge = key
        while len(edge):
            hits = []
            for block in range(0, len(edge), EDGES):  # a large group has tens of neighbours for each of its hits
                near = edge[block : block + EDGES]
                each = (first[1:] - first[:-1])[near % size]
                ends = np.cumsum(each)
                more = linked[np.repeat(first[near % size] - (ends - each), each) + np.arange(ends[-1])]
                reach = np.setdiff1d(np.unique(np.repeat(near // size, each) * size + more), key, assume_unique=True)
                for start in range(0, len(reach), 1 << 18):
                    part = reach[start : start + (1 << 18)]
                    fit = np.einsum("nd,nd->n", query[part // size], self.vectors[part % size])
                    hits.append(part[fit >= least])
            edge = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            key = np.union1d(key, edge)
        return key // size, key % size
