"""A hierarchical navigable small-world graph over one shard of vectors, kept as flat neighbour arrays.

A shard is small, so the candidates for the links of a node are the nearest nodes of its layer, found block by
block; of those, the ones in different directions become its links. Queries are searched in lockstep: each step
takes the best open candidates of all queries of a block, looks up their neighbours in the flat arrays, and adds
up all products at once. What a block needs stays the same however large the shard is.
"""

from __future__ import annotations

import numpy as np

LINKS = 16  # links of a node in an upper layer; twice as many in the lowest
BLOCK = 512  # queries that are searched in lockstep, fewer in a shard of more than CELLS / BLOCK vectors
CELLS = 1 << 22  # entries of a block's arrays over all nodes
NARROW, NEARLY = 8, 0.2  # breadth of a first search, and how near to the asked similarity it must come
AT_ONCE = 4  # candidates of a query that are looked up in one step


class Graph:
    """Vectors (rows of length one) with the neighbours of each in each layer; -1 fills what is missing."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, breadth: int = 48, seed: int = 0) -> None:
        self.vectors, self.links, self.breadth = np.ascontiguousarray(vectors, dtype=np.float32), links, breadth
        n = len(vectors)
        draws = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(draws.random(n)) / np.log(links)).astype(np.int64), 8)
        order = np.argsort(-self.level, kind="stable")  # the highest go in first, so every layer has an entrance
        self.entry = int(order[0]) if n else -1
        top = int(self.level.max()) if n else 0
        self.near = [np.full((n, 2 * links if layer == 0 else links), -1, dtype=np.int32) for layer in range(top + 1)]
        self.sims = [np.full(x.shape, -np.inf, dtype=np.float32) for x in self.near]
        for layer in range(top, -1, -1):
            self._fill(layer, order[self.level[order] >= layer])

    def _block(self) -> int:
        return max(1, min(BLOCK, CELLS // max(1, len(self.vectors))))

    def _fill(self, layer: int, nodes: np.ndarray) -> None:
        """Links the nodes of a layer; those of the layers above are in it too."""
        own, keep, step = self.vectors[nodes], min(self.breadth, len(nodes) - 1), self._block()
        if keep < 1:
            return
        found = []
        for low in range(0, len(nodes), step):
            part = nodes[low : low + step]
            sims = self.vectors[part] @ own.T
            sims[np.arange(len(part)), np.arange(low, low + len(part))] = -np.inf
            best = np.argpartition(sims, len(nodes) - keep, axis=1)[:, len(nodes) - keep :]
            sims = np.take_along_axis(sims, best, axis=1)
            order = np.argsort(-sims, axis=1)
            ids, sims = self._diverse(nodes[np.take_along_axis(best, order, axis=1)], np.take_along_axis(sims, order, axis=1), self.links)
            there = ids >= 0
            found.append((np.repeat(part, there.sum(axis=1)), ids[there], sims[there]))
        rows, to, how = (np.concatenate(x) for x in zip(*found))
        self._add(layer, np.concatenate((rows, to)), np.concatenate((to, rows)), np.concatenate((how, how)))

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates in order of similarity, those that are nearer to the node than to one already taken, filled up with others."""
        safe = np.maximum(ids, 0)
        v = self.vectors[safe]
        between = np.matmul(v, v.transpose(0, 2, 1))
        b, c = ids.shape
        taken = np.zeros((b, c), dtype=bool)
        count = np.zeros(b, dtype=np.int64)
        for j in range(c):
            covered = (taken[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(axis=1)
            taken[:, j] = ~covered & (ids[:, j] >= 0) & (sims[:, j] > -np.inf) & (count < most)
            count += taken[:, j]
        rank = np.where(taken, 0, c) + np.arange(c)
        first = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(np.where(sims > -np.inf, ids, -1), first, axis=1), np.take_along_axis(sims, first, axis=1)

    def _add(self, layer: int, rows: np.ndarray, to: np.ndarray, how: np.ndarray) -> None:
        """Adds links; a node with too many keeps its most similar ones."""
        near, sims = self.near[layer], self.sims[layer]
        touched = np.unique(rows)
        old = near[touched]
        have = old >= 0
        rows = np.concatenate((rows, np.repeat(touched, have.sum(axis=1))))
        to, how = np.concatenate((to, old[have])), np.concatenate((how, sims[touched][have]))
        order = np.lexsort((to, -how, rows))
        rows, to, how = rows[order], to[order], how[order]
        fresh = np.concatenate(([True], (rows[1:] != rows[:-1]) | (to[1:] != to[:-1])))
        rows, to, how = rows[fresh], to[fresh], how[fresh]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        kept = place < near.shape[1]
        near[touched], sims[touched] = -1, -np.inf
        near[rows[kept], place[kept]], sims[rows[kept], place[kept]] = to[kept], how[kept]

    def descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """The best node for each query in the layer above the given one, by greedy steps from the top."""
        at = np.full((len(queries), 1), self.entry)
        for upper in range(len(self.near) - 1, layer, -1):
            at = self.beam(queries, at, 1, upper)[0]
        return at

    def beam(self, queries: np.ndarray, start: np.ndarray, breadth: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best nodes found for each query, unordered; -1 fills what is missing."""
        near, n = self.near[layer], len(self.vectors)
        b = len(queries)
        ids = np.full((b, max(breadth, start.shape[1])), -1, dtype=np.int64)
        ids[:, : start.shape[1]] = start
        sims = np.full(ids.shape, -np.inf, dtype=np.float32)
        sims[:, : start.shape[1]] = np.matmul(self.vectors[np.maximum(start, 0)], queries[:, :, None])[:, :, 0]
        sims[ids < 0] = -np.inf
        is_open = ids >= 0
        seen = np.full(b * n, -1, dtype=np.int32)
        seen[(np.arange(b)[:, None] * n + ids)[is_open]] = 0
        out_ids, out_sims = np.full((b, breadth), -1, dtype=np.int64), np.full((b, breadth), -np.inf, dtype=np.float32)
        who = np.arange(b)
        while True:
            alive = is_open.any(axis=1)
            if not alive.all():
                # ended queries leave the block
                self._best(ids[~alive], sims[~alive], who[~alive], out_ids, out_sims)
                ids, sims, is_open, who = ids[alive], sims[alive], is_open[alive], who[alive]
                if not len(who):
                    return out_ids, out_sims
            width = min(AT_ONCE, breadth)
            ranked = np.where(is_open, sims, -np.inf)
            pick = np.argpartition(-ranked, width - 1, axis=1)[:, :width] if ranked.shape[1] > width else np.broadcast_to(np.arange(ranked.shape[1]), ranked.shape)
            chosen = np.where(np.take_along_axis(is_open, pick, axis=1), np.take_along_axis(ids, pick, axis=1), -1)
            np.put_along_axis(is_open, pick, False, axis=1)
            new = np.where(chosen[:, :, None] >= 0, near[chosen], -1).reshape(len(who), -1).astype(np.int64)
            cell = who[:, None] * n + new
            number = np.arange(new.size, dtype=np.int32).reshape(new.shape) + 1
            fresh = (new >= 0) & (seen[np.where(new >= 0, cell, 0)] < 0)
            flat = cell[fresh]
            seen[flat] = number[fresh]
            fresh[fresh] = seen[flat] == number[fresh]  # of a node that came twice, the last stays
            row, column = np.nonzero(fresh)
            more = np.full(new.shape, -np.inf, dtype=np.float32)
            more[row, column] = np.einsum("ij,ij->i", self.vectors[new[row, column]], queries[who[row]])
            worst = sims.min(axis=1) if ids.shape[1] >= breadth else np.full(len(who), -np.inf)
            fresh &= more > worst[:, None]
            ids = np.concatenate((ids, np.where(fresh, new, -1)), axis=1)
            sims = np.concatenate((sims, np.where(fresh, more, -np.inf)), axis=1)
            is_open = np.concatenate((is_open, fresh), axis=1)
            if ids.shape[1] > breadth:
                best = np.argpartition(-sims, breadth - 1, axis=1)[:, :breadth]
                ids, sims, is_open = (np.take_along_axis(x, best, axis=1) for x in (ids, sims, is_open))

    @staticmethod
    def _best(ids: np.ndarray, sims: np.ndarray, who: np.ndarray, out_ids: np.ndarray, out_sims: np.ndarray) -> None:
        width = out_ids.shape[1]
        if ids.shape[1] > width:
            best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
        out_ids[who, : ids.shape[1]], out_sims[who, : ids.shape[1]] = ids, sims

    def search(self, queries: np.ndarray, k: int, breadth: int, nodes: np.ndarray | None = None, least: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the k best nodes for each query, best first.

        If the queries are nodes of the graph (nodes tells which), the search starts at their neighbours and
        leaves the node itself out. If only nodes of at least a similarity are asked for, a node whose nearest
        neighbour, always one of its links, is less similar has none; other queries are searched narrowly first
        and again only if that came as near as ``NEARLY`` to the similarity.
        """
        b = len(queries)
        out_ids, out_sims = np.full((b, k), -1, dtype=np.int64), np.full((b, k), -np.inf, dtype=np.float32)
        if self.entry < 0:
            return out_ids, out_sims
        asked = np.arange(b)
        if least > -1.0:
            asked = asked[self.sims[0][nodes].max(axis=1, initial=-np.inf) >= least - 1e-6 if nodes is not None else self._nearest(queries) >= least - NEARLY]
        step = self._block()
        for low in range(0, len(asked), step):
            part = asked[low : low + step]
            q = queries[part]
            if nodes is None:
                ids, sims = self.beam(q, self.descend(q, 0), max(breadth, k))
            else:
                own = nodes[part]
                ids, sims = self.beam(q, np.concatenate((own[:, None], self.near[0][own]), axis=1), max(breadth, k + 1))
                sims = np.where(ids == own[:, None], -np.inf, sims)
            order = np.argsort(-sims, axis=1)[:, :k]
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            out_ids[part, : ids.shape[1]] = np.where(sims > -np.inf, ids, -1)
            out_sims[part, : ids.shape[1]] = sims
        return out_ids, out_sims

    def _nearest(self, queries: np.ndarray) -> np.ndarray:
        """The similarity of the nearest node that a narrow search finds for each query."""
        out, step = np.full(len(queries), -np.inf, dtype=np.float32), self._block()
        for low in range(0, len(queries), step):
            q = queries[low : low + step]
            out[low : low + step] = self.beam(q, self.descend(q, 0), NARROW)[1].max(axis=1)
        return out
