"""A compressed prefix tree over ordered sets, probed for all sets of a Jaccard similarity."""

from __future__ import annotations

import numpy as np

PIECE = 32  # ids on one edge at most, so that a hopeless edge is left early
CELLS = 1 << 26  # ids times sets that one batch of probe_all marks at most


class PrefixTree:
    """sets: ascending arrays of ids (small ids first on every path); sizes: full set sizes, which may be larger.

    Ids not shared with any other set may be left out of the arrays; they count in the sizes alone.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, vocabulary: int):
        self.sets, self.sizes = sets, np.asarray(sizes, np.int64)
        self.member = np.zeros(vocabulary, bool)
        parent, start, end, owner = [-1], [0], [0], [0]
        ends_at = np.zeros(len(sets), np.int64)
        path, before = [0], None
        for i in sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()):
            own = sets[i]
            shared = 0
            if before is not None:
                m = min(len(own), len(before))
                differ = np.flatnonzero(own[:m] != before[:m])
                shared = int(differ[0]) if len(differ) else m
            low = None
            while end[path[-1]] > shared:
                low = path.pop()
            if low is not None and end[path[-1]] < shared:  # the shared part ends inside an edge: cut it there
                parent.append(parent[low]); start.append(start[low]); end.append(shared); owner.append(owner[low])
                parent[low], start[low] = len(parent) - 1, shared
                path.append(len(parent) - 1)
            while end[path[-1]] < len(own):
                parent.append(path[-1]); start.append(end[path[-1]]); owner.append(i)
                end.append(min(len(own), end[path[-1]] + PIECE))
                path.append(len(parent) - 1)
            ends_at[i] = path[-1]
            before = own
        self.start, self.end, owner, self.parent = (np.array(x, np.int64) for x in (start, end, owner, parent))
        nodes = len(self.start)
        self.length = self.end - self.start
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.ids = np.concatenate([sets[o][s:e] for o, s, e in zip(owner, self.start, self.end)] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.last = np.array([sets[o][e - 1] if e > s else -1 for o, s, e in zip(owner, self.start, self.end)], np.int64)
        # the longest path and the smallest set below each node
        self.deepest = self.end.copy()
        self.smallest = np.full(nodes, np.iinfo(np.int64).max)
        np.minimum.at(self.smallest, ends_at, self.sizes)
        for node in np.argsort(-self.end, kind="stable"):
            up = self.parent[node]
            if up >= 0:
                self.deepest[up] = max(self.deepest[up], self.deepest[node])
                self.smallest[up] = min(self.smallest[up], self.smallest[node])
        by_parent = np.argsort(self.parent, kind="stable")
        self.children = by_parent
        self.child_at = np.searchsorted(self.parent[by_parent], np.arange(nodes + 1))
        self.ending = np.argsort(ends_at, kind="stable")
        self.ending_at = np.searchsorted(ends_at[self.ending], np.arange(nodes + 1))

    @staticmethod
    def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
        total = int(count.sum())
        return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)

    def probe(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Indexes of the tree's sets with 100 * intersection >= 80 * union against a set of ``size`` with these ids.

        Two sets of sizes x and y reach 0.8 exactly if their intersection is at least 4 / 9 of x + y. Walking down,
        the overlap so far is shared by all sets below; a subtree is left when even its longest rest, or the rest
        of the probe, can't reach that for the smallest set in it.
        """
        self.member[ids] = True
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            lengths = self.length[nodes]
            hits = np.concatenate([[0], np.cumsum(self.member[self.ids[self._ranges(self.offset[nodes], lengths)]])])
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            overlap = overlap + hits[bounds[1:]] - hits[bounds[:-1]]
            counts = self.ending_at[nodes + 1] - self.ending_at[nodes]
            if counts.any():
                ended = self.ending[self._ranges(self.ending_at[nodes], counts)]
                found.append(ended[9 * np.repeat(overlap, counts) >= 4 * (size + self.sizes[ended])])
            rest = np.minimum(len(ids) - np.searchsorted(ids, self.last[nodes], side="right"), self.deepest[nodes] - self.end[nodes])
            alive = 9 * (overlap + rest) >= 4 * (size + self.smallest[nodes])
            nodes, overlap = nodes[alive], overlap[alive]
            counts = self.child_at[nodes + 1] - self.child_at[nodes]
            overlap = np.repeat(overlap, counts)
            nodes = self.children[self._ranges(self.child_at[nodes], counts)]
        self.member[ids] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def probe_all(self, sets: list[np.ndarray], sizes: np.ndarray):
        """(own, probes) by set of the tree that any of the given sets reaches: its index and theirs.

        Finds what ``probe`` finds for each of the sets, but a node is visited once for all sets of a batch.
        """
        sizes = np.asarray(sizes, np.int64)
        step = max(1, CELLS // max(1, len(self.member)))
        for first in range(0, len(sets), step):
            some, size = sets[first:first + step], sizes[first:first + step]
            has = np.zeros((len(self.member), len(some)), np.uint8)
            has[np.concatenate(some), np.repeat(np.arange(len(some)), [len(s) for s in some])] = 1
            length = np.array([len(s) for s in some], np.int64)
            open_ = [(0, np.arange(len(some)), np.zeros(len(some), np.int64))]
            while open_:
                node, who, overlap = open_.pop()
                if self.length[node]:
                    ids = self.ids[self.offset[node]:self.offset[node + 1]]
                    held = has[ids] if len(who) == len(some) else has[ids[:, None], who]
                    overlap = overlap + held.sum(0, dtype=np.uint8)  # at most PIECE
                for own in self.ending[self.ending_at[node]:self.ending_at[node + 1]]:
                    ok = 9 * overlap >= 4 * (size[who] + self.sizes[own])
                    if ok.any():
                        yield int(own), first + who[ok]
                most = np.minimum(length[who], overlap + self.deepest[node] - self.end[node])
                alive = 9 * most >= 4 * (size[who] + self.smallest[node])
                if alive.any():
                    who, overlap = who[alive], overlap[alive]
                    open_ += [(child, who, overlap) for child in self.children[self.child_at[node]:self.child_at[node + 1]]]


def local_ids(arrays: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The arrays' values as ids by falling frequency (ties by value), each array ascending, and the number of ids."""
    if not arrays:
        return [], 0
    values, inverse, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    cuts = np.cumsum([len(a) for a in arrays])[:-1]
    return [np.sort(part) for part in np.split(rank[inverse], cuts)], len(values)
