"""A graph of near neighbours in memory: NN-descent, and greedy search in it.

Plain numpy over the vectors of one shard. Lists are kept as whole numbers of 63
bits, (row, neighbour, old, similarity) or (row, distance, neighbour, fresh), so
that a round's finds are merged by two sorts of an array and without loops over
nodes; the comparisons are products of small matrices.
"""

from __future__ import annotations

import numpy as np

#: Finds that are held before they are merged into the lists.
HELD = 1 << 21
#: Numbers in a piece of work: it should stay near the processor.
PIECE = 1 << 20
#: Nodes that a group of queries is compared with at a time.
STEP = 1 << 13


def unit(v: np.ndarray) -> np.ndarray:
    """Divided by the length of the longest."""
    return v / (np.sqrt(np.einsum("ij,ij->i", v, v).max(initial=0.0)) or 1.0)


def where(good: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``np.nonzero`` of an array in one piece, but faster."""
    return np.unravel_index(np.flatnonzero(good), good.shape)


class Lists:
    """Of each of ``n`` nodes the ``keep`` most similar that it has met, most similar first."""

    def __init__(self, n: int, keep: int):
        self.n, self.keep = n, keep
        self.bits = max(1, int(n - 1).bit_length())
        self.steps = min(40, 62 - 2 * self.bits)  # bits of a similarity
        if self.steps < 20:
            raise ValueError(f"{n} nodes are too many for one shard")
        self.near = np.full((n, keep), -1, np.int32)
        self.far = np.full((n, keep), self.top, np.int64)  # whole-number distances
        self.fresh = np.zeros((n, keep), bool)

    @property
    def top(self) -> int:
        return (1 << self.steps) - 1

    def distance(self, sim: np.ndarray) -> np.ndarray:
        """Similarities of -1 to 1 as whole numbers, the most similar least."""
        return np.clip((1.0 - sim.astype(np.float64)) * (self.top / 2 - 1), 0, self.top - 1).astype(np.int64)

    def similarity(self, far: np.ndarray) -> np.ndarray:
        return np.where(far == self.top, -np.inf, 1.0 - far / (self.top / 2 - 1)).astype(np.float32)

    def best(self, row, other, old, far, limit: int):
        """(row, other, old, far, place) without repeats, the ``limit`` nearest of each row; of
        equal pairs the one that is not ``old`` = 1 first."""
        b, s = self.bits, self.steps
        key = np.sort((((row.astype(np.int64) << b | other) << 1 | old) << s) | far)
        pair = key >> (s + 1)
        key = key[np.append(True, pair[1:] != pair[:-1])] if len(key) else key
        other, old, far = key >> (s + 1) & ((1 << b) - 1), key >> s & 1, key & self.top
        key = np.sort((((key >> (s + 1 + b) << s | far) << b) | other) << 1 | old)
        row = key >> (s + b + 1)
        place = np.arange(len(key)) - np.searchsorted(row, np.arange(self.n))[row]
        take = place < limit
        key, row, place = key[take], row[take], place[take]
        return row, key >> 1 & ((1 << b) - 1), key & 1, key >> (b + 1) & self.top, place

    def merge(self, row: np.ndarray, other: np.ndarray, far: np.ndarray) -> None:
        """Finds into the lists; what was not there is fresh."""
        some = np.unique(row)
        r, c = where(self.near[some] >= 0)
        had = some[r]
        flag = np.append(np.zeros(len(had), np.int64), np.ones(len(row), np.int64))  # what is there goes before
        at = np.append(had, row)
        was = self.fresh[had, c]
        rows, others, new, fars, place = self.best(at, np.append(self.near[had, c], other), flag, np.append(self.far[had, c], far), self.keep)
        # entries that stay keep their mark
        marked = np.sort(had[was] * self.n + self.near[had, c][was])
        pair = rows * self.n + others
        if len(marked):
            i = np.minimum(np.searchsorted(marked, pair), len(marked) - 1)
            new = new | (marked[i] == pair)
        self.near[some], self.far[some], self.fresh[some] = -1, self.top, False
        self.near[rows, place], self.far[rows, place], self.fresh[rows, place] = others, fars, new.astype(bool)

    def floor(self) -> np.ndarray:
        """What a find must exceed to be taken."""
        return self.similarity(self.far[:, -1])


class Finds:
    """Finds on their way into lists, merged whenever there are many."""

    def __init__(self, lists: Lists):
        self.lists, self.held, self.many = lists, [], 0
        self.floor = lists.floor()

    def add(self, row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
        self.held.append((row.astype(np.int64), other.astype(np.int64), self.lists.distance(sim)))
        self.many += len(row)
        if self.many >= HELD:
            self.flush()

    def flush(self) -> None:
        if self.many:
            self.lists.merge(*(np.concatenate(x) for x in zip(*self.held)))
            self.floor = self.lists.floor()
        self.held, self.many = [], 0


def meet(v: np.ndarray, who: np.ndarray, new: np.ndarray, finds: Finds, told: int | None) -> None:
    """Compare the nodes of each row of ``who`` (-1: none) with one another, pairs
    with at least one ``new`` node; tell each the others, or the best ``told``."""
    x = v[who]
    s = np.matmul(x, x.transpose(0, 2, 1))
    floor = np.where(who >= 0, finds.floor[who], np.inf)
    good = s > floor[:, :, None]
    good &= new[:, :, None] | new[:, None, :]
    good &= (who >= 0)[:, None, :]
    good[:, np.arange(who.shape[1]), np.arange(who.shape[1])] = False
    if told and told < who.shape[1]:
        s = np.where(good, s, -np.inf)
        good &= s >= np.partition(s, -told, axis=2)[:, :, -told, None]
    a, b, c = where(good)
    finds.add(who[a, b], who[a, c], s[a, b, c])


def plant(v: np.ndarray, lists: Lists, trees: int, run: int, seed: int = 1000) -> None:
    """First lists: exact comparisons within runs of nodes that stand together by
    random hyperplanes and a projection."""
    n, d = v.shape
    run = max(2, min(run, n))
    for tree in range(trees):
        rng = np.random.default_rng(seed + tree)
        planes, line = rng.normal(size=(d, 6)).astype(np.float32), rng.normal(size=d).astype(np.float32)
        order = np.lexsort((v @ line, (v @ planes > 0) @ (1 << np.arange(6))))
        whole = np.append(order, np.full(-n % run, -1)).reshape(-1, run)
        finds = Finds(lists)
        for some in whole:
            some = some[some >= 0]
            s = v[some] @ v[some].T
            np.fill_diagonal(s, -np.inf)
            k = min(lists.keep, len(some) - 1)
            if not k:
                continue
            # no worse than the row's k-th best here
            least = np.maximum(np.partition(s, len(some) - k, axis=1)[:, len(some) - k], np.nextafter(finds.floor[some], np.float32(2)))
            a, b = where(s >= least[:, None])
            finds.add(some[a], some[b], s[a, b])
        finds.flush()


def descend(v: np.ndarray, lists: Lists, named: int, told: int | None) -> int:
    """One round of NN-descent: each node's ``named`` nearest, of those in its list
    and those that have it in theirs, meet. Returns how many entries are fresh."""
    row, c = where(lists.near >= 0)
    near, far, old = lists.near[row, c].astype(np.int64), lists.far[row, c], (~lists.fresh[row, c]).astype(np.int64)
    row, other, old, _, place = lists.best(np.append(row, near), np.append(near, row), np.append(old, old), np.append(far, far), named)
    who, new = np.full((lists.n, named), -1, np.int32), np.zeros((lists.n, named), bool)
    who[row, place], new[row, place] = other, old == 0
    lists.fresh[:] = False
    some = np.flatnonzero(new.any(axis=1))
    finds, step = Finds(lists), max(1, PIECE // (named * max(named, v.shape[1])))
    for a in range(0, len(some), step):
        meet(v, who[some[a : a + step]], new[some[a : a + step]], finds, told)
    finds.flush()
    return int(lists.fresh.sum())


def build(v: np.ndarray, keep: int, trees: int = 2, run: int = 256, named: int | None = None, told: int | None = None, settled: float = 0.1) -> Lists:
    """Lists of unit vectors ``v``. Rounds go on until at most ``settled`` of the
    entries change; each change betters a list, so they end."""
    lists = Lists(len(v), keep)
    plant(v, lists, trees, run)
    while descend(v, lists, named or 4 * keep // 3, told) > settled * len(v) * keep:
        pass
    return lists


def search(v: np.ndarray, near: np.ndarray, q: np.ndarray, first: np.ndarray, own: np.ndarray, beam: int, width: int, group: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector of ``q`` the best ``beam`` nodes that greedy search sees (-1:
    none), best first, and their products.

    It starts from the nodes ``first`` and from the query's ``own`` node (-1: none),
    and expands its ``width`` best unexpanded nodes at a time until all of its beam
    are expanded. Queries that stand together go in groups: what one of them sees
    is compared with all, in one product of matrices, and expanded once.
    """
    n, m = len(v), len(q)
    near = np.where(near < 0, n, near)  # the last place stands for no node
    nodes, sims = np.full((m, min(beam, n)), -1, np.int64), np.full((m, min(beam, n)), -np.inf, np.float32)
    pivots = q[np.random.default_rng(7).choice(m, -(-m // group), replace=False)] if m else q
    order = np.argsort(np.argmax(q @ pivots.T, axis=1), kind="stable") if m else np.zeros(0, int)
    for a in range(0, m, group):
        some = order[a : a + group]
        mine = own[some]
        nodes[some], sims[some] = _search(v, near, q[some], np.union1d(first, mine[mine >= 0]), nodes.shape[1], width)
    return nodes, sims


def _search(v: np.ndarray, near: np.ndarray, q: np.ndarray, found: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, m = len(v), len(q)
    seen, open_ = np.zeros(n + 1, bool), np.ones(n + 1, bool)
    seen[n], open_[n] = True, False
    nodes, sims = np.full((m, beam), n, np.int64), np.full((m, beam), -np.inf, np.float32)
    while len(found):
        seen[found] = True
        # in pieces: what a beam has from one bounds what it takes from the next
        for a in range(0, len(found), STEP):
            some = found[a : a + STEP]
            s = q @ v[some].T
            least = sims[:, -1:]
            if len(some) > beam and sims[0, -1] == -np.inf:
                least = np.nextafter(np.partition(s, len(some) - beam, axis=1)[:, len(some) - beam, None], np.float32(-np.inf))
            r, c = where(s > least)  # what the beams can take
            if not len(r):
                continue
            count = np.bincount(r, minlength=m)
            place = beam + np.arange(len(r)) - (np.cumsum(count) - count)[r]
            wide = np.full((m, beam + int(count.max())), n, np.int64), np.full((m, beam + int(count.max())), -np.inf, np.float32)
            wide[0][:, :beam], wide[1][:, :beam] = nodes, sims
            wide[0][r, place], wide[1][r, place] = some[c], s[r, c]
            order = np.argsort(-wide[1], axis=1)[:, :beam]
            nodes, sims = (np.take_along_axis(x, order, 1) for x in wide)
        found = found[:0]
        while not len(found):  # again if all neighbours of those are known
            todo = open_[nodes]
            chosen = nodes[todo & (np.cumsum(todo, axis=1) <= width)]
            if not len(chosen):
                break
            chosen = np.unique(chosen)
            open_[chosen] = False
            met = np.zeros(n + 1, bool)
            met[near[chosen].ravel()] = True
            found = np.flatnonzero(met & ~seen)
    return np.where(nodes < n, nodes, -1), sims
