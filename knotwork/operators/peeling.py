"""Truss levels by parts that keep their triangles and send each other changes.

Each part keeps its own edges (those of its sources) and the triangles of which it has the earliest vertex: two of its
own edges and a third that may belong to another part, a foreign one. For a fixed level the owner of an edge counts its
triangles, those of other parts by their messages; it drops the edge when they are too few and tells the parts that sent
some. For all levels at once it keeps a bound of the edge's level and hears the bounds that the triangles elsewhere allow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.fixpoint import Generations
from ..plans.supersteps import PACKED, Step, packed_rows, rows_of, supersteps, trim
from .cores import h_indices
from .listing import Part, as_lists, oriented_parts, pack, pack_lists, spread, unpack, unpack_lists, with_answers

#: Edges of a part, whose triangles a task holds: fewer parts need fewer rounds, smaller ones less memory.
PART_EDGES = 500_000
#: Above any level: a bound that isn't known yet.
NO_BOUND = (1 << 31) - 1
NONE = np.zeros(0, np.int64)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


class State:
    """A part's own and foreign edges as lists, which own edges (by places) other parts have triangles of, as a list for
    each of these parts, the foreign edges' owners, triangles by places of their edges (a, b from u to v and w, c from v
    to w; foreign edges come after own ones), a ascending, and what a step keeps besides.

    Packed, b and c are places within the lists of u and v, so most numbers of a triangle are bytes."""

    def __init__(self, own: tuple, foreign: tuple, shared: tuple, owner: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, *rest: np.ndarray):
        self.own, self.foreign, self.shared, self.owner, self.a, self.b, self.c, self.rest = own, foreign, shared, owner, a, b, c, rest

    @staticmethod
    def _bases(own: tuple, foreign: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Of each own edge, where its source's list begins and where its target's does, which matters if it has one."""
        ids, sizes, flat = own
        known = np.concatenate([ids, foreign[0]])
        first = np.concatenate([_firsts(sizes), len(flat) + _firsts(foreign[1])])
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], flat), len(known) - 1)
        return np.repeat(_firsts(sizes), sizes), first[order][at]

    def packed(self) -> bytes:
        u, v = self._bases(self.own, self.foreign)
        lists = b"".join(pack_lists(*x) for x in (self.own, self.foreign, self.shared))
        return lists + pack(self.owner, _steps(self.a), self.b - u[self.a], self.c - v[self.a], *self.rest)

    @staticmethod
    def of(data: bytes) -> State:
        x = unpack(data)
        own, foreign, shared = (as_lists(*x[i : i + 4]) for i in (0, 4, 8))
        owner, a, b, c, *rest = x[12:]
        del x
        u, v = State._bases(own, foreign)
        a = np.cumsum(a).astype(np.int32)  # a part's edges are fewer
        return State(own, foreign, shared, owner, a, (b + u[a]).astype(np.int32), (c + v[a]).astype(np.int32), *rest)

    def shared_with(self, part: int) -> np.ndarray:
        """Places of the own edges that a part has triangles of."""
        parts, sizes, flat = self.shared
        i = int(np.searchsorted(parts, part))
        return flat[int(sizes[:i].sum()) :][: int(sizes[i])]

    def find(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Places of own edges, given as lists."""
        targets = np.unique(self.own[2])
        key = lambda i, n, x: np.repeat(np.searchsorted(self.own[0], i), n) * len(targets) + np.searchsorted(targets, x)
        return np.searchsorted(key(*self.own), key(ids, sizes, flat))

    def hear(self, first: list[tuple[int, list[np.ndarray]]]) -> np.ndarray:
        """From each part's first message, its triangles' edges and how many triangles each has; all these numbers."""
        first = sorted(first, key=lambda x: x[0])
        lists = [self.find(*as_lists(*more[1:])) for _, more in first]
        self.shared = (np.array([p for p, _ in first], np.int64), np.array([len(x) for x in lists], np.int64), np.concatenate([NONE, *lists]))
        return np.concatenate([NONE, *(more[0] for _, more in first)])


def _triangles(bounds: list[tuple[int, int, int]], rest: Callable):
    """A part's state from its lists and the answers, and counts of its foreign edges' triangles to their owners; ``rest``
    gives what the state keeps besides, from the triangles of each edge and how many edges are own."""
    owners, lo, _ = (np.array(x, np.int64) for x in zip(*bounds))

    def build(part: int, own: tuple, foreign: list[tuple], found: list[tuple]) -> Iterator[tuple]:
        n_own = len(own[2])
        a, b, c = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (zip(*found) if found else [()] * 3))
        src, dst = (np.concatenate([NONE, *x]) for x in (zip(*foreign) if foreign else [()] * 2))
        order = np.lexsort((dst, src))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        other = c >= n_own
        c[other] = n_own + rank[c[other] - n_own]
        src, dst = src[order], dst[order]
        by_a = np.argsort(a, kind="stable")
        a, b, c = a[by_a], b[by_a], c[by_a]
        n = np.bincount(a, minlength=n_own + len(src)) + np.bincount(b, minlength=n_own + len(src)) + np.bincount(c, minlength=n_own + len(src))
        owner = owners[np.searchsorted(lo, src, "right") - 1]
        yield part, 0, 0, 0, State(own, (*np.unique(src, return_counts=True), dst), (NONE, NONE, NONE), owner, a, b, c, *rest(n, n_own)).packed()
        for p in np.unique(owner):
            some = owner == p
            yield int(p), 1, part, 0, pack(np.array([0]), n[n_own:][some]) + pack_lists(*np.unique(src[some], return_counts=True), dst[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, at, foreign, found, held = None, None, -1, [], [], 0
        for p, kind, _, data in rows_of(batches):
            lists = unpack_lists(data)
            if kind == 0:
                if own is not None:
                    yield from (packed_rows([r]) for r in build(at, own, foreign, found))
                    part = own = foreign = found = None
                    trim()
                part, own, at, foreign, found, held = Part(*lists), lists, p, [], [], len(lists[2])
            some = [tuple(x.astype(np.int32) for x in y) for y in part.places(*lists)]
            if kind == 1 and some:  # only edges in triangles are kept
                used = np.zeros(len(lists[2]), bool)
                for _, _, c in some:
                    used[c] = True
                number = np.cumsum(used, dtype=np.int32) - 1 + held
                some = [(a, b, number[c]) for a, b, c in some]
                foreign.append((np.repeat(lists[0], lists[1])[used], lists[2][used]))
                held += len(foreign[-1][0])
            found.extend(some)
        if own is not None:
            yield from (packed_rows([r]) for r in build(at, own, foreign, found))
            part = own = foreign = found = None
            trim()

    return run


def _peel(least: int) -> Step:
    """Drops edges in fewer triangles than ``least``, and what loses triangles by that, as far as the part can tell.
    Messages: 0, a part's triangles of edges; 1, how many of them are gone; 2, edges that their owner dropped."""

    def step(part: int, data: bytes, got: list[tuple[int, bytes]]) -> Iterator[tuple]:
        x = State.of(data)
        support, dropped = x.rest
        n_own = len(support)
        dropped, gone, first = dropped > 0, np.zeros(n_own + len(x.owner), bool), []
        before = dropped.copy()
        for sender, message in got:
            what, *more = unpack(message)
            if what[0] == 0:
                first.append((sender, more))
            elif what[0] == 1:
                support[x.shared_with(sender)[np.cumsum(more[0])]] -= more[1]
            else:
                gone[n_own + np.flatnonzero(x.owner == sender)[np.cumsum(more[0])]] = True
        if first:
            n = x.hear(first)
            np.add.at(support, x.shared[2], n)
        lost = np.zeros(len(gone), np.int64)
        while True:
            low = ~dropped[:n_own] & (support < least)
            dropped[:n_own] |= low
            gone[:n_own] |= low
            if not gone.any():
                break
            dropped |= gone
            dead = gone[x.a] | gone[x.b] | gone[x.c]
            n = sum(np.bincount(y[dead], minlength=len(gone)) for y in (x.a, x.b, x.c))
            support -= n[:n_own]
            lost += n
            x.a, x.b, x.c = x.a[~dead], x.b[~dead], x.c[~dead]
            gone[:] = False
        x.rest = support, dropped
        yield part, 0, 0, 0, x.packed()
        tell = (lost > 0) & ~dropped
        for p in np.unique(x.owner):
            mine = n_own + np.flatnonzero(x.owner == p)
            some = np.flatnonzero(tell[mine])
            if len(some):
                yield int(p), 1, part, 0, pack(np.array([1]), _steps(some), lost[mine[some]])
        tell = dropped & ~before
        for p in x.shared[0]:
            some = np.flatnonzero(tell[x.shared_with(p)])
            if len(some):
                yield int(p), 1, part, 0, pack(np.array([2]), _steps(some))

    return step


def _refine(part: int, data: bytes, got: list[tuple[int, bytes]]) -> Iterator[tuple]:
    """Bounds of own edges sink to the h-index, over their triangles, of the lesser bound of the two other edges, until
    nothing in the part changes. Messages: 0, a part's triangles of edges; 1, bounds of edges by their owner; 2, of each
    triangle of an edge, the bound that the other two allow. A state keeps the bounds of own and foreign edges, how many
    triangles of each shared edge the other part has, and what these allow."""
    x = State.of(data)
    bound, n, far = x.rest
    bound, far = bound.astype(np.int32), far.astype(np.int32)
    n_own, first = len(x.own[2]), []
    there = np.flatnonzero(x.c >= n_own)
    there = there[np.argsort(x.c[there], kind="stable")]  # triangles by their foreign edges
    allowed = lambda: np.minimum(bound[x.a[there]], bound[x.b[there]])
    told, before = np.minimum(allowed(), bound[x.c[there]]), bound[:n_own].copy()
    at = _firsts(n)
    for sender, message in got:
        what, *more = unpack(message)
        if what[0] == 0:
            first.append((sender, more))
        elif what[0] == 1:
            bound[n_own + np.flatnonzero(x.owner == sender)[np.cumsum(more[0])]] = more[1]
        else:
            i = int(np.searchsorted(x.shared[0], sender))
            some = int(x.shared[1][:i].sum()) + np.cumsum(more[0])
            far[spread(at[some], n[some])] = more[1]
    if first:
        n = x.hear(first)
        far = np.full(int(n.sum()), NO_BOUND, np.int32)
        np.add.at(bound, x.shared[2], n)
    start = bool(first) or bool((bound[n_own:] == NO_BOUND).any())  # nothing is told yet
    edge = np.repeat(x.shared[2], n)
    while True:
        p, q, r = bound[x.a], bound[x.b], bound[x.c]
        least = np.minimum(np.minimum(p, q), r)
        count = sum(np.bincount(y[z == least], minlength=len(bound)) for y, z in ((x.a, p), (x.b, q), (x.c, r)))[:n_own]
        count = count + np.bincount(edge[far >= bound[edge]], minlength=n_own)
        low = np.zeros(len(bound), bool)
        low[:n_own] = count < bound[:n_own]
        if not low.any():
            break
        of = [(y, np.flatnonzero(low[y]).astype(np.int32)) for y in (x.a, x.b, x.c, edge)]
        values = np.concatenate([np.minimum(q[of[0][1]], r[of[0][1]]), np.minimum(p[of[1][1]], r[of[1][1]]), np.minimum(p[of[2][1]], q[of[2][1]]), far[of[3][1]]])
        edges = np.concatenate([y[z].astype(np.int32) for y, z in of])
        del p, q, r, least, of
        sizes = np.bincount(edges, minlength=len(bound))
        values = values[np.argsort(edges, kind="stable")]
        del edges
        ids = np.flatnonzero(sizes)
        bound[ids] = h_indices(values, sizes[ids])
    x.rest = bound, n, far
    yield part, 0, 0, 0, x.packed()
    new = np.zeros(len(bound), bool)
    new[:n_own] = start | (bound[:n_own] != before)
    for p in x.shared[0]:
        mine = x.shared_with(p)
        some = np.flatnonzero(new[mine])
        if len(some):
            yield int(p), 1, part, 0, pack(np.array([1]), _steps(some), bound[mine[some]])
    now = np.minimum(allowed(), bound[x.c[there]])
    new[x.c[there[start | (now < np.minimum(told, bound[x.c[there]]))]]] = True
    for p in np.unique(x.owner):
        mine = n_own + np.flatnonzero(x.owner == p)
        some = np.flatnonzero(new[mine])
        if len(some):
            sent = np.zeros(len(bound), bool)
            sent[mine[some]] = True
            yield int(p), 1, part, 0, pack(np.array([2]), _steps(some), now[sent[x.c[there]]])


def _results(column: str, keep: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, data in rows_of(batches):
            x = State.of(data)
            src, dst = np.repeat(x.own[0], x.own[1]), x.own[2]
            value = x.rest[0][: len(dst)]
            some = keep(value, x.rest[1])
            yield pa.RecordBatch.from_arrays([pa.array(y[some]) for y in (np.minimum(src, dst), np.maximum(src, dst), value)], names=["src", "dst", column])

    return run


def _settled(edges: DataFrame, least_degree: int, core: bool, rest: Callable, step: Step) -> DataFrame | None:
    """The parts' last states; None if there are no edges."""
    kept = Generations(edges.sparkSession, keep=3)
    own, bounds = oriented_parts(edges, PART_EDGES, least_degree, kept, core)
    if not bounds:
        return None
    n = max(b[0] for b in bounds) + 1
    rows = kept.write(with_answers(own, bounds, kept).mapInArrow(_triangles(bounds, rest), PACKED))
    kept.only_last()
    return supersteps(kept, rows, n, step)


def peeled(edges: DataFrame, least: int, least_degree: int = 0, core: bool = False) -> DataFrame:
    """``src, dst, support`` of the canonical edges left when those in fewer triangles than ``least`` (1 or more) go until
    there are none. Edges of vertices of a lower degree than ``least_degree`` (``core``: outside that core) are no rows
    and close no triangles."""
    schema = "src bigint, dst bigint, support bigint"
    rows = _settled(edges, least_degree, core, lambda n, n_own: (n[:n_own], np.zeros(len(n), np.int64)), _peel(least))
    if rows is None:
        return edges.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_results("support", lambda support, dropped: dropped[: len(support)] == 0), schema)


def refined(edges: DataFrame) -> DataFrame:
    """``src, dst, level`` of canonical edges in a triangle: the largest s such that the edge lies in a subgraph whose
    edges have s triangles in it."""
    schema = "src bigint, dst bigint, level bigint"
    rest = lambda n, n_own: (np.concatenate([n[:n_own], np.full(len(n) - n_own, NO_BOUND)]), NONE, NONE)
    rows = _settled(edges, 0, False, rest, _refine)
    if rows is None:
        return edges.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_results("level", lambda level, _: level > 0), schema)
