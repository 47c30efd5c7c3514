"""Triangles of oriented edges without shuffled wedges.

Edges lie in parts, ranges of their source. A part asks the parts that own its targets for their targets' neighbours,
once for each target, and gets them packed, a few bytes an edge. It closes wedges in memory, against its own edges, so
a wedge is never a row. At most every edge is sent to every part; fewer, the more of a part's targets are the same.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Generations, workers, written
from ..plans.supersteps import PACKED, by_part, packed_rows, rows_of, supersteps, trim

#: Edges of a part, wedges that a task closes at once, bits of the table that tells most wedges that nothing closes.
PART_EDGES, WEDGES, TABLE_BITS = 500_000, 1 << 20, 24
#: Bytes of packed lists in one row, edges that a task packs at once, ends of edges in the sample for each part.
ROW_BYTES, PACK_EDGES, SAMPLE = 4 << 20, 1 << 20, 200
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each in the fewest bytes."""
    out = []
    for a in arrays:
        least, most = (int(a.min()), int(a.max())) if a.size else (0, 0)
        kind = next(k for k in "BHIq" if k == "q" or least >= 0 and most <= np.iinfo(k).max)
        out.append(struct.pack("<cq", kind.encode(), a.size) + a.astype(np.dtype(kind).newbyteorder("<")).tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = struct.unpack_from("<cq", data, at)
        a = np.frombuffer(data, np.dtype(kind.decode()).newbyteorder("<"), n, at + 9)
        out.append(a.astype(np.int64))
        at += 9 + a.nbytes
    return out


def pack_lists(ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """Ascending ids with ascending, non-empty lists: as differences."""
    step = np.diff(flat, prepend=0)
    first = np.cumsum(sizes) - sizes
    heads = flat[first]
    step[first] = 0
    return pack(np.diff(ids, prepend=0), sizes, heads, step)


def unpack_lists(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return as_lists(*unpack(data))


def as_lists(ids: np.ndarray, sizes: np.ndarray, heads: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = np.cumsum(step)
    first = np.cumsum(sizes) - sizes
    return np.cumsum(ids), sizes, total + np.repeat(heads - total[first], sizes)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of a partition's edges; all of a source are in it."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not found:
        return
    src, dst = (np.concatenate(x) for x in zip(*found))
    del found
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    ids, sizes = np.unique(src, return_counts=True)
    yield packed_rows([(TaskContext.get().partitionId(), 0, int(ids[0]), int(ids[-1]), pack_lists(ids, sizes, dst))])


def _ask(bounds: list[tuple[int, int, int]]):
    """Rows to each part that owns targets of a part: who asks, and for which targets."""
    owner, lo, hi = (np.array(x, np.int64) for x in zip(*bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data")):
                targets = np.unique(unpack_lists(data.as_py())[2])
                at = np.searchsorted(lo, targets, "right") - 1
                owned = (at >= 0) & (targets <= hi[at])
                targets, at = targets[owned], at[owned]
                cuts = np.flatnonzero(np.diff(at, prepend=-1))
                rows = [(int(owner[at[i]]), 1, part, 0, pack(np.diff(targets[i:j], prepend=0))) for i, j in zip(cuts, [*cuts[1:], len(at)]) if owner[at[i]] != part]
                if rows:
                    yield packed_rows(rows)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each part that asks, the lists of the targets asked for that have any."""
    own = -1
    for part, kind, asker, data in rows_of(batches):
        if kind == 0:
            own, (ids, sizes, flat) = part, unpack_lists(data)
            starts = np.cumsum(sizes) - sizes
            continue
        assert part == own, "requests follow their part's edges"
        targets = np.cumsum(unpack(data)[0])
        at = np.minimum(np.searchsorted(ids, targets), len(ids) - 1)
        at = at[ids[at] == targets]
        while len(at):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at]), ROW_BYTES // 2)))
            some, at = at[:n], at[n:]
            yield packed_rows([(asker, 1, part, 0, pack_lists(ids[some], sizes[some], flat[spread(starts[some], sizes[some])]))])


class Part:
    """A part's edges, found by target, and a table of them that tells whether an edge closes a wedge."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.ids = ids
        u = np.repeat(np.arange(len(ids)), sizes)
        self.targets, w = np.unique(flat, return_inverse=True)
        self.keys = u * len(self.targets) + w  # ascending
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.cell(self.keys)] = True
        self.order = order = np.argsort(w, kind="stable")
        self.near, self.degree = u[order], np.bincount(w, minlength=len(self.targets))
        self.first = np.cumsum(self.degree) - self.degree

    @staticmethod
    def cell(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * GOLDEN) >> np.uint64(64 - TABLE_BITS)

    def closed(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Triangles u, v, w of own edges from u to v and w, for ids v with lists of w."""
        n = len(self.targets)
        for uv, uw, _ in self.places(ids, sizes, flat):
            key = self.keys[uv]
            yield self.ids[key // n], self.targets[key % n], self.targets[self.keys[uw] % n]

    def places(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same as places: of the own edges from u to v and from u to w, and of w in the lists."""
        v = np.minimum(np.searchsorted(self.targets, ids), len(self.targets) - 1)
        w = np.minimum(np.searchsorted(self.targets, flat), len(self.targets) - 1)
        known = (self.targets[w] == flat) & np.repeat(self.targets[v] == ids, sizes)
        sizes = np.bincount(np.repeat(np.arange(len(ids)), sizes)[known], minlength=len(ids))
        known = np.flatnonzero(known)
        w = w[known]
        starts = np.cumsum(sizes) - sizes
        some = np.flatnonzero(sizes)
        v, sizes, starts = v[some], sizes[some], starts[some]
        # an edge u to v with each w of v's list: runs of wedges, cut where they get too many
        edge = spread(self.first[v], self.degree[v])
        owner = np.repeat(np.arange(len(v)), self.degree[v])
        total = np.cumsum(sizes[owner])
        i = 0
        while i < len(edge):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + WEDGES, "right")))
            o, u = owner[i:j], self.near[edge[i:j]]
            n = sizes[o]
            to = spread(starts[o], n)
            key = np.repeat(u * len(self.targets), n) + w[to]
            hit = np.flatnonzero(self.table[self.cell(key)])
            key = key[hit]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            true = self.keys[at] == key
            hit = hit[true]
            if len(hit):
                run = np.searchsorted(np.cumsum(n), hit, "right")
                yield self.order[edge[i:j][run]], at[true], known[to[hit]]
            i = j


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, own = None, -1
    for p, kind, _, data in rows_of(batches):
        lists = unpack_lists(data)
        if kind == 0:
            part, own = Part(*lists), p
        assert part is not None and p == own, "answers follow their part's edges"
        for found in part.closed(*lists):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v", "w"])


def parts(o: DataFrame, rows: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The packed lists of ``src, dst`` by ranges of ``src`` of about so many rows; ``part, least, greatest`` of each."""
    workers(o.sparkSession)
    n = max(1, -(-o.count() // rows))
    own = written(o.select("src", "dst").repartitionByRange(n, "src").mapInArrow(_pack_part, PACKED))
    return own, sorted((tuple(r) for r in own.select("part", "lo", "hi").collect()), key=lambda r: r[1])  # a row for each part


def lists_of(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges in any order as ascending lists."""
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    return *np.unique(src, return_counts=True), dst


def split(cuts: np.ndarray):
    """Both directions of edges, packed for each part; parts are the ranges between cuts."""

    def packs(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) for x in zip(*found))
        found.clear()
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        del a, b
        order = np.lexsort((dst, src))
        src = src[order]
        dst = dst[order]
        del order
        at = [0, *np.searchsorted(src, cuts).tolist(), len(src)]
        for p, (i, j) in enumerate(zip(at, at[1:])):
            if i < j:
                yield packed_rows([(p, 1, 0, 0, pack_lists(*np.unique(src[i:j], return_counts=True), dst[i:j]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            if b.num_rows:
                found.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                held += b.num_rows
            if held >= PACK_EDGES:
                yield from packs(found)
                found, held = [], 0
        if found:
            yield from packs(found)
        trim()

    return run


def _gathered(cuts: np.ndarray, tell: bool = True):
    """A part's vertices with all neighbours, and the degrees of its vertices to the parts of their neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in itertools.groupby(rows_of(batches), lambda r: r[0]):
            lists = [unpack_lists(r[3]) for r in rows]
            ids, sizes, flat = lists_of(np.concatenate([np.repeat(i, n) for i, n, _ in lists]), np.concatenate([x for _, _, x in lists]))
            del lists
            yield packed_rows([(part, 0, 0, 0, pack_lists(ids, sizes, flat))])
            if not tell:
                continue
            pairs = np.unique(np.searchsorted(cuts, flat, "right") * len(ids) + np.repeat(np.arange(len(ids)), sizes))
            to, about = pairs // len(ids), pairs % len(ids)
            for p in np.unique(to[to != part]):
                mine = about[to == p]
                yield packed_rows([(int(p), 1, part, 0, pack(np.diff(ids[mine], prepend=0), sizes[mine]))])
        trim()

    return run


def _core(least: int, cuts: np.ndarray):
    """Drops vertices of fewer neighbours than ``least``, and what loses neighbours by that, as far as the part can tell;
    other parts of their neighbours get told."""

    def step(part: int, data: bytes, got: list[tuple[int, bytes]]) -> Iterator[tuple]:
        ids, sizes, flat = unpack_lists(data)
        gone = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack(m)[0]) for _, m in got)]))
        told = []
        while True:
            run = np.repeat(np.arange(len(ids)), sizes)
            if len(gone):
                keep = ~np.isin(flat, gone)
                run, flat = run[keep], flat[keep]
            sizes = np.bincount(run, minlength=len(ids))
            low = sizes < least
            if not low.any():
                break
            keep, gone = ~low[run], ids[low]
            told.append((ids[run[~keep]], flat[~keep]))
            ids, sizes, flat = ids[~low], sizes[~low], flat[keep]
        yield part, 0, 0, 0, pack_lists(ids, sizes, flat)
        if told:
            about, near = (np.concatenate(x) for x in zip(*told))
            to = np.searchsorted(cuts, near, "right")
            for p in np.unique(to[to != part]):
                yield int(p), 1, part, 0, pack(np.diff(np.unique(about[to == p]), prepend=0))

    return step


def _oriented(least: int):
    """A part's edges to later neighbours by degree, of vertices of at least so many neighbours."""

    def oriented(part: int, lists: tuple, told: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, sizes, flat = lists
        known = np.concatenate([ids, *(np.cumsum(x) for x, _ in told)])
        degree = np.concatenate([sizes, *(n for _, n in told)])
        order = np.argsort(known)
        known, degree = known[order], degree[order]
        src, d1, d2 = np.repeat(ids, sizes), np.repeat(sizes, sizes), degree[np.searchsorted(known, flat)]
        keep = ((d1 < d2) | ((d1 == d2) & (src < flat))) & (d1 >= least) & (d2 >= least)
        if keep.any():
            ids, sizes = np.unique(src[keep], return_counts=True)
            yield packed_rows([(part, 0, int(ids[0]), int(ids[-1]), pack_lists(ids, sizes, flat[keep]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in itertools.groupby(rows_of(batches), lambda r: r[0]):
            lists = unpack_lists(next(rows)[3])
            yield from oriented(part, lists, [unpack(r[3]) for r in rows])
        trim()

    return run


def cuts_of(edges: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """How many parts of about so many edges there are, and the ids between their ranges."""
    count = edges.count()
    n = max(1, -(-count // rows))
    # only the parts' sizes depend on the sample
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).sample(min(1.0, SAMPLE * n / max(1, 2 * count)), 0) if n > 1 else None
    some = np.sort(np.array([r["id"] for r in ends.collect()], np.int64)) if ends is not None else np.zeros(0, np.int64)
    return n, np.unique(some[np.arange(1, n) * len(some) // n]) if len(some) else some


def oriented_parts(edges: DataFrame, rows: int, least: int = 0, kept: Generations | None = None, core: bool = False) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """As ``parts`` of canonical edges from the earlier end by degree to the later, without edges of vertices of lower degree
    than ``least``; ``core``: of the ``least``-core, by the degrees in it. Parts get their vertices' neighbours packed and tell each other degrees, so edges are no rows of a
    shuffle."""
    workers(edges.sparkSession)
    n, cuts = cuts_of(edges, rows)
    packed = edges.select("src", "dst").mapInArrow(split(cuts), PACKED)
    kept = kept or Generations(edges.sparkSession)
    told = by_part(packed, n).mapInArrow(_gathered(cuts, not core), PACKED)
    if core:
        told = supersteps(kept, told, n, _core(least, cuts)).mapInArrow(_gathered(cuts), PACKED)
    own = kept.write(by_part(told, n).mapInArrow(_oriented(least), PACKED))
    return own, sorted((tuple(r) for r in own.select("part", "lo", "hi").collect()), key=lambda r: r[1])


def with_answers(own: DataFrame, bounds: list[tuple[int, int, int]], kept: Generations | None = None, more: DataFrame | None = None) -> DataFrame:
    """Each part's lists, and after them those of its targets in other parts, and ``more``, rows of a greater kind."""
    n = len(bounds)
    answers = (kept or Generations(own.sparkSession)).write(by_part(own.unionByName(own.mapInArrow(_ask(bounds), PACKED)), n).mapInArrow(_answer, PACKED))
    rows = own.unionByName(answers)
    return by_part(rows if more is None else rows.unionByName(more), n)


def _listed(own: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    if not bounds:
        return own.sparkSession.createDataFrame([], "u bigint, v bigint, w bigint")
    return with_answers(own, bounds).mapInArrow(_close, "u bigint, v bigint, w bigint")


def listed(o: DataFrame) -> DataFrame:
    """``u, v, w``: each triangle of oriented, acyclic edges ``src, dst`` once, with edges from u to v and w and from v to
    w. No edges: no rows."""
    return _listed(*parts(o, PART_EDGES))


def listed_by_degree(edges: DataFrame) -> DataFrame:
    """The same of canonical edges, oriented by degree."""
    return _listed(*oriented_parts(edges, PART_EDGES))
