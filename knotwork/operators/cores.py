"""k-cores and core numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Generations, iterate
from ..plans.supersteps import PACKED, by_part, rows_of, stepped, supersteps
from ..sources.edges import symmetric
from .graph import degrees
from .listing import pack, parts, spread, unpack, unpack_lists

#: Neighbours of a part's vertices.
PART_ROWS = 4_000_000
#: Values whose h-indices are found at once.
BLOCK = 1 << 18


def k_core(edges: DataFrame, k: int, max_iter: int | None = None) -> DataFrame:
    """Canonical edges of the maximal subgraph in which every vertex has degree k at least; vertices of lower degree
    go round by round, at most ``max_iter`` rounds (below 1: the input; None: to the end)."""
    if max_iter is not None and max_iter < 1:
        return edges

    def round_(e: DataFrame) -> DataFrame:
        low = degrees(e).filter(F.col("degree") < k).select("id")
        return e.join(low.withColumnRenamed("id", "src"), "src", "left_anti").join(low.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")

    return iterate(edges.select("src", "dst"), round_, lambda a, b: (n := b.count()) in (0, a.count()), max_iter)


def h_indices(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The h-index of each run of values; no run is empty. Whole runs of about ``BLOCK`` values are sorted at once."""
    ends, out, i = np.cumsum(sizes), [np.zeros(0, np.int64)], 0
    while i < len(sizes):
        start = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, start + BLOCK, "right")))
        out.append(_h_indices(values[start : int(ends[j - 1])], sizes[i:j]))
        i = j
    return np.concatenate(out)


def _h_indices(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    run, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    most = int(sizes.max())
    key = np.sort(run * (most + 1) + most - np.minimum(values, most))  # no h-index is above a run's size
    return np.maximum.reduceat(np.minimum(most - (key - run * (most + 1)), np.arange(len(values)) - first[run] + 1), first)


def _state(known, place, near, sizes, values, to, about) -> bytes:
    """Ids known to a part, places of its own among them, places of their neighbours, values of all known, and which own
    value which other part needs. Packed, ascending numbers as differences."""
    return pack(np.diff(known, prepend=0), np.diff(place, prepend=0), sizes, near, values, to, np.diff(about, prepend=0))


def _first_state(bounds: list[tuple[int, int, int]]):
    """A part's state from its packed lists: degrees, and a bound above all degrees for vertices of other parts."""
    owner, lo, _ = (np.array(x, np.int64) for x in zip(*bounds))

    def step(part: int, data: bytes, _: list) -> Iterator[tuple]:
        ids, sizes, flat = unpack_lists(data)
        known, near = np.unique(np.concatenate([ids, flat]), return_inverse=True)
        place, near = near[: len(ids)], near[len(ids) :]
        values = np.full(len(known), 1 << 62)
        values[place] = sizes
        at = np.searchsorted(lo, flat, "right") - 1
        pairs = np.unique(np.repeat(np.arange(len(ids)), sizes) * len(lo) + at)
        about, to = pairs // len(lo), owner[pairs % len(lo)]
        yield part, 0, 0, 0, _state(known, place, near, sizes, values, to[to != part], about[to != part])

    return step


def _core_step(first: bool):
    """Own values sink to the h-index of their neighbours' until nothing in the part changes; values that changed, at
    first all, go to the parts that need them."""

    def step(part: int, data: bytes, got: list[tuple[int, bytes]]) -> Iterator[tuple]:
        known, place, sizes, near, values, to, about = unpack(data)
        known, place, about = np.cumsum(known), np.cumsum(place), np.cumsum(about)
        for _, message in got:
            ids, sent = unpack(message)
            values[np.searchsorted(known, np.cumsum(ids))] = sent
        before, starts = values[place], np.cumsum(sizes) - sizes
        while True:
            own = values[place]
            some = np.flatnonzero(np.add.reduceat(values[near] >= np.repeat(own, sizes), starts, dtype=np.int64) < own)
            if not len(some):
                break
            n = sizes[some]
            values[place[some]] = h_indices(values[near[spread(starts[some], n)]], n)
        yield part, 0, 0, 0, _state(known, place, near, sizes, values, to, about)
        changed = np.full(len(place), first) | (before != own)
        told = changed[about]
        for p in np.unique(to[told]):
            mine = place[about[told & (to == p)]]
            yield int(p), 1, part, 0, pack(np.diff(known[mine], prepend=0), values[mine])

    return step


def _core_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, data in rows_of(batches):
        known, place, _, _, values, _, _ = unpack(data)
        place = np.cumsum(place)
        yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(known)[place]), pa.array(values[place])], names=["id", "core"])


def core_numbers(edges: DataFrame) -> DataFrame:
    """``id, core``: the largest k whose core holds the vertex. Every vertex takes the h-index of its neighbours'
    values, from degrees downwards, until nothing changes. Parts of the vertices do so by themselves as far as they
    can and then send each other the values that changed."""
    own, bounds = parts(symmetric(edges), PART_ROWS)
    if not bounds:
        return edges.sparkSession.createDataFrame([], "id bigint, core bigint")
    kept, n = Generations(edges.sparkSession), len(bounds)
    rows = kept.write(own.mapInArrow(stepped(_first_state(bounds)), PACKED))
    rows = kept.write(by_part(rows, n).mapInArrow(stepped(_core_step(True)), PACKED))
    return supersteps(kept, rows, n, _core_step(False)).mapInArrow(_core_values, "id bigint, core bigint")


def max_core(edges: DataFrame, start: int = 2, step: int = 10) -> DataFrame:
    """``k, vertices`` of the cores tried: from ``start`` by ``step`` while they aren't empty, each inside the one
    before; then by 1 from the last. The last row that isn't empty is the degeneracy. As in the search by peeling,
    but read off the core numbers, which cost one loop for all k."""
    by = core_numbers(edges).groupBy("core").agg(F.count("*").alias("n"))
    sizes = {r["core"]: r["n"] for r in by.collect()}  # at most one row for each core number
    size = lambda k: sum(n for c, n in sizes.items() if c >= k)
    tried, k = [], start
    while size(k):
        tried.append((k, size(k)))
        k += step
    k = (tried[-1][0] if tried else 0) + 1
    while tried and size(k):
        tried.append((k, size(k)))
        k += 1
    return edges.sparkSession.createDataFrame(tried, "k int, vertices bigint")
