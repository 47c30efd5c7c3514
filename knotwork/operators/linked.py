"""Counts of two triangles that two edges link, by parts: paths and cycles are no rows.

The pattern: a cycle b, c, a, d of edges, a vertex p tied to b and c and a vertex q tied to a and d, where a, p and q have
one label and b, c and d others. With T(x, y) common neighbours of x and y of that label, each cycle has
(T(b, c) - [a and b are joined]) T(a, d) choices of p and q, less those vertices, tied to all four, that are p and q at
once. A part of the vertices b asks for the lists of their neighbours and sums both factors for each b and a in memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Generations, workers
from ..plans.patterns import Query
from ..plans.supersteps import PACKED, by_part, packed_rows, rows_of, trim
from .listing import ROW_BYTES, Part, _ask, as_lists, cuts_of, lists_of, pack, pack_lists, split, spread, unpack

#: Edges of a part, entries of neighbours' lists that a task sums at once (those of one vertex may be more).
PART_EDGES, ENTRIES = 500_000, 1 << 19
#: The last two bits of a key tell a vertex's label: that of a, p and q, of b, of c, of d.
A, B, C, D, OTHER = range(5)


def sides(query: Query) -> tuple[str, str, str, str] | None:
    """The labels of a, b, c and d if the query is this pattern."""
    ends = [v for v in query.vertices if query.degree(v) == 2]
    if len(query.vertices) != 6 or len(query.edges) != 8 or len(ends) != 2 or query.joined(*ends):
        return None
    for p, q in (ends, ends[::-1]):
        for a, d in itertools.permutations(query.near(q)):
            for b, c in itertools.permutations(query.near(p)):
                if len({a, b, c, d}) == 4 and all(query.joined(x, y) for x, y in ((b, c), (c, a), (a, d), (d, b))):
                    found = tuple(query.labels[v] for v in (a, b, c, d))
                    if len(set(found)) == 4 and query.labels[p] == query.labels[q] == found[0] and "_" not in found:
                        return found
    return None


def _by_cuts(cuts: np.ndarray):
    """Vertices and codes of their labels, packed for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, code = (b.column(i).to_numpy() for i in (0, 1))
            order = np.argsort(ids)
            ids, code = ids[order], code[order]
            at = [0, *np.searchsorted(ids, cuts).tolist(), len(ids)]
            rows = [(p, 2, 0, 0, pack(np.diff(ids[i:j], prepend=0), code[i:j])) for p, (i, j) in enumerate(zip(at, at[1:])) if i < j]
            if rows:
                yield packed_rows(rows)

    return run


def _told(cuts: np.ndarray):
    """A part's labelled vertices with all neighbours, and the codes to the parts of the neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in itertools.groupby(rows_of(batches), lambda r: r[0]):
            lists, codes = [], []
            for _, kind, _, data in rows:
                (lists if kind == 1 else codes).append(unpack(data))
            if not lists:  # vertices without edges
                continue
            lists = [as_lists(*x) for x in lists]
            ids, sizes, flat = lists_of(np.concatenate([np.repeat(i, n) for i, n, _ in lists]), np.concatenate([x for _, _, x in lists]))
            del lists
            code = np.full(len(ids), OTHER)
            for i, c in codes:
                i = np.cumsum(i)
                at = np.minimum(np.searchsorted(ids, i), len(ids) - 1)
                known = ids[at] == i
                code[at[known]] = c[known]
            some = code != OTHER
            ids, sizes, flat, code = ids[some], sizes[some], flat[np.repeat(some, sizes)], code[some]
            yield packed_rows([(part, 0, 0, 0, pack_lists(ids, sizes, flat) + pack(code))])
            if not len(ids):
                continue
            pairs = np.unique(np.searchsorted(cuts, flat, "right") * len(ids) + np.repeat(np.arange(len(ids)), sizes))
            to, about = pairs // len(ids), pairs % len(ids)
            for p in np.unique(to[to != part]):
                mine = about[to == p]
                yield packed_rows([(int(p), 1, part, 0, pack(np.diff(ids[mine], prepend=0), code[mine]))])
        trim()

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's edges that may be of use, to vertices like a and from b to c and d, by keys, with weights of 0."""
    for part, rows in itertools.groupby(rows_of(batches), lambda r: r[0]):
        *lists, code = unpack(next(rows)[3])
        ids, sizes, flat = as_lists(*lists)
        told = [unpack(r[3]) for r in rows]
        if not len(ids):
            continue
        if max(abs(int(flat.min())), abs(int(flat.max())), abs(int(ids[0])), abs(int(ids[-1]))) >= 1 << 60:
            raise ValueError("ids must leave room for two bits")
        known, codes = np.concatenate([ids, *(np.cumsum(i) for i, _ in told)]), np.concatenate([code, *(c for _, c in told)])
        order = np.argsort(known)
        known, codes = known[order], codes[order]
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        to, of = codes[at], np.repeat(code, sizes)
        keep = (known[at] == flat) & ((to == A) | (of == B) & (to != B))
        if keep.any():
            ids, sizes = np.unique(np.repeat(ids * 4 + code, sizes)[keep], return_counts=True)
            flat = (flat * 4 + to)[keep]
            yield packed_rows([(part, 0, int(ids[0]), int(ids[-1]), pack_lists(ids, sizes, flat) + pack(np.zeros(len(flat), np.int64)))])
    trim()


def _weighted(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    *lists, weights = unpack(data)
    return *as_lists(*lists), weights


def _of(code: int, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some = ids & 3 == code
    return ids[some], sizes[some], flat[np.repeat(some, sizes)]


def _asked(bounds: list[tuple[int, int, int]], code: int):
    """Requests for the lists of the targets of vertices with a code."""
    ask = _ask(bounds)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, data in rows_of(batches):
            lists = _of(code, *_weighted(data)[:3])
            if len(lists[0]):
                yield packed_rows([(part, 0, 0, 0, pack_lists(*lists))])

    return lambda batches: ask(some(batches))


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each part that asks, the lists asked for, with weights."""
    for part, kind, asker, data in rows_of(batches):
        if kind == 0:
            ids, sizes, flat, weights = _weighted(data)
            starts = np.cumsum(sizes) - sizes
            continue
        targets = np.cumsum(unpack(data)[0])
        at = np.minimum(np.searchsorted(ids, targets), len(ids) - 1)
        at = at[ids[at] == targets]
        while len(at):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at]), ROW_BYTES // 2)))
            some, at = at[:n], at[n:]
            to = spread(starts[some], sizes[some])
            yield packed_rows([(asker, 1, part, 0, pack_lists(ids[some], sizes[some], flat[to]) + pack(weights[to]))])


def _with_lists(own: DataFrame, bounds: list[tuple[int, int, int]], code: int, kept: Generations) -> DataFrame:
    n = len(bounds)
    answers = kept.write(by_part(own.unionByName(own.mapInArrow(_asked(bounds, code), PACKED)), n).mapInArrow(_answered, PACKED))
    return by_part(own.unionByName(answers), n)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's lists, with T(a, d) as weights of edges from d to a."""
    for part, rows in itertools.groupby(rows_of(batches), lambda r: r[0]):
        ids, sizes, flat, weights = _weighted(next(rows)[3])
        mine = _of(D, ids, sizes, flat)
        if len(mine[0]):
            edges, n = Part(*mine), np.zeros(len(mine[2]), np.int64)
            for lists in itertools.chain([_of(A, ids, sizes, flat)], (_weighted(r[3])[:3] for r in rows)):
                for found, _, _ in edges.places(*lists) if len(lists[0]) else ():
                    n += np.bincount(found, minlength=len(n))
            weights[np.repeat(ids & 3 == D, sizes)] = n
        yield packed_rows([(part, 0, 0, 0, pack_lists(ids, sizes, flat) + pack(weights))])
    trim()


def _within(some: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among ascending ones."""
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)


def _products(*sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of both sides, and for each the product of the sums of the weights."""
    sums = []
    for keys, weights in sides:
        keys, weights = keys[weights > 0], weights[weights > 0]
        order = np.argsort(keys)
        keys, first = np.unique(keys[order], return_index=True)
        sums.append((keys, np.add.reduceat(weights[order], first) if len(keys) else weights))
    both, i, j = np.intersect1d(sums[0][0], sums[1][0], assume_unique=True, return_indices=True)
    return both, sums[0][1][i] * sums[1][1][j]


def _count(own: tuple, answers: list[tuple]) -> int:
    """Embeddings with a vertex b of the part."""
    ids, sizes, flat, weights = (np.concatenate(x) for x in zip(own, *answers))
    starts, ranks = np.cumsum(sizes) - sizes, np.unique(flat[flat & 3 == A])
    order, rank, k = np.argsort(ids), np.searchsorted(ranks, flat), len(ranks)
    ids, sizes, starts = ids[order], sizes[order], starts[order]
    # pairs of joined vertices like a
    some = np.flatnonzero((ids & 3 == A) & _within(ranks, ids))
    joined = np.repeat(np.searchsorted(ranks, ids[some]), sizes[some]) * k + rank[spread(starts[some], sizes[some])]
    b, n, to = _of(B, *own[:3])
    at = np.repeat(np.arange(len(b)), n)
    near = to & 3 == A
    tied = at[near] * k + np.searchsorted(ranks, to[near])  # b and its neighbours like a, ascending
    place = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    length = np.where((ids[place] == to) & ~near, sizes[place], 0)
    start = starts[place]
    work = np.cumsum(np.bincount(at, length, len(b)))
    total, i = 0, 0
    while i < len(b):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + ENTRIES, "right")))
        lo, hi = np.searchsorted(at, (i, j))
        sides, wheels = [], []
        for code in (C, D):
            edge = lo + np.flatnonzero(to[lo:hi] & 3 == code)
            where = spread(start[edge], length[edge])
            of = np.repeat(np.arange(len(edge)), length[edge])
            key = at[edge][of] * k + rank[where]
            round_ = _within(tied, key)
            sides.append((key, np.bincount(of[round_], minlength=len(edge))[of] - round_ if code == C else weights[where]))
            x, again = np.searchsorted(tied, key[round_]), edge[of[round_]]
            key = np.repeat(x, length[again]) * k + rank[spread(start[again], length[again])]
            wheels.append((key, np.ones(len(key), np.int64)))
        total += int(_products(*sides)[1].sum())
        key, n_both = _products(*wheels)
        total -= int(n_both[_within(joined, tied[key // k] % k * k + key % k)].sum())
        i = j
    return total


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in itertools.groupby(rows_of(batches), lambda r: r[0]):
        own = _weighted(next(rows)[3])
        if (own[0] & 3 == B).any():
            yield pa.RecordBatch.from_arrays([pa.array([_count(own, [_weighted(r[3]) for r in rows])], pa.int64())], names=["n"])
    trim()


def linked_count(edges: DataFrame, labels: DataFrame, sides: tuple[str, str, str, str]) -> DataFrame:
    """One row, ``embeddings`` of the pattern with these labels; a vertex has at most one of them."""
    spark = edges.sparkSession
    workers(spark)
    kept = Generations(spark, keep=3)
    n, cuts = cuts_of(edges, PART_EDGES)
    code = F.element_at(F.create_map(*(F.lit(x) for pair in zip(sides, range(4)) for x in pair)), F.col("label")).cast("long")
    codes = labels.filter(F.col("label").isin(*sides)).select("id", code.alias("code")).mapInArrow(_by_cuts(cuts), PACKED)
    told = by_part(edges.select("src", "dst").mapInArrow(split(cuts), PACKED).unionByName(codes), n).mapInArrow(_told(cuts), PACKED)
    own = kept.write(by_part(told, n).mapInArrow(_keyed, PACKED))
    bounds = sorted((tuple(r) for r in own.select("part", "lo", "hi").collect()), key=lambda r: r[1])  # a row for each part
    if bounds:
        own = kept.write(_with_lists(own, bounds, D, kept).mapInArrow(_weigh, PACKED))
        counts = _with_lists(own, bounds, B, kept).mapInArrow(_counts, "n bigint")
    else:
        counts = spark.createDataFrame([], "n bigint")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("embeddings"))
