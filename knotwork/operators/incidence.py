"""Edges with their triangles, by parts: each edge's owner gets what parts found of it, packed."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.fixpoint import Generations
from ..plans.supersteps import PACKED, by_part, packed_rows, rows_of
from . import listing
from .listing import Part, oriented_parts, pack, pack_lists, unpack, unpack_lists, with_answers

#: Triangles of a message's parts, and edges of a batch of results.
TOLD, BATCH_EDGES = 1 << 19, 50_000


def _told(bounds: list[tuple[int, int, int]], apexes: bool):
    """To the owner of each edge its triangles' third vertices, or only how many there are."""
    owners, lo, _ = (np.array(x, np.int64) for x in zip(*bounds))

    def told(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        u, v, w = (np.concatenate(x) for x in zip(*found))
        src, dst = np.concatenate([u, u, v]), np.concatenate([v, w, w])
        ids, place = np.unique(dst, return_inverse=True)
        heads, at = np.unique(src, return_inverse=True)
        key = at * len(ids) + place
        if apexes:
            order = np.argsort(key, kind="stable")
            key, apex = key[order], np.concatenate([w, v, u])[order]
        else:
            key.sort()
        new = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(np.append(new, len(key)))
        src, dst = heads[key[new] // len(ids)], ids[key[new] % len(ids)]
        cuts = np.flatnonzero(np.diff(np.searchsorted(lo, src, "right"), prepend=-1))
        ends = np.append(new, len(key))
        for i, j in zip(cuts, [*cuts[1:], len(src)]):
            edges = pack_lists(*np.unique(src[i:j], return_counts=True), dst[i:j])
            more = pack(apex[ends[i] : ends[j]]) if apexes else b""
            yield packed_rows([(int(owners[np.searchsorted(lo, src[i], "right") - 1]), 1, 0, 0, edges + pack(n[i:j]) + more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, held = None, [], 0
        for _, kind, _, data in rows_of(batches):
            lists = unpack_lists(data)
            if kind == 0:
                part = Part(*lists)
            for some in part.closed(*lists):
                found.append(some)
                held += len(some[0])
                if held >= TOLD:
                    yield from told(found)
                    found, held = [], 0
        if found:
            yield from told(found)

    return run


def _message(data: bytes) -> tuple[np.ndarray, ...]:
    """Ends of edges, triangles of each, and third vertices if told."""
    ids, sizes, heads, step, n, *more = unpack(data)
    total, first = np.cumsum(step), np.cumsum(sizes) - sizes
    return np.repeat(np.cumsum(ids), sizes), total + np.repeat(heads - total[first], sizes), n, *more


def _apexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in itertools.groupby(rows_of(batches), lambda r: r[0]):
        src, dst, n, apex = (np.concatenate(x) for x in zip(*(_message(r[3]) for r in rows)))
        src, dst = np.repeat(src, n), np.repeat(dst, n)
        order = np.lexsort((apex, dst, src))
        src, dst, apex = src[order], dst[order], apex[order]
        new = np.flatnonzero((np.diff(src, prepend=src[0] - 1) != 0) | (np.diff(dst, prepend=dst[0] - 1) != 0))
        ends = np.append(new, len(src))
        for i in range(0, len(new), BATCH_EDGES):
            some = new[i : i + BATCH_EDGES]
            at = ends[i : i + len(some) + 1]
            lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(apex[at[0] : at[-1]], pa.int64()))
            s, d = src[some], dst[some]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, d)), pa.array(np.maximum(s, d)), pa.array(np.diff(at)), lists], names=["src", "dst", "support", "apexes"])


def edge_apexes(edges: DataFrame) -> DataFrame:
    """``src, dst, support, apexes`` of canonical edges in a triangle: the third vertices, ascending. No triangles: no rows."""
    schema = "src bigint, dst bigint, support bigint, apexes array<bigint>"
    own, bounds = oriented_parts(edges, listing.PART_EDGES)
    if not bounds:
        return edges.sparkSession.createDataFrame([], schema)
    return by_part(with_answers(own, bounds).mapInArrow(_told(bounds, True), PACKED), len(bounds)).mapInArrow(_apexes, schema)


def _supported(least: int):
    """The edges of a part in so many triangles at least, as lists and their supports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in itertools.groupby(rows_of(batches), lambda r: r[0]):
            src, dst, n = (np.concatenate(x) for x in zip(*(_message(r[3]) for r in rows)))
            order = np.lexsort((dst, src))
            src, dst, n = src[order], dst[order], n[order]
            new = np.flatnonzero((np.diff(src, prepend=src[0] - 1) != 0) | (np.diff(dst, prepend=dst[0] - 1) != 0))
            src, dst, n = src[new], dst[new], np.add.reduceat(n, new)
            keep = n >= least
            if keep.any():
                src, dst, n = src[keep], dst[keep], n[keep]
                yield packed_rows([(part, 0, int(src[0]), int(src[-1]), pack_lists(*np.unique(src, return_counts=True), dst) + pack(n))])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, kind, _, data in rows_of(batches):
        src, dst, _ = _message(data)
        yield packed_rows([(part, kind, int(src[0]), int(src[-1]), pack_lists(*np.unique(src, return_counts=True), dst))])


def _edges_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, data in rows_of(batches):
        src, dst, n = _message(data)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(src, dst), np.maximum(src, dst), n)], names=["src", "dst", "support"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, _, data in rows_of(batches):
        src, _, n = _message(data)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, int(src[0]), int(src[-1]), len(src))], names=["part", "lo", "hi", "edges"])


def relisted(edges: DataFrame, least: int, least_degree: int = 0, max_iter: int | None = None) -> DataFrame:
    """``src, dst, support`` of canonical edges, of which those in fewer triangles than ``least`` go, round by round; each
    round lists the triangles of the edges left anew. ``least_degree``: as in ``oriented_parts``."""
    schema = "src bigint, dst bigint, support bigint"
    kept = Generations(edges.sparkSession, keep=3)
    own, bounds = oriented_parts(edges, listing.PART_EDGES, least_degree, kept)
    before, rounds = -1, 0
    while bounds:
        n = max(b[0] for b in bounds) + 1
        floor = least if max_iter is None or rounds < max_iter else 1
        rows = kept.write(by_part(with_answers(own, bounds, kept).mapInArrow(_told(bounds, False), PACKED), n).mapInArrow(_supported(floor), PACKED))
        sizes = sorted((tuple(r) for r in rows.mapInArrow(_sizes, "part long, lo long, hi long, edges long").collect()), key=lambda r: r[1])  # a row for each part
        after = sum(r[3] for r in sizes)
        if after == before or floor < least:
            return rows.mapInArrow(_edges_left, schema)
        bounds, before, rounds = [r[:3] for r in sizes], after, rounds + 1
        own = rows.mapInArrow(_lists, PACKED)
    return edges.sparkSession.createDataFrame([], schema)
