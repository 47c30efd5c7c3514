"""The index of stars, by parts: a vertex's later neighbours and the triangles that it comes first in lie in its part."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.supersteps import PACKED, packed_rows, rows_of
from . import listing
from .graph import degrees
from .listing import Part, oriented_parts, pack, spread, unpack, unpack_lists, with_answers

#: Entries of the lists of a batch of rows.
BATCH_ENTRIES = 200_000
SCHEMA = "id bigint, label string, degree bigint, tc bigint, size int, max_degree bigint, vertices array<bigint>, labels array<string>, degrees array<bigint>, vertex_tc array<bigint>, edges array<struct<a:bigint,b:bigint>>"


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vertices of each part's edges."""
    for part, _, _, data in rows_of(batches):
        ids, _, flat = unpack_lists(data)
        need = np.unique(np.concatenate([ids, flat]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(need), part, np.int32)), pa.array(need)], names=["part", "id"])


def _about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each part the ids, degrees and labels that it needs, packed."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    all_ = pa.Table.from_batches(found)
    parts = all_.column("part").to_numpy()
    for part in np.unique(parts):
        some = all_.filter(pa.array(parts == part)).sort_by([("id", "ascending"), ("label", "ascending")])
        labels = some.column("label").combine_chunks().dictionary_encode()
        labels = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
        names = [x.encode() for x in labels.dictionary.to_pylist()]
        data = pack(some.column("id").to_numpy(), some.column("degree").to_numpy(), labels.indices.to_numpy(), np.array([len(x) for x in names]), np.frombuffer(b"".join(names), np.uint8))
        yield packed_rows([(int(part), 2, 0, 0, data)])


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _rows(own: tuple, found: list[tuple], data: bytes) -> Iterator[pa.RecordBatch]:
    ids, sizes, flat = own
    known, degree, code, width, text = unpack(data)
    text = text.astype(np.uint8).tobytes()
    names = pa.array([text[i : i + n].decode() for i, n in zip(_firsts(width), width)], pa.string())
    uv, uw = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else [()] * 2))
    source = np.repeat(np.arange(len(ids)), sizes)
    through = np.bincount(uv, minlength=len(flat)) + np.bincount(uw, minlength=len(flat))
    tc = np.bincount(source[uv], minlength=len(ids))
    a, b = np.minimum(flat[uv], flat[uw]), np.maximum(flat[uv], flat[uw])
    order = np.lexsort((b, a, source[uv]))
    a, b, closing = a[order], b[order], _firsts(tc)
    # a neighbour of several labels is an entry for each, a vertex of several labels a row for each
    first = np.searchsorted(known, flat)
    times = np.searchsorted(known, flat, "right") - first
    entry, of, through = spread(first, times), np.repeat(source, times), np.repeat(through, times)
    order = np.lexsort((entry, degree[entry], of))
    entry, through = entry[order], through[order]
    size = np.bincount(of, minlength=len(ids))
    start = _firsts(size)
    first = np.searchsorted(known, ids)
    times = np.searchsorted(known, ids, "right") - first
    row, at = np.repeat(np.arange(len(ids)), times), spread(first, times)
    total = np.cumsum(size[row] + 1 + tc[row])
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BATCH_ENTRIES, "right")))
        u, v = row[i:j], at[i:j]
        n = size[u]
        mine = spread(start[u], n)
        heads = _firsts(n + 1)
        rest = np.ones(int((n + 1).sum()), bool)
        rest[heads] = False

        def lists(head: np.ndarray, more: np.ndarray) -> np.ndarray:
            out = np.empty(len(rest), np.int64)  # noqa: B023
            out[heads], out[rest] = head, more  # noqa: B023
            return out

        pairs = spread(closing[u], tc[u])
        columns = {
            "id": pa.array(ids[u]),
            "label": names.take(pa.array(code[v])),
            "degree": pa.array(degree[v]),
            "tc": pa.array(tc[u]),
            "size": pa.array(n, pa.int32()),
            "max_degree": pa.array(degree[entry[start[u] + n - 1]]),
            "vertices": _lists(n + 1, pa.array(lists(ids[u], known[entry[mine]]))),
            "labels": _lists(n + 1, names.take(pa.array(lists(code[v], code[entry[mine]])))),
            "degrees": _lists(n + 1, pa.array(lists(degree[v], degree[entry[mine]]))),
            "vertex_tc": _lists(n + 1, pa.array(lists(tc[u], through[mine]))),
            "edges": _lists(tc[u], pa.StructArray.from_arrays([pa.array(a[pairs]), pa.array(b[pairs])], names=["a", "b"])),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        i = j


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in itertools.groupby(rows_of(batches), lambda r: r[0]):
        part, own, found = None, None, []
        for _, kind, _, data in rows:
            if kind == 2:
                yield from _rows(own, found, data)
                break
            lists = unpack_lists(data)
            if kind == 0:
                part, own = Part(*lists), lists
            found.extend((uv, uw) for uv, uw, _ in part.places(*lists))


def stars(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``patterns.star_index``. Parts get the degrees and labels of their vertices; triangles are no rows."""
    own, bounds = oriented_parts(edges, listing.PART_EDGES)
    if not bounds:
        return edges.sparkSession.createDataFrame([], SCHEMA)
    n = len(bounds)
    known = degrees(edges).join(labels.select("id", "label"), "id", "left").select("id", "degree", F.coalesce("label", F.lit("_")).alias("label"))
    about = own.mapInArrow(_needed, "part int, id bigint").join(known, "id").select("part", "id", "degree", "label")
    return with_answers(own, bounds, more=about.repartition(n, "part").mapInArrow(_about, PACKED)).mapInArrow(_stars, SCHEMA)
