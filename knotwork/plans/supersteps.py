"""Loops of parts that keep packed states and send each other packed messages, until none is sent."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .fixpoint import Generations

#: ``kind`` 0 is a part's state, 1 a message to it from the part ``lo``.
PACKED = "part int, kind int, lo bigint, hi bigint, data binary"
Step = Callable[[int, bytes, list[tuple[int, bytes]]], Iterator[tuple[int, int, int, int, bytes]]]


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PACKED.split(", ")])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """``part, kind, lo, data`` of rows, one at a time."""
    for b in batches:
        for part, kind, lo, data in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("lo").to_pylist(), b.column("data")):
            yield part, kind, lo, data.as_py()


def trim() -> None:
    """Gives a worker's freed memory back to the system, where the C library can: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def by_part(rows: DataFrame, n: int) -> DataFrame:
    """Each part's rows together, its state first."""
    return rows.repartition(n, "part").sortWithinPartitions("part", "kind")


def stepped(step: Step, idle: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step(part, state, messages)`` for each part, which gives its new state and the messages it sends; ``idle``: a
    part without messages keeps its state as it is."""

    def one(part: int, state: bytes, got: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if idle and not got:
            yield packed_rows([(part, 0, 0, 0, state)])
            return
        yield from (packed_rows([r]) for r in step(part, state, got))
        trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, got = -1, None, []
        for part, kind, sender, data in rows_of(batches):
            if kind == 0:
                if state is not None:
                    yield from one(own, state, got)
                own, state, got = part, data, []
            else:
                assert part == own, "messages follow their part's state"
                got.append((sender, data))
        if state is not None:
            yield from one(own, state, got)

    return run


def supersteps(kept: Generations, rows: DataFrame, n: int, step: Step) -> DataFrame:
    """Steps of all parts, then of those that get messages, until no message is left; the states and no messages."""
    idle = False
    while True:
        rows = kept.write(by_part(rows, n).mapInArrow(stepped(step, idle), PACKED))
        idle = True
        if rows.filter("kind = 1").isEmpty():
            return rows
