"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written
from .encoding import encoder

#: Pieces of one island; islands of a shard; rounds with a migration between them; and each island's effort in a round.
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 2, 2, 4, 8
#: Islands that a task takes at least, if there are many: 13 million shards of 100 TB are not as many tasks.
ISLANDS_A_TASK = 64
#: Bins filled less than this leave their shard and are packed again with those of other shards.
WELL_FILLED, AGAIN = 0.97, 2


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                whole = np.append(ids.astype("<u4"), np.uint32(end_id))
                for k, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Bins:
    """Items put into bins of one capacity by best fit: the open bin with the least room that suffices."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room = capacity, [], []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r: there is a bin with room r

    def new(self, items: list[int], used: int) -> None:
        self.items.append(items)
        self.room.append(self.capacity - used)
        self._open(len(self.items) - 1)

    def _open(self, b: int) -> None:
        r = self.room[b]
        if r:
            self.by_room.setdefault(r, []).append(b)
            self.rooms |= 1 << r

    def put(self, item: int, length: int) -> None:
        fits = self.rooms >> length
        if not fits:
            self.new([item], length)
            return
        r = length + (fits & -fits).bit_length() - 1
        some = self.by_room[r]
        b = some.pop()
        if not some:
            self.rooms &= ~(1 << r)
        self.items[b].append(item)
        self.room[b] = r - length
        self._open(b)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then bins either full or nearly empty."""
        return -len(self.items), sum((1 - r / self.capacity) ** 2 for r in self.room)


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> Bins:
    out = Bins(capacity)
    for i in order.tolist():
        out.put(i, int(lengths[i]))
    return out


def crossover(into: Bins, giver: Bins, lengths: np.ndarray, rng: np.random.Generator) -> Bins:
    """Injects some of the giver's best filled bins whole, drops the bins that hold the same items, and puts the
    displaced items back by best fit, longest first."""
    full = sorted(range(len(giver.items)), key=giver.room.__getitem__)[: max(1, len(giver.items) // 2)]
    taken = rng.choice(full, size=max(1, len(full) // 3), replace=False).tolist()
    inside = {i for b in taken for i in giver.items[b]}
    out, displaced = Bins(into.capacity), []
    for items, room in zip(into.items, into.room):
        if inside.isdisjoint(items):
            out.new(list(items), into.capacity - room)
        else:
            displaced += [i for i in items if i not in inside]
    for b in taken:
        out.new(list(giver.items[b]), giver.capacity - giver.room[b])
    # also opens the worst bins, so that their items can fill others
    worst = set(sorted(range(len(out.items)), key=lambda b: -out.room[b])[:2])
    kept, out2 = [b for b in range(len(out.items)) if b not in worst], Bins(into.capacity)
    for b in kept:
        out2.new(out.items[b], out.capacity - out.room[b])
    displaced += [i for b in worst for i in out.items[b]]
    for i in sorted(displaced, key=lambda i: -lengths[i]):
        out2.put(i, int(lengths[i]))
    return out2


def evolve(lengths: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray]) -> np.ndarray:
    """The bin of each item in the best packing found. Ends at once when no packing can use fewer bins."""
    least = -(-int(lengths.sum()) // capacity)
    for e in elites:
        if int(e.max(initial=-1)) + 1 <= least:
            return e.astype(np.int32)
    rng = np.random.default_rng(seed)
    people: list[Bins] = []
    for e in elites:
        b = Bins(capacity)
        for k in np.split(order := np.argsort(e, kind="stable"), np.flatnonzero(np.diff(e[order])) + 1) if len(e) else []:
            b.new(k.tolist(), int(lengths[k].sum()))
        people.append(b)
    if not people:
        people.append(best_fit(lengths, np.argsort(-lengths, kind="stable"), capacity))
    while max(people, key=Bins.fitness).fitness()[0] < -least and len(people) < POPULATION:
        people.append(best_fit(lengths, np.argsort(-lengths * rng.uniform(0.9, 1.1, len(lengths)), kind="stable"), capacity))
    for _ in range(GENERATIONS):
        people.sort(key=Bins.fitness, reverse=True)
        if len(people[0].items) <= least or len(people) < 2:
            break
        child = crossover(people[0], people[1 + int(rng.integers(len(people) - 1))], lengths, rng)
        people[-1] = child
    best, out = max(people, key=Bins.fitness), np.zeros(len(lengths), np.int32)
    for b, items in enumerate(best.items):
        out[items] = b
    return out


def _island(capacity: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                lengths = np.asarray(r.length, np.int64)
                bins = evolve(lengths, capacity, int(r.shard) * 1009 + int(r.island) * 31 + epoch, [np.asarray(e, np.int64) for e in r.elites])
                full = np.bincount(bins, weights=lengths, minlength=1) / capacity
                out.append((r.shard, r.island, r.uid, r.length, bins, int(bins.max()) + 1, float((full**2).sum())))
            yield pd.DataFrame(out, columns=["shard", "island", "uid", "length", "bins", "n_bins", "fill"])

    return run


_STATE = "shard bigint, island int, uid array<bigint>, length array<bigint>, bins array<int>, n_bins int, fill double"


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """``uid, length, shard, bin`` for ``items`` (uid, length): each shard evolves on several islands, whose elites
    go round between the rounds; the best island's packing counts."""
    n = max(1, -(-items.count() // SHARD))
    shards = items.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(n))).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x"))
    state = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("x.uid").alias("uid"), F.col("x.length").alias("length"), F.array().cast("array<array<int>>").alias("elites"))
    tasks = min(n * ISLANDS, max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * ISLANDS // ISLANDS_A_TASK)))
    for epoch in range(EPOCHS):
        state = written(state.repartition(tasks, "shard", "island").mapInPandas(_island(capacity, epoch), _STATE), f"islands-{epoch}")
        if epoch < EPOCHS - 1:
            migrant = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("bins").alias("migrant"))
            state = state.join(migrant, ["shard", "island"]).select("shard", "island", "uid", "length", F.array("bins", "migrant").alias("elites"))
    best = state.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy("n_bins", F.desc("fill"), "island"))).filter("rank = 1")
    return best.select("shard", F.explode(F.arrays_zip("uid", "length", "bins")).alias("x")).select("shard", "x.uid", "x.length", F.col("x.bins").alias("bin"))


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds ``sequence_id, offset`` to ``pieces``, which has a ``length`` of 1 to ``capacity``; every row is placed.

    Shards of ``SHARD`` pieces are packed apart; the pieces of bins that stay under ``WELL_FILLED`` are dealt anew,
    with those of other shards, up to ``AGAIN`` times. The number of sequences is at least the sum of lengths over
    capacity, and above it by about a bin a shard at most. No rows: no rows.
    """
    own = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    left, kept = own.select("uid", "length"), None
    for again in range(AGAIN + 1):
        packed = written(_packed(left, capacity).withColumn("fill", F.sum("length").over(Window.partitionBy("shard", "bin"))), f"packed-{again}")
        good = F.lit(True) if again == AGAIN else F.col("fill") >= WELL_FILLED * capacity
        now = packed.filter(good).select("uid", "length", (F.lit(again).cast("long") * (1 << 56) + F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id"))
        kept = now if kept is None else kept.unionByName(now)
        left = packed.filter(~good).select("uid", "length")
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("length")
    return own.join(placed, "uid").drop("uid")


def packed_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for the pieces of all ``docs`` (doc_id, text).

    A document is its ids and ``end_id``; only those longer than ``capacity`` are cut. Null or empty text: the one
    piece that holds the end id. Null doc_ids and repeated rows: packed as rows of their own. No rows: no rows.
    Other columns are ignored.
    """
    pieces = texts(docs).mapInArrow(_pieces(tokenizer_path, end_id, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
