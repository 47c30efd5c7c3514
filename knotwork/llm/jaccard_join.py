"""N-gram Jaccard join by parity sketches.

XOR-ing the hashes of a set's shingles into a sketch gives a parity for each cell: two sketches differ in no more
cells than the sets' symmetric difference has shingles. Sets of a and b shingles whose similarity is at least 3/4
differ in at most (a + b) / 7 shingles, which is at most a third of either set. So among the first third plus one of
the cells that are in use, in one order for both, two such sets share an equal cell (pigeonhole). The order puts
cells of frequent shingles last. Sets meet at equal cells per size band; what meets is filtered by the Hamming distance
of smaller bit sketches and then verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts
from .components import components
from .memory import tidy
from .shingles import MASK, mix, other_signature, shingle_sets, signature

#: Counters of the table that tells frequent shingles, and how far above the mean, in standard deviations, they are.
WIDTH, BLOCKS, SIGMAS = 1 << 20, 16, 6.0
#: Cells of the smallest bands, keys that a reducer takes, and bytes of sets that are verified beside one copy of a leader.
LEAST_CELLS, BUCKET_KEYS, SALT_BYTES = 1024, 1 << 20, 16 << 20
#: Keys of a part of a task's input, sets of one key in it that go by their first one to the reducer, and least and
#: greatest number of sets in a block; between them a group has eight blocks.
FLUSH, LOCAL, BLOCK_SETS = 1 << 21, 32, (128, 2048)
C1, C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def band(n: int) -> int:
    """Bands of sizes from 4**k to 4**(k + 1)."""
    return (n.bit_length() - 1) // 2


def similar(both: int, a: int, b: int) -> bool:
    return 100 * both >= 75 * (a + b - both)


def bit_sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles by hash, at two bits or more for each shingle of the band's largest sets."""
    bits = max(64, 2 << (2 * (band(len(s)) + 1)))
    cell = (s >> np.uint64(7)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(cell, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sketch: np.ndarray, n_bytes: int) -> np.ndarray:
    """Rows of sketches, XOR-ed down to fewer bits."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, n_bytes), axis=1)


def cells(s: np.ndarray, frequent: np.ndarray, level: int) -> np.ndarray:
    """Keys of the first third plus one of the used cells of a set on a band's level, frequent shingles' cells last."""
    p = max(LEAST_CELLS, 4 << (2 * level))
    slot = (s & np.uint64(WIDTH - 1)).astype(np.int64)
    hot = (frequent[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
    cell = ((s >> np.uint64(20)) % np.uint64(p)).astype(np.int64) + hot.astype(np.int64) * p
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[: len(s) // 3 + 1]
    ends = np.append(at, len(s))[1:]
    if len(at) == len(s) // 3 + 1:  # reduceat would run on to the end
        later = np.flatnonzero(cell[at[-1] :] != cell[at[-1]])
        ends[-1] = at[-1] + later[0] if len(later) else len(s)
    parity = np.bitwise_xor.reduceat(s[order[: ends[-1]]], at)
    return mix(parity ^ mix(cell[at].astype(np.uint64) * C1 + np.uint64(level * int(C2) & MASK)))


def levels(n: int) -> list[int]:
    """The band of a set, and the band below if a partner may lie there."""
    k = band(n)
    return [k, k - 1] if k and 3 * n <= 4 * (1 << (2 * k)) else [k]


def _sets(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        yield from zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text").to_pylist()))


@tidy
def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and after them a task's counts of shingles by slot, in blocks."""
    names = ["doc_id", "n", "sig", "other", "sketch", "block", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    counts = np.zeros(WIDTH, np.int64)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    rows, slots, held = [], [], 0
    for doc, s in _sets(batches):
        rows.append((doc, len(s), signature(s), other_signature(s), bit_sketch(s) if len(s) else b"", None, None))
        slots.append((s & np.uint64(WIDTH - 1)).astype(np.int64))
        held += len(s)
        if len(rows) >= 2000 or held > FLUSH:
            counts += np.bincount(np.concatenate(slots), minlength=WIDTH)
            yield batch(rows)
            rows, slots, held = [], [], 0
    if slots:
        counts += np.bincount(np.concatenate(slots), minlength=WIDTH)
        yield batch(rows)
    for k, c in enumerate(np.split(counts, BLOCKS)):
        if c.any():
            yield batch([(None, None, None, None, None, k, np.minimum(c, np.iinfo(np.uint32).max).astype(np.uint32).tobytes())])


def _frequent(t: pa.Table) -> pa.Table:
    total = np.zeros(WIDTH // BLOCKS, np.int64)
    for c in t.column("counts").to_pylist():
        total += np.frombuffer(c, np.uint32)
    # the mean without the frequent ones themselves, and never less than a few copies
    mean = float(np.median(total))
    bits = np.packbits(total > max(8.0, mean + SIGMAS * mean**0.5), bitorder="little").tobytes()
    return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})


def _keys(frequent: Broadcast, n_buckets: int, clashes: frozenset[int]):
    """Rows of keys with their sets, by bucket. Of a key that more than ``LOCAL`` sets of a flush have, the reducer gets
    the first set alone; the list of all goes past it, in a row of a bucket below 0, and is joined to what the reducer
    finds. So no reducer takes more than a few sets of a key from one flush, however frequent the key."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(frequent.value, np.uint8)

        def flush() -> pa.RecordBatch:
            k, s = np.concatenate(keys), np.repeat(np.array(sigs, np.int64), [len(x) for x in keys])
            bucket = (k % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # a set's keys stay together, which compresses well
            bucket, short, s = bucket[order], (k >> np.uint64(32)).astype(np.uint32)[order], s[order]
            keep, hot, rows = np.ones(len(s), bool), np.zeros(len(s), bool), []
            slot = (short ^ bucket.astype(np.uint32)) & np.uint32(WIDTH - 1)
            some = np.flatnonzero((np.bincount(slot, minlength=WIDTH) > LOCAL)[slot])  # the keys of more sets are among these
            some = some[np.lexsort((s[some], short[some], bucket[some]))]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(bucket[some]) != 0) | (np.diff(short[some]) != 0)])) if len(some) else some
            for i, j in zip(new.tolist(), [*new[1:].tolist(), len(some)]):
                if j - i > LOCAL:
                    lead = some[i]
                    keep[some[i + 1 : j]], hot[lead] = False, True
                    rows.append((-1 - int(s[lead]) % n_buckets, None, None, None, packed(bucket[lead], short[lead]), np.unique(s[some[i:j]])))
            bucket, short, s, hot = bucket[keep], short[keep], s[keep], hot[keep]
            at = np.searchsorted(bucket, np.arange(n_buckets + 1))
            rows += [(b, short[i:j].tobytes(), s[i:j].tobytes(), np.flatnonzero(hot[i:j]).astype(np.int32).tobytes(), None, None) for b, i, j in zip(range(n_buckets), at, at[1:]) if i < j]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "keys", "sigs", "hot", "key", "members"])

        keys, sigs, held, seen = [], [], 0, set()
        for _, s in _sets(batches):
            if not len(s) or (sig := signature(s, clashes)) in seen:
                continue
            seen.add(sig)
            for level in levels(len(s)):
                keys.append(cells(s, table, level))
                sigs.append(sig)
                held += len(keys[-1])
            if held >= FLUSH:
                yield flush()
                keys, sigs, held, seen = [], [], 0, set()
        if keys:
            yield flush()

    return run


KEYS = "bucket int, keys binary, sigs binary, hot binary, key bigint, members array<bigint>"
#: Pairs (a: the first set that has a key, b: another); ``key`` where b stands for a list; rows with ``members`` are lists.
GROUPS = "a bigint, b bigint, key bigint, members array<bigint>"
#: The same with the pairs without a key packed, by ``part``; and keys of the input for each part.
PACKED_GROUPS, PART_KEYS = f"{GROUPS}, part int, pairs binary", 16 << 20


def packed(bucket, short) -> int:
    return int(bucket) << 32 | int(short)


def _groups(t: pa.Table) -> pa.Table:
    """The distinct pairs of a key's first set and each other one, from the keys of one bucket; lists as they are."""
    bucket = t.column("bucket")[0].as_py()
    if bucket < 0:
        lists = t.column("members").combine_chunks()
        none = pa.nulls(len(t), pa.int64())
        return pa.table([pa.array([m[0] for m in lists.to_pylist()], pa.int64()), none, t.column("key"), lists], names=["a", "b", "key", "members"])
    parts = [tuple(np.frombuffer(x, d) for x, d in zip(r, (np.uint32, np.int64, np.int32))) for r in zip(*(t.column(c).to_pylist() for c in ("keys", "sigs", "hot")))]
    k, s = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    hot = np.zeros(len(k), bool)
    hot[np.concatenate([x[2].astype(np.int64) + at for x, at in zip(parts, np.cumsum([0, *(len(x[0]) for x in parts)]))])] = True
    order = np.lexsort((s, k))
    k, s, hot = k[order], s[order], hot[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(start, len(k)))
    first = np.repeat(s[start], size)
    mark = hot  # a list's first set keeps its key, as the list is joined by both
    plain = ~mark & (first != s)
    pairs = np.unique(np.stack([first[plain], s[plain]], 1), axis=0) if plain.any() else np.zeros((0, 2), np.int64)
    a, b = np.concatenate([pairs[:, 0], first[mark]]), np.concatenate([pairs[:, 1], s[mark]])
    key = pa.array([None] * len(pairs) + [packed(bucket, x) for x in k[mark].tolist()], pa.int64())
    return pa.table([pa.array(a), pa.array(b), key, pa.nulls(len(a), pa.list_(pa.int64()))], names=["a", "b", "key", "members"])


def _packed_groups(n_parts: int):
    """``_groups`` with its plain pairs packed. Near copies share many keys and so are a pair of many buckets; packed, that
    is no row each time."""

    def run(t: pa.Table) -> pa.Table:
        g = _groups(t)
        plain = pa.compute.and_(g.column("key").is_null(), g.column("members").is_null())
        rest, some = g.filter(pa.compute.invert(plain)), g.filter(plain)
        a, b = some.column("a").to_numpy(), some.column("b").to_numpy()
        # by both sets, so that a set with many others is no part by itself
        part = (mix(mix(a.astype(np.uint64)) ^ b.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        pairs, at = np.stack([a, b], 1)[order], np.searchsorted(part[order], np.arange(n_parts + 1))
        packs = [(p, pairs[i:j].tobytes()) for p, i, j in zip(range(n_parts), at, at[1:]) if i < j]
        none = len(packs)
        columns = [pa.chunked_array([pa.nulls(none, c.type), *c.chunks]) for c in rest.columns]
        columns += [pa.array([x[i] for x in packs] + [None] * len(rest), t) for i, t in enumerate((pa.int32(), pa.binary()))]
        return pa.table(columns, names=[*rest.column_names, "part", "pairs"])

    return run


def _pairs(t: pa.Table) -> pa.Table:
    """The distinct pairs of a part."""
    pairs = np.unique(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in t.column("pairs").to_pylist()]), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


@tidy
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and sketches allow a link."""
    for b in batches:
        keep = np.zeros(b.num_rows, bool)
        for i, (n, m, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")))):
            if 3 * max(n, m) <= 4 * min(n, m):
                x, y = np.frombuffer(x, np.uint8)[None], np.frombuffer(y, np.uint8)[None]
                w = min(x.shape[1], y.shape[1])
                keep[i] = 7 * int(np.bitwise_count(folded(x, w) ^ folded(y, w)).sum()) <= n + m
        yield b.select(["a", "b", "nb"]).filter(pa.array(keep))


def _across(t: pa.Table) -> pa.Table:
    """Pairs between different components that may be linked, among sets that share a key with the same first set: all
    of a block, or those between two blocks. Compares a row with others at a time; emits only what sizes and sketches
    allow."""
    sig, n, root, block = (t.column(c).to_numpy() for c in ("sig", "n", "root", "block"))
    order = np.lexsort((sig, block))
    sig, n, root, block, raw = sig[order], n[order], root[order], block[order], t.column("sketch").take(pa.array(order)).to_pylist()
    width = min(map(len, raw))
    sketch = np.concatenate([folded(np.frombuffer(x, np.uint8)[None], width) for x in raw])
    second = int(np.searchsorted(block, block[-1])) if t.column("i")[0].as_py() != t.column("j")[0].as_py() else 0
    out_a, out_b = [], []
    for i in range(second or len(sig) - 1):
        at = second or i + 1
        near = (root[at:] != root[i]) & (3 * np.maximum(n[at:], n[i]) <= 4 * np.minimum(n[at:], n[i]))
        j = np.flatnonzero(near) + at
        j = j[7 * np.bitwise_count(sketch[j] ^ sketch[i]).sum(1).astype(np.int64) <= n[j] + n[i]]
        out_a.append(np.full(len(j), sig[i]))
        out_b.append(sig[j])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _wanted(bits: Broadcast, clashes: frozenset[int]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.frombuffer(bits.value, np.uint8), set()
        for b in batches:
            rows = []
            for s in shingle_sets(b.column("text").to_pylist()):
                if len(s) and (sig := signature(s, clashes)) not in seen and table[(slot := sig & (len(table) * 8 - 1)) >> 3] >> (slot & 7) & 1:
                    seen.add(sig)
                    rows.append((sig, s.tobytes()))
            if len(seen) > 1 << 20:
                seen = set()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), ()), (pa.int64(), pa.binary()))], names=["sig", "shingles"])

    return run


def _verify(t: pa.Table) -> pa.Table:
    """The links among the pairs of one leader; its own set comes with them."""
    sig, leader, sets = t.column("sig").to_pylist(), t.column("leader")[0].as_py(), t.column("shingles").to_pylist()
    mine = np.frombuffer(sets[sig.index(leader)], np.uint64)
    out = []
    for x, data in zip(sig, sets):
        s = np.frombuffer(data, np.uint64)
        if x != leader and similar(len(np.intersect1d(mine, s, assume_unique=True)), len(mine), len(s)):
            out.append(x)
    return pa.table({"a": pa.array([leader] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})


#: Least and greatest bits of the filter by which only sets that are in a candidate pair are gathered, and bits for each
#: of them; what it lets through in error goes in the join.
FILTER_LEAST, FILTER_MOST, FILTER_EACH = 1 << 16, 1 << 28, 16


def _filter_bits(sigs: DataFrame) -> bytes:
    """A bit for each signature, in a table of ``FILTER_MOST`` bits at most."""
    n = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_EACH * sigs.count()).bit_length()))
    slots = sigs.select(F.col("sig").bitwiseAND(F.lit(n - 1)).alias("slot"))
    rows = slots.groupBy(F.shiftright("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot & 31 as int))")).alias("bits")).groupBy(F.shiftright("at", 8).alias("page")).agg(F.collect_list(F.struct("at", "bits")).alias("x"))
    table = np.zeros(n // 32, np.int32)
    for r in rows.toLocalIterator():
        for at, bits in r["x"]:
            table[at] = bits
    return table.astype("<i4").tobytes()


def _links(pairs: DataFrame, ids: DataFrame, docs: DataFrame, clashes: frozenset[int]) -> DataFrame:
    """The pairs (a, b) of signatures that are linked, verified on whole sets."""
    spark, tables = docs.sparkSession, Scratch(docs.sparkSession)
    side = lambda x: ids.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"x{x}"))
    near = tables.write(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_near, "a bigint, b bigint, nb bigint"), "near")
    sigs = tables.write(near.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "candidates")
    bits = spark.sparkContext.broadcast(_filter_bits(sigs))
    sets = tables.write(docs.mapInArrow(_wanted(bits, clashes), "sig bigint, shingles binary").dropDuplicates(["sig"]), "sets")
    # a leader's set is copied once for each SALT_BYTES of the sets it is held against
    many = near.groupBy("a").agg(F.ceil(F.sum(F.col("nb") * 8) / F.lit(SALT_BYTES)).cast("int").alias("copies"))
    pair = near.join(many, "a").select(F.col("a").alias("leader"), F.col("b").alias("sig"), F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"))
    own = many.select(F.col("a").alias("leader"), F.col("a").alias("sig"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    asked = pair.unionByName(own).join(sets, "sig")
    links = tables.write(asked.groupBy("leader", "salt").applyInArrow(_verify, "a bigint, b bigint"), "verified")
    tables.delete("near", "candidates", "sets")
    return links


#: Rows of a table up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _named(docs: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """``doc_id, n, sig, root, component_id`` of each row of ``docs``, and the signatures that unequal sets share: of
    rows with shingles the signature of their set and the least one reachable by links."""
    spark, tables = docs.sparkSession, Scratch(docs.sparkSession)
    own = texts(docs)
    scanned = tables.write(own.mapInArrow(_ids, "doc_id bigint, n bigint, sig bigint, other bigint, sketch binary, block int, counts binary"), "shingle-ids")
    rows = scanned.filter("block is null")
    # sets are told apart by both signatures; that some share one is a matter of chance, so there are few
    shared = rows.filter("n > 0").groupBy("sig").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo <> hi")
    clashes = frozenset(r["sig"] for r in shared.select("sig").collect())
    if clashes:
        rows = rows.withColumn("sig", F.when(F.col("sig").isin(*clashes), F.col("other")).otherwise(F.col("sig")))
    ids = rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    ids = tables.write(ids, "sets-ids")
    frequent = np.zeros((BLOCKS, WIDTH // BLOCKS // 8), np.uint8)
    for r in scanned.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(_frequent, "block int, bits binary").collect():
        frequent[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    total = ids.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * BUCKET_KEYS)))
    keys = own.mapInArrow(_keys(spark.sparkContext.broadcast(frequent.tobytes()), n_buckets, clashes), KEYS)
    groups = tables.write(keys.groupBy("bucket").applyInArrow(_packed_groups(max(1, -(-total // PART_KEYS))), PACKED_GROUPS), "key-groups")
    pairs = groups.filter("part is not null").select("part", "pairs").groupBy("part").applyInArrow(_pairs, "a bigint, b bigint")
    pairs = pairs.unionByName(groups.filter("b is not null").select("a", "b"))
    lists = groups.filter("members is not null").select(F.col("a").alias("b"), "key", "members")
    listed = groups.filter("b is not null and key is not null").select("a", "b", "key").join(lists, ["b", "key"]).select("a", F.explode("members").alias("b"))
    stars = tables.write(pairs.unionByName(listed).filter("a <> b").distinct(), "stars")
    tables.delete("key-groups")
    first_links = _links(stars, ids, own, clashes)
    roots = tables.write(components(first_links), "roots")
    # near copies share many keys, and mostly the first member: all groups of one first member are gone through once
    rooted = tables.write(stars.select(F.col("a").alias("first"), F.col("b").alias("sig")).join(roots.withColumnRenamed("id", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")), "rooted")
    tables.delete("stars", "roots")
    open_ = tables.write(rooted.groupBy("first").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("sets")).filter("lo <> hi").select("first", F.ceil(F.col("sets") / F.greatest(F.lit(BLOCK_SETS[0]), F.least(F.lit(BLOCK_SETS[1]), F.col("sets") / 8))).cast("int").alias("blocks")), "open")
    # a large group is compared by pairs of blocks, each a task's group of its own
    block = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    across = rooted.join(_few(open_), "first").withColumn("block", block).join(ids.select("sig", "n", "sketch"), "sig")
    across = across.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("first", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sig", "n", "root", "sketch")
    found = tables.write(across.groupBy("first", "i", "j").applyInArrow(_across, "a bigint, b bigint").distinct(), "across")
    tables.delete("rooted", "open")
    links = first_links.unionByName(_links(found, ids, own, clashes)) if not found.isEmpty() else first_links
    final = tables.write(components(links), "roots")
    named = ids.select("sig", "first").join(final.withColumnRenamed("id", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("sig", "root", "component_id")
    out = rows.filter("n > 0").select("doc_id", "n", "sig").join(named, "sig").select("doc_id", "n", "sig", "root", "component_id")
    none = F.lit(None).cast("bigint")
    return out.unionByName(rows.filter("n = 0").select("doc_id", "n", none.alias("sig"), none.alias("root"), F.col("doc_id").alias("component_id"))), clashes


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs`` (doc_id, text): its distinct 5-word shingles and
    the smallest doc_id reachable by links, where two rows link if 100 x intersection >= 75 x union.

    Rows of equal sets are one set from the start. Of the sets that share a key, first only pairs with one of them are
    verified; then, among all that share a key with the same first set, the pairs between components, in blocks. So groups
    of near copies cost in proportion to their size, and no link between components is missed.

    Null or empty text, or white space alone: no shingles, linked with nothing, component_id is the own doc_id. Fewer
    than five words: one shingle of all of them. Null doc_ids: rows as others, but never a component_id, unless all of
    a component are null. Repeated rows: a row each, linked. No rows: no rows. Other columns are ignored.
    """
    return _named(docs)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _signed(clashes: frozenset[int]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets([t or "" for t in b.column("text").cast(pa.string()).to_pylist()])
            yield b.append_column("_sig", pa.array([signature(s, clashes) if len(s) else None for s in sets], pa.int64()))

    return run


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of linked rows of ``docs``, that with the smallest doc_id, of equal ones that with the
    smallest signature of its shingles; rows without doc_id come last. All columns are kept. Rows without shingles
    stay. Rows are told apart by their texts, so other texts of a doc_id that is dropped or kept don't share its fate;
    of rows equal in doc_id and shingles one stays. No rows: no rows."""
    tables = Scratch(docs.sparkSession)
    found, clashes = _named(docs)
    found = tables.write(found.filter("n > 0"), "components")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sig")).alias("best")).select("root", F.col("best.doc_id").alias("best_id"), F.col("best.sig").alias("best_sig"))
    # by row and not by component, so that a large one is no hot key
    wins = best.select("best_id", "best_sig").distinct()
    marked = found.join(wins, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("sig") == F.col("best_sig")), "left")
    marked = tables.write(marked.select("doc_id", "sig", F.col("best_sig").isNotNull().alias("stays")), "marked")
    tables.delete("components")
    own = F.col("doc_id").cast("long")
    # ids of one row are enough to tell it; rows that share an id, or have none, are told apart by signature
    again = texts(docs).groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    again = tables.write(again, "shared-ids")
    drop = tables.write(marked.filter("not stays").select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    some = not again.isEmpty()
    single = docs.join(_few(again), own.eqNullSafe(F.col("_id")), "left_anti") if some else docs
    kept = single.join(_few(drop), own.eqNullSafe(F.col("_id")), "left_anti")
    if not some:
        return kept
    shared = docs.join(_few(again), own.eqNullSafe(F.col("_id")), "left_semi")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    signed = shared.mapInArrow(_signed(clashes), f"{fields}, _sig bigint")
    stay = marked.filter("stays").select(F.col("doc_id").alias("_id"), F.col("sig").alias("_best")).distinct()
    left = signed.join(stay, own.eqNullSafe(F.col("_id")) & (F.col("_sig") == F.col("_best")), "left_semi").dropDuplicates(["doc_id", "_sig"])
    return kept.unionByName(left.drop("_sig")).unionByName(signed.filter("_sig is null").drop("_sig"))
