"""Token counts: pieces counted once per distinct pre-token, joined to per-document frequencies, and summed."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, new_path, texts, written
from .encoding import encoder, segments

#: Text of one chunk, whose documents share one list of pre-tokens.
CHUNK_BYTES = 24 << 20
CHUNK = "chunk bigint, units array<string>"
#: Splits a segment as the byte-level pre-tokenizer does. Used only below U+0250, where every Unicode version agrees.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
EXOTIC = re.compile("[^\x00-ɏ]")


def pre_tokens(segment: str, specials: tuple[str, ...], exact) -> list[str]:
    """The pre-tokens of a segment; a segment with a special string in it stays whole."""
    if segment[1:].isalpha() and (segment[0] == " " or segment[0].isalpha()):
        return [segment]
    if any(s in segment for s in specials):
        return [segment]
    if EXOTIC.search(segment):
        return [segment[a:b] for _, (a, b) in exact(segment)]
    return PIECES.findall(segment)


def _chunks(path: str, to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        specials = tuple(t.content for t in library.get_added_tokens_decoder().values())
        exact = library.pre_tokenizer.pre_tokenize_str

        def chunk(ids: list, sizes: list, docs: list[str]) -> pa.RecordBatch:
            number: dict[str, int] = {}
            per_doc = []
            for t in docs:
                cut = segments(t)
                for s in cut:
                    if s not in number:
                        number[s] = len(number)
                per_doc.append(np.fromiter(map(number.__getitem__, cut), np.int32, len(cut)))
            cut = [pre_tokens(s, specials, exact) if s else [] for s in number]
            del number
            units = ["", *sorted(set(chain.from_iterable(cut)))]  # neighbours in order compress well; the first makes no list empty
            at = {u: i for i, u in enumerate(units)}
            flat = np.fromiter((at[p] for c in cut for p in c), np.int32)
            end = np.cumsum([len(c) for c in cut], dtype=np.int64)
            begin = end - np.array([len(c) for c in cut], np.int64)
            starts, unit, freq = [0], [], []
            for d in per_doc:
                n = end[d] - begin[d]
                where = np.repeat(begin[d] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                u, f = np.unique(flat[where], return_counts=True)
                unit.append(np.diff(u, prepend=np.int32(0)))
                freq.append(f.astype(np.int32))
                starts.append(starts[-1] + len(u))
            key = uuid.uuid4().int >> 65
            table = pa.table({"unit": np.concatenate(unit), "freq": np.concatenate(freq)})
            about = pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_units": np.diff(starts)})
            fs, base = file_system(f"{to}/{key}")
            fs.create_dir(base.rpartition("/")[0], recursive=True)
            for name, t in (("units", table), ("docs", about)):
                pq.write_table(t, f"{base}.{name}", filesystem=fs, compression="zstd", use_dictionary=False, column_encoding=dict.fromkeys(t.column_names, "DELTA_BINARY_PACKED"))
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([units], pa.list_(pa.string()))], names=["chunk", "units"])

        ids, sizes, docs, total = [], [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(i)
                sizes.append(len(t.encode()))
                docs.append(t)
                total += sizes[-1]
                if total >= CHUNK_BYTES:
                    yield chunk(ids, sizes, docs)
                    ids, sizes, docs, total = [], [], [], 0
        if docs:
            yield chunk(ids, sizes, docs)

    return run


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        for b in batches:
            for i in range(0, b.num_rows, 20_000):
                some = b.slice(i, 20_000)
                n = [len(e.ids) for e in library.encode_batch_fast(some.column("pre_token").to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([some.column("pre_token"), pa.array(n, pa.int32())], names=["pre_token", "pieces"])

    return run


def _sum(to: str):
    def run(found: pa.Table) -> pa.Table:
        """The counts of one chunk's documents, from its pre-tokens' pieces and its file of frequencies."""
        pieces = np.zeros(len(found), np.int64)
        pieces[found.column("pos").to_numpy()] = found.column("pieces").to_numpy()
        fs, at = file_system(f"{to}/{found.column('chunk')[0].as_py()}")
        docs, units = (pq.read_table(f"{at}.{name}", filesystem=fs) for name in ("docs", "units"))
        ends = np.cumsum(docs.column("n_units").to_numpy())
        step = units.column("unit").to_numpy().astype(np.int64)
        unit = np.cumsum(step)
        if len(ends) > 1:  # the steps begin anew in each document
            before = np.concatenate([[0], unit])[np.concatenate([[0], ends[:-1]])]
            unit = unit - np.repeat(before, np.diff(ends, prepend=0))
        run = np.concatenate([[0], np.cumsum(pieces[unit] * units.column("freq").to_numpy())])
        return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(np.diff(run[ends], prepend=0), pa.int64())})

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, over: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs`` (doc_id, text), for a byte-level BPE file.

    The documents of a chunk (``CHUNK_BYTES`` of text) share one list of distinct pre-tokens; their frequencies stay
    in a file of the chunk in the shared folder, named anew by each attempt. Only the lists are shuffled, once: each
    distinct pre-token of the corpus is given to the library once, and its number of pieces is joined back to the
    chunks. No ids are kept.

    Null or empty text: 0 bytes, 0 tokens, not over the limit. Null doc_ids and repeated rows are kept, one row out
    for each row in. No rows: no rows. Other columns of ``docs`` are ignored.
    """
    to = new_path(docs.sparkSession, "token-frequencies")
    chunks = written(texts(docs).mapInArrow(_chunks(tokenizer_path, to), CHUNK), "token-chunks")
    units = chunks.select("chunk", F.posexplode("units").alias("pos", "pre_token")).filter("pre_token is not null").repartition("pre_token")
    # all columns are asked for, and the join's own filter is there already: both its sides read one shuffle
    distinct = units.groupBy("pre_token").agg(F.min("chunk").alias("chunk"), F.min("pos").alias("pos"))
    pieces = distinct.mapInArrow(_count(tokenizer_path), "pre_token string, pieces int")
    found = units.join(pieces, "pre_token").select("chunk", "pos", "pieces")
    counts = found.groupBy("chunk").applyInArrow(_sum(to), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counts.withColumn("over_limit", F.col("n_tokens") > over)
