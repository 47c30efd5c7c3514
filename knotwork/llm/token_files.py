"""Token ids as Arrow stream files of fixed-size lists, for zero-copy random access to equal-length sequences."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, n_parts, new_path, texts, written
from .encoding import encoder

#: Ids of a sequence, sequences of an Arrow batch, and bytes of text of a file at most, as far as documents can be dealt.
LENGTH, ROWS, FILE_BYTES = 2048, 256, 256 << 20
MANIFEST = "part int, file string, first bigint, n_docs bigint, n_tokens bigint"


def schemas(kind: np.dtype, length: int) -> tuple[pa.Schema, pa.Schema]:
    """Of the ids' file and of the file beside it, which says where each document starts."""
    ids = pa.list_(pa.from_numpy_dtype(kind), length)
    return pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))]), pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """Writes the ids of one document after another; sequences are cut at every ``length`` ids, the last is padded."""

    def __init__(self, fs, path: str, kind: np.dtype, length: int):
        self.schema, self.index_schema = schemas(kind, length)
        self.kind, self.length, self.need = kind, length, length * ROWS
        self.out, self.index_out = fs.open_output_stream(path), fs.open_output_stream(path + ".index")
        self.file, self.index = pa.ipc.new_stream(self.out, self.schema), pa.ipc.new_stream(self.index_out, self.index_schema)
        self.waiting, self.n_waiting, self.n, self.docs = [], 0, 0, []
        self.offsets, self.path, self.fs = [], path, fs
        self.n_docs = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n, len(ids)))
        self.n += len(ids)
        self.n_docs += 1
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.need:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.need * self.need
            for at in range(0, whole, self.need):
                self._batch(flat[at : at + self.need], self.need)
            self.waiting, self.n_waiting = [flat[whole:]], len(flat) - whole
        if len(self.docs) >= 10_000:
            self._index()

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in ((flat, self.schema.field(0).type), (mask, self.schema.field(1).type))]
        self.offsets.append(self.out.tell())
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def _index(self) -> None:
        if self.docs:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs)], schema=self.index_schema))
            self.docs = []

    def close(self) -> None:
        if self.n_waiting:
            flat = np.concatenate(self.waiting).astype(self.kind, copy=False)
            self._batch(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self._index()
        for x in (self.file, self.index, self.out, self.index_out):
            x.close()
        with self.fs.open_output_stream(self.path + ".offsets") as f:
            f.write(np.array(self.offsets, "<i8").tobytes())


def _write(tokenizer_path: str, to: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, w = TaskContext.get().partitionId(), encoder(tokenizer_path), None
        fs, folder = file_system(to)
        name = f"{part:06d}-{uuid.uuid4().hex}.arrows"  # each attempt has a file of its own; the manifest names the right one
        end = np.array([end_id], enc.type)
        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                if w is None:
                    fs.create_dir(folder, recursive=True)
                    w, first = Writer(fs, f"{folder}/{name}", enc.type, length), doc
                w.add(doc, np.concatenate([ids, end]))
        if w is not None:
            w.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{to}/{name}"]), pa.array([first], pa.int64()), pa.array([w.n_docs]), pa.array([w.n])], names=["part", "file", "first", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, to: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Writes the ids of all ``docs`` (doc_id, text) in ascending doc_id order, null doc_ids first; returns the manifest.

    One set of files per range of doc_ids: the sequences, an index of documents, and where in the file each batch begins,
    for random access. The manifest (part, file, first, n_docs, n_tokens), written as a table,
    names the files of the attempts that succeeded, so lost executors leave at most files that nobody names. Null or
    empty text: the end id alone. Rows of equal doc_id stay next to each other. No rows: no files.
    """
    spark = docs.sparkSession
    ordered = texts(docs).repartitionByRange(n_parts(docs, FILE_BYTES), "doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(_write(tokenizer_path, to, end_id, length), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
            fs, at = file_system(path)
            with fs.open_input_stream(at) as f, fs.open_input_stream(at + ".index") as g:
                ids, held, from_ = pa.ipc.open_stream(f), np.zeros(0, np.uint8), 0
                for index in pa.ipc.open_stream(g):
                    out = []
                    for doc, start, n in zip(*(c.to_pylist() for c in index.columns)):
                        parts = [held[start - from_ :][:n]]
                        got = len(parts[0])
                        while got < n:  # reads on until the document is whole
                            from_ += len(held)
                            batch = ids.read_next_batch()
                            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                            held = flat[batch.column(1).flatten().to_numpy(zero_copy_only=False)]
                            parts.append(held[: n - got])
                            got += len(parts[-1])
                        out.append((doc, base + start, n, zlib.crc32(np.concatenate([p.astype("<u4") for p in parts]).tobytes())))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files that ``manifest`` names.

    ``start`` counts the ids of all documents before it, over all files: one row per file is summed on one task.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "file").mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def sequences(path: str) -> pa.Table:
    """The sequences and masks of one local file, memory-mapped: row k is sequence k."""
    with pa.memory_map(path) as f:
        return pa.ipc.open_stream(f).read_all()


def sequence(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``k`` of a file in any store, from its batch alone: one read of the file's offsets, one
    of its schema, and one of the batch, whose buffers the arrays share."""
    fs, at = file_system(path)
    with fs.open_input_file(at + ".offsets") as f:
        f.seek(k // ROWS * 8)
        begin = int(np.frombuffer(f.read(8), "<i8")[0])
    with fs.open_input_file(at) as f:
        schema = pa.ipc.read_schema(f)
        f.seek(begin)
        message = pa.ipc.read_message(f)
        if message.type == "schema":  # it is written along with the first batch
            message = pa.ipc.read_message(f)
        batch = pa.ipc.read_record_batch(message, schema)
    ids, mask = (batch.column(c)[k % ROWS].values for c in (0, 1))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Writes token files into the shared folder and gives what ``read_token_files`` reads; nulls, repeated rows and
    empty tables as in ``write_token_files``."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, tokenizer_path, new_path(spark, "token-files"), end_id, length))
