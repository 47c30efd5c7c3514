"""WARC archives with Zstandard dictionaries: each record is a frame of its own, the dictionary a leading skippable
frame, and equal payloads are written once."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, new_path, small_batches, written
from .memory import tidy

#: The skippable frame of a dictionary, and the profile of revisits.
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of the first records that a dictionary is built from, of the dictionary, and the level of compression.
SAMPLE, DICTIONARY, LEVEL = 1 << 20, 32 << 10, 3
#: About so many payload bytes go into one archive.
ARCHIVE_BYTES = 256 << 20


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id, url: str, payload: bytes, sha1: str, refers_to, n_bytes: int) -> bytes:
    """One WARC/1.1 record. A revisit (``refers_to`` is not None) has HTTP headers but no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary built from records; where they are too few or too alike to build one, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


class Archive:
    """Writes records to one stream. The first ``SAMPLE`` bytes wait until the dictionary is built from them."""

    def __init__(self, out):
        self.out, self.waiting, self.size, self.press, self.n = out, [], 0, None, 0

    def add(self, rec: bytes) -> None:
        self.n += 1
        if self.press is None:
            self.waiting.append(rec)
            self.size += len(rec)
            if self.size >= SAMPLE:
                self._begin()
        else:
            self.out.write(self.press.compress(rec))

    def _begin(self) -> None:
        # long records count by parts, so that no single one fills the dictionary
        cut = [r[i : i + 4096] for r in self.waiting for i in range(0, len(r), 4096)]
        d = dictionary(cut)
        self.out.write(struct.pack("<II", MAGIC, len(d)) + d)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=True)
        for r in self.waiting:
            self.out.write(self.press.compress(r))
        self.waiting = []

    def close(self) -> None:
        if self.press is None:
            self._begin()


def records(stream) -> Iterator[bytes]:
    """The records of an archive, from its stream, one frame after another."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    d = zstandard.ZstdCompressionDict(stream.read(size))
    press = zstandard.ZstdDecompressor(dict_data=d)
    data, one, parts = b"", None, []
    while True:
        if not data and not (data := stream.read(1 << 20)):
            if one is not None:
                raise ValueError("the archive ends inside a record")
            return
        one = one or press.decompressobj()
        parts.append(one.decompress(data))
        data = b""
        if one.eof:
            data, one = one.unused_data, None
            yield b"".join(parts)
            parts = []


def parsed(rec: bytes) -> dict:
    """The header fields of a record, and its HTTP payload."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"http": http.decode("utf-8"), "payload": payload}


def _write(to: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(to)
        out = a = None
        done: list[tuple[str, int]] = []
        total = 0

        def end() -> None:
            a.close()
            out.close()
            done.append((name, a.n))

        for b in batches:
            for r in b.to_pylist():
                if a is None or total >= ARCHIVE_BYTES:
                    if a is not None:
                        end()
                    fs.create_dir(folder, recursive=True)
                    name, total = f"{uuid.uuid4().hex}.warc.zst", 0  # an attempt's own; the manifest names the right ones
                    out = fs.open_output_stream(f"{folder}/{name}")
                    a = Archive(out)
                payload = r["html"].encode()
                total += len(payload)
                a.add(record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"], len(payload)))
        if a is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([f"{to}/{n}" for n, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["file", "n_records"])

    return run


def write_warc(pages: DataFrame, to: str, least_bytes: int = 1000) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); returns the manifest (file, n_records).

    Of records with equal payloads of at least ``least_bytes``, that with the largest page_id is a response and the
    others are revisits of it. Null html: an empty payload. Null url: an empty one; line ends in a url become spaces.
    Null page_ids: a response, as are all rows that share the largest page_id. No rows: no archives. Other columns
    are ignored. The manifest, a written table, names the archives of the attempts that succeeded.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", " ").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = own.filter(F.octet_length("html") >= least_bytes)
    twice = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).filter("n > 1 and last is not null").select("digest", "last")
    revisit = F.when((F.col("page_id") < F.col("last")), F.col("last"))
    # small payloads are never revisits: they have no key, so equal ones don't meet in one task
    key = F.when(F.octet_length("html") >= least_bytes, F.col("digest"))
    dealt = own.withColumn("key", key).join(twice.withColumnRenamed("digest", "key"), "key", "left").select("page_id", "url", "html", "digest", revisit.alias("refers_to"))
    return written(dealt.mapInArrow(_write(to), "file string, n_records bigint"), "warc-manifest")


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for b in batches:
        for path in b.column("file").to_pylist():
            fs, at = file_system(path)
            rows = []
            with fs.open_input_stream(at) as f:
                for rec in records(f):
                    r = parsed(rec)
                    digest = base64.b32decode(r["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(r["http"].rpartition("Content-Length: ")[2])
                    if r["WARC-Type"] == "response" and (hashlib.sha1(r["payload"]).hexdigest() != digest or len(r["payload"]) != size):
                        raise ValueError(f"a payload of {path} doesn't have its digest")
                    number = lambda x: int(x) if x else None
                    rows.append((number(r["X-Page-ID"]), size, digest, r["WARC-Type"], number(r.get("X-Refers-To-Page-ID")), r["WARC-Target-URI"]))
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)


def read_warc(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` of each record in the named archives.
    The payload of each response is held against its digest and length."""
    small_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file").repartition(n, "file").mapInArrow(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def archived(pages: DataFrame) -> DataFrame:
    """Writes archives into the shared folder and gives what ``read_warc`` reads; nulls, repeated rows and empty tables
    as in ``write_warc``."""
    spark = pages.sparkSession
    return read_warc(spark, write_warc(pages, new_path(spark, "warc")))
