"""Length-delimited binary records of token ids, with an offset index.

A shard ``part-NNNNNN.rec`` is a run of frames::

    u64 payload length | u32 masked crc of those 8 bytes | payload | u32 masked crc of payload

and a payload is ``u8 flags | i64 doc_id | ids``: flag 1 says that doc_id is
null, flag 2 that ids take four bytes (else two); all little-endian.  Masking
is ``rotate_right(crc32, 15) + 0xA282EAD8`` modulo 2**32, so that a checksum
stored inside checksummed data does not weaken it.  ``part-NNNNNN.idx`` holds a
fixed-width entry per record (offset u64, frame length u64, first id's place in
the shard u64, ids u64, doc_id i64, null flag u64): a reader that wants records
in any other order needs only this file.

Shards follow each other in doc_id order, nulls first.  A task writes under a
name of its own attempt and renames at the end, so that a lost or repeated task
leaves the same final files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from ._runtime import new_path, open_fs, pieces_of

#: Bytes of text a shard aims at; the number of shards follows the input.
SHARD_TEXT_BYTES = 32 << 20

INDEX = np.dtype([("offset", "<u8"), ("frame", "<u8"), ("start", "<u8"), ("n", "<u8"), ("doc_id", "<i8"), ("null", "<u8")])
NULL_ID, WIDE = 1, 2


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return ((((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF).to_bytes(4, "little")


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    flags = NULL_ID * (doc_id is None) | WIDE * bool(wide)
    payload = b"".join((bytes((flags,)), (doc_id or 0).to_bytes(8, "little", signed=True), ids.astype("<u4" if wide else "<u2").tobytes()))
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head), payload, masked(payload)))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids (u4) and the place after the frame that begins at ``at``."""
    head = bytes(data[at : at + 8])
    n = int.from_bytes(head, "little")
    payload = bytes(data[at + 12 : at + 12 + n])
    if bytes(data[at + 8 : at + 12]) != masked(head) or bytes(data[at + 12 + n : at + 16 + n]) != masked(payload):
        raise ValueError(f"checksum of the record at byte {at} does not match")
    ids = np.frombuffer(payload, "<u4" if payload[0] & WIDE else "<u2", offset=9).astype("<u4")
    return None if payload[0] & NULL_ID else int.from_bytes(payload[1:9], "little", signed=True), ids, at + 16 + n


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = tokens.END_ID, shard_bytes: int = SHARD_TEXT_BYTES) -> DataFrame:
    """Write docs (doc_id, text) to ``folder``; return its manifest.

    A null text is an empty one and a record then holds the end id alone.  Rows
    that share a doc_id each get a record.  An empty table gives no shard.
    Manifest: shard int, n_records long, n_ids long, n_bytes long, path string.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        encode = tokens.encoder(tokenizer).encode
        context = TaskContext.get()
        shard, name = context.partitionId(), f"{base}/part-{context.partitionId():06d}"
        own = f"{base}/_attempt-{context.taskAttemptId()}-{context.partitionId():06d}"
        out, entries, at, place = None, [], 0, 0
        for batch in batches:
            for some in pieces_of(batch, "text"):
                ids, stops = tokens.with_end(*encode(some.column(1)), end_id)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(own + ".rec")
                for doc_id, a, b in zip(some.column(0).to_pylist(), stops.tolist(), stops[1:].tolist()):
                    data = frame(doc_id, ids[a:b])
                    out.write(data)
                    entries.append((at, len(data), place, b - a, doc_id or 0, doc_id is None))
                    at += len(data)
                    place += b - a
        if out is None:
            return
        out.close()
        with fs.open_output_stream(own + ".idx") as f:
            f.write(np.array(entries, INDEX).tobytes())
        for kind in (".idx", ".rec"):
            fs.move(own + kind, name + kind)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_records": [len(entries)], "n_ids": [place], "n_bytes": [at], "path": [name + ".rec"]})

    manifest = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id").mapInArrow(write, "shard int, n_records long, n_ids long, n_bytes long, path string")
    manifest.write.parquet(f"{folder}/_manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def read_records(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """Read every record back and verify its checksums.

    Returns shard int, doc_id long, start long (place within the shard),
    n_tokens long, ids_crc32 long, frame_offset long and, with keep_ids, ids array<int>.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data = memoryview(content.as_buffer())
                shard = int(path.as_py()[-10:-4])
                at = place = 0
                while at < len(data):
                    rows: dict = {k: [] for k in ("shard", "doc_id", "start", "n_tokens", "ids_crc32", "frame_offset")}
                    held, ids_of, stops = 0, [], [0]
                    while at < len(data) and held < 1 << 20:
                        doc_id, ids, after = unframe(data, at)
                        for k, v in (("shard", shard), ("doc_id", doc_id), ("start", place), ("n_tokens", len(ids)), ("ids_crc32", zlib.crc32(ids.tobytes())), ("frame_offset", at)):
                            rows[k].append(v)
                        at, place, held = after, place + len(ids), held + len(ids)
                        if keep_ids:
                            ids_of.append(ids)
                            stops.append(held)
                    arrays = [pa.array(rows["shard"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in list(rows)[1:])]
                    if keep_ids:
                        flat = pa.array(np.concatenate(ids_of).astype(np.int32))
                        arrays.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), flat))
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long, frame_offset long"
    fields += ", ids array<int>" if keep_ids else ""
    names = [f.split()[0] for f in fields.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.rec").load(folder).select("path", "content")
    return files.mapInArrow(parse, fields)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of every shard: where each record lies, without reading records."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(content.as_buffer(), INDEX)
                ids = pa.array(x["doc_id"], mask=x["null"].astype(bool))
                columns = [pa.array(np.full(len(x), int(path.as_py()[-10:-4]), np.int32)), ids, *(pa.array(x[k].astype(np.int64)) for k in ("offset", "frame", "start", "n"))]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "frame_offset", "frame_bytes", "start", "n_tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.idx").load(folder).select("path", "content")
    return files.mapInArrow(parse, "shard int, doc_id long, frame_offset long, frame_bytes long, start long, n_tokens long")


def read_shuffled(spark: SparkSession, folder: str, seed: int, parts: int | None = None) -> DataFrame:
    """Every record once, in an order that ``seed`` settles: part int, place long, shard int, doc_id long, ids array<int>.

    The index alone is shuffled: records are dealt to parts and ordered within
    them by a seeded hash of where they lie, and each is read from its offset.
    Checksums are verified.  An empty folder gives no rows.
    """
    index = read_index(spark, folder).withColumn("h", F.xxhash64("shard", "frame_offset", F.lit(seed)))
    dealt = index.repartition(parts, "h") if parts else index.repartition("h")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        part, place, name, file = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            shards, _, offsets, sizes, *_ = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(shards):
                rows, held = [], 0
                while at < len(shards) and held < 8 << 20:
                    if name != shards[at]:
                        if file:
                            file.close()
                        name, file = shards[at], fs.open_input_file(f"{base}/part-{shards[at]:06d}.rec")
                    doc_id, ids, _ = unframe(memoryview(file.read_at(sizes[at], offsets[at])), 0)
                    rows.append((part, place, shards[at], doc_id, ids.astype(np.int32)))
                    held, place, at = held + sizes[at], place + 1, at + 1
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "place", "shard", "doc_id", "ids"])
        if file:
            file.close()

    return dealt.sortWithinPartitions("h").drop("h").mapInArrow(fetch, "part int, place long, shard int, doc_id long, ids array<int>")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = tokens.END_ID) -> DataFrame:
    """Write docs as records and digest what is read back.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32.  The
    ids before a shard are a running sum over the manifest, one row a shard.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "records")
    manifest = write_records(docs, folder, tokenizer, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before = manifest.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("ids_before"))
    return read_records(spark, folder, keep_ids=False).join(before, "shard").select("doc_id", (F.col("start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")
