"""Token ids as length-delimited binary records, with an index file of offsets beside every data file.

A record is: 8 bytes of payload length, 4 bytes of that length's masked checksum, the payload, 4 bytes of
its masked checksum; numbers are little-endian. The payload is the document id (8 bytes, signed), one byte
for the width of an id (2 or 4), and the ids. Checksums are CRC-32, rotated and offset so that a checksum
of data that holds checksums stays sound. The index has one entry of 24 bytes for each record: offset,
document id, number of ids; with it, records are read in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import shared_dir
from tallymark.llm.tokens import encoder, tokenizer_path, wide

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Characters of text in one data file, about; very long documents go over it.
SHARD_CHARS = 32_000_000
#: Bytes of records written or read in one go, unless one record is longer.
RANGE = 8_000_000
_HEAD, _SUM, _DOC, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB"), struct.Struct("<Qqq")
#: Stands for a null document id.
NO_ID = -(1 << 63)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return head + _SUM.pack(masked(head)) + payload + _SUM.pack(masked(payload))


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ids: little-endian unsigned numbers of ``width`` bytes."""
    return _DOC.pack(NO_ID if doc_id is None else doc_id, width) + ids


def index_entry(at: int, doc_id: int | None, n: int) -> bytes:
    return _ENTRY.pack(at, NO_ID if doc_id is None else doc_id, n)


def record_at(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids, offset of the next record); ValueError for a record that its checksums contradict."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or _SUM.unpack_from(data, at + 8)[0] != masked(head):
        raise ValueError(f"the length at {at} is damaged")
    n = _HEAD.unpack(head)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or _SUM.unpack_from(data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"the record at {at} is damaged")
    doc, width = _DOC.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=_DOC.size)
    return (None if doc == NO_ID else doc), ids, at + 16 + n


def _store(uri: str):
    """The file system of a folder's URI and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_records(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END, shards: int | None = None) -> DataFrame:
    """Writes data and index files under ``uri``, ids in ascending order (nulls first), and returns (shard, n_records, n_ids) of each.

    Rows are dealt out by ranges of the id, sorted, encoded and written by the tasks; a task writes under a
    name of its own attempt and renames when done, so a task that runs again does no harm. A null text is
    empty; a repeated id gives a record each time, in order of the text's hash.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path(TOKENIZER)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS), spark.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(shards, F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, False)
        width = encode.width
        end = int(end_id).to_bytes(width, "little")
        store, folder = _store(uri)
        task = TaskContext.get()
        shard, attempt = task.partitionId(), f"{task.taskAttemptId()}-{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        name, n, total, at = f"{folder}/part-{shard:06d}", 0, 0, 0
        with store.open_output_stream(f"{name}.{attempt}.tmp") as data, store.open_output_stream(f"{name}.{attempt}.tmpi") as index:
            for batch in batches:
                records, entries, size = [], [], 0
                for doc, ids in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1).to_pylist()), strict=True):
                    records.append(framed(payload_of(doc, ids + end, width)))
                    entries.append(index_entry(at, doc, len(ids) // width + 1))
                    at, n, total, size = at + len(records[-1]), n + 1, total + len(ids) // width + 1, size + len(records[-1])
                    if size > RANGE:
                        data.write(b"".join(records))
                        records, size = [], 0
                data.write(b"".join(records))
                index.write(b"".join(entries))
        store.move(f"{name}.{attempt}.tmpi", f"{name}.index")
        store.move(f"{name}.{attempt}.tmp", f"{name}.records")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_records": pa.array([n], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    return ordered.mapInArrow(write, "shard int, n_records bigint, n_ids bigint")


def read_records(spark: SparkSession, uri: str, shards: list[tuple[int, int]], with_ids: bool = False) -> DataFrame:
    """The records of (shard, ids before it), read back and checked: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids.

    ``start`` counts the ids of all documents before; ids are little-endian unsigned 32-bit bytes. The list
    has one entry for each data file.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(uri)
        for batch in batches:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{folder}/part-{shard:06d}"
                with store.open_input_file(f"{name}.index") as f:
                    entries = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                with store.open_input_file(f"{name}.records") as f:
                    ends = np.append(entries[1:, 0], f.size())
                    first = 0
                    while first < len(entries):  # records that lie within RANGE bytes, or one
                        begin = int(entries[first, 0])
                        last = max(first + 1, int(np.searchsorted(ends, begin + RANGE, "right")))
                        f.seek(begin)
                        data, rows = memoryview(f.read(int(ends[last - 1]) - begin)), []
                        for at, _, n in entries[first:last].tolist():
                            doc, ids, _ = record_at(data, at - begin)
                            if len(ids) != n:
                                raise ValueError(f"the index of shard {shard} does not fit its records")
                            raw = wide(ids, ids.itemsize)
                            rows.append((doc, before, n, zlib.crc32(raw)) + ((raw,) if with_ids else ()))
                            before += n
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[x for x, _ in fields])
                        first = last

    todo = spark.createDataFrame(shards, "shard int, before bigint").repartition(max(1, len(shards)), "shard")
    return todo.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))


def round_trip(docs: DataFrame, uri: str | None = None, with_ids: bool = False, **options) -> DataFrame:
    """Writes docs as records and reads them back. uri: where to; else a new folder in the shared one."""
    spark = docs.sparkSession
    uri = uri or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    shards, before = [], 0
    for r in sorted(write_records(docs, uri, **options).collect(), key=lambda r: r["shard"]):  # one row for each data file
        shards.append((r["shard"], before))
        before += r["n_ids"]
    return read_records(spark, uri, shards, with_ids)
