"""Packing by power-of-two decomposition.

A document of n ids is cut into n // LENGTH whole sequences and, for the rest, one piece for each binary
digit of its length, longest first. Pieces of equal length form a bucket to batch from; every piece is a
sequence of its own, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.tokens import encoder, tokenizer_path, wide

#: Ids in the longest sequences; a power of two.
LENGTH = 2048
TOKENIZER = "word_bpe_49k.json"
END = 1


def binary_pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: gapless, each a power of two of at most ``length``."""
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence has to be a power of two")
    out = [(i * length, length) for i in range(n // length)]
    at = len(out) * length
    for bit in range(length.bit_length() - 2, -1, -1):
        if n - at >= 1 << bit:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None, drops_space: bool = True, end_id: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if wanted, ids.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit bytes, ``bucket`` is the exponent of its
    length, by which sequences of one batch are chosen. ``sequence_id`` is unique in the result. A null or
    empty text is the end id alone. Rows with a null id or a repeated id are packed like others; other
    columns are left out. A text of any length is handled in its own row; an empty table gives no row.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    end = int(end_id).to_bytes(4, "little")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32())]
    fields += [("ids", pa.binary())] if with_ids else []
    schema = pa.schema(fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, drops_space)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, ids in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1).to_pylist()), strict=True):
                ids = wide(ids, encode.width) + end
                n = len(ids) // 4
                for start, most in binary_pieces(n, length):
                    piece = ids[4 * start : 4 * (start + most)]
                    rows.append((doc, start, most, zlib.crc32(piece), n, 0, most.bit_length() - 1) + ((piece,) if with_ids else ()))
                size += len(ids)
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    spark_schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, offset bigint, bucket int" + (", ids binary" if with_ids else "")
    pieces = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, spark_schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id())
