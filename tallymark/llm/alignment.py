"""Alignment of the tokens that two tokenizers make of the same texts, each distinct segment worked on once.

A text is cut before runs of space at places that no token of either vocabulary spans: none of the two has an entry in which
such a space follows another character, which is looked up in both, so what one tokenizer does on one side of the cut
cannot reach the other side. Documents are turned into numbers of segments, by chunks with a dictionary each. The distinct
segments of all dictionaries are tokenised and aligned once; counts of linked ids add up over segments times their
occurrences; alignments are joined back to the dictionaries, and each chunk's documents are composed from its dictionary.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import written
from tallymark.llm.tokens import tokenizer_path

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that share a dictionary, about; a longer text has one of its own.
CHUNK = 32_000_000
#: Segments tokenised in one call, and characters of them.
GROUP, GROUP_CHARS = 4096, 1_000_000
#: Dictionary rows that are packed together, about.
PACK = 500_000
#: Keys that a pair of ids is spread over where it meets the segments that hold it.
SALTS = 16
#: Space that may begin a segment, if the vocabularies allow it.
SPACES = " \n\t"
#: What any of the tokenizers may take for space: no cut after one of these.
_WIDE = r"\s\u180e\u200b\ufeff\u2581"


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers of one process."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for word, i in self.a.get_vocab().items():
            self.a_bytes[i] = special.get(i) or bytes(map(letters.__getitem__, word))
        model = sentencepiece_model_pb2.ModelProto()
        with open(second, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False  # segments bring their own space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode() for p in model.pieces]
        self.a_length, self.b_length = (np.array([len(w) for w in t]) for t in (self.a_bytes, self.b_bytes))
        entries = [w.decode(errors="replace") for w in self.a_bytes] + [p.piece.replace("▁", " ") for p in model.pieces if p.type != kinds.BYTE]
        self.cuts = "".join(c for c in SPACES if not any(re.search(rf"[^{_WIDE}]{c}", w) for w in entries))
        self.where = re.compile(rf"(?<=[^{_WIDE}])(?=[{self.cuts}])" if self.cuts else r"(?!)")
        self.simple = re.compile(rf"[{_WIDE}][{_WIDE}]|[^\S \n]|[\0\u180e\u200b\ufeff▁]")

    def segments(self, text: str) -> list[str]:
        """The text with a space before it, cut; the parts joined give it again."""
        text = " " + text
        if "\n" in self.cuts and " " in self.cuts and not self.simple.search(text):  # single spaces and line ends alone
            return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
        return self.where.split(text)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)], self.b.encode(segments, num_threads=1)


_loaded: dict[tuple[str, str], Pair] = {}


def pair(first: str, second: str) -> Pair:
    if (first, second) not in _loaded:
        _loaded[first, second] = Pair(first, second)
    return _loaded[first, second]


def groups(a: list[str], b: list[str], a_last: list[int], b_last: list[int]) -> list[str]:
    """Each group as text: the tokens of both up to the next places in a_last and b_last."""
    out, i, j = [], 0, 0
    for x, y in zip(a_last, b_last, strict=True):
        out.append(f"{a[i]}|{b[j]}" if x == i and y == j else f"{','.join(a[i : x + 1])}|{','.join(b[j : y + 1])}")
        i, j = x + 1, y + 1
    return out


def align(p: Pair, segments: list[str]) -> list[tuple[bool, int, int, str, np.ndarray]]:
    """(ok, n_a, n_b, groups, links) of each segment; links are pairs of ids in one number, A's in the upper 32 bits.

    ok: the bytes of its tokens are the segment's, with both tokenizers.
    """
    both, size = p.encode(segments), np.array([len(s.encode()) for s in segments])
    ids = [np.array([i for x in k for i in x], np.int64) for k in both]
    n = [np.array([len(x) for x in k]) for k in both]
    raw = "".join(segments).encode()
    for k, (table, lengths) in enumerate(((p.a_bytes, p.a_length), (p.b_bytes, p.b_length))):
        whole = b"".join([table[i] for i in ids[k].tolist()]) == raw
        if not whole or not np.array_equal(np.cumsum(np.append(0, lengths[ids[k]]))[np.cumsum(n[k])], np.cumsum(size)):
            good = [all(b"".join([t[i] for i in x[at]]) == s.encode() for t, x in zip((p.a_bytes, p.b_bytes), both, strict=True)) for at, s in enumerate(segments)]
            rest = iter(align(p, [s for s, g in zip(segments, good, strict=True) if g]) if any(good) else [])
            return [next(rest) if g else (False, 0, 0, "", np.zeros(0, np.int64)) for g in good]
    a_ends, b_ends = np.cumsum(p.a_length[ids[0]]), np.cumsum(p.b_length[ids[1]])
    at = np.searchsorted(b_ends, a_ends)
    a_last = np.flatnonzero(b_ends[at] == a_ends)
    b_last = at[a_last]
    links = ids[0][a_last] << 32 | ids[1][b_last]
    shown = groups(list(map(str, ids[0].tolist())), list(map(str, ids[1].tolist())), a_last.tolist(), b_last.tolist())
    ends = np.searchsorted(a_last, np.cumsum(n[0]) - 1, "right").tolist()
    return [(True, x, y, ";".join(shown[i:j]), links[i:j]) for x, y, i, j in zip(n[0].tolist(), n[1].tolist(), [0, *ends], ends)]


_PARTS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("i", pa.int32()), ("n", pa.int64()), ("segment", pa.string())])


def _rows(schema: pa.Schema, length: int, /, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of the columns given, nulls in the others."""
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(length, f.type) for f in schema], schema=schema)


def _parts(first: str, second: str, chunk_chars: int):
    """Documents to rows of two kinds: (chunk, doc_id, n_ids, ids), numbers of segments as packed 32-bit ones, and (chunk, i, n, segment), the dictionary with counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = pair(first, second).segments
        chunk = TaskContext.get().partitionId() << 32
        number: dict[str, int] = {}
        names: list[int | None] = []
        docs: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            n, m = len(docs), len(number)
            yield _rows(_PARTS, n, chunk=pa.array(np.full(n, chunk)), doc_id=pa.array(names, pa.int64()), n_ids=pa.array([len(x) for x in docs], pa.int64()), ids=pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in docs], pa.binary()))
            if m:
                counts = np.bincount(np.concatenate(docs), minlength=m)
                yield _rows(_PARTS, m, chunk=pa.array(np.full(m, chunk)), i=pa.array(np.arange(m, dtype=np.int32)), n=pa.array(counts), segment=pa.array(list(number), pa.string()))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = segments(text) if text else []
                for s in set(found).difference(number):
                    number[s] = len(number)
                names.append(doc)
                docs.append(np.fromiter(map(number.__getitem__, found), "<i4", len(found)))
                size += len(text or "")
                if size >= chunk_chars:
                    yield from flush()
                    chunk, number, names, docs, size = chunk + 1, {}, [], [], 0
        if docs:
            yield from flush()

    return cut


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * 4, "zstd"), "<i4") if n else np.zeros(0, "<i4")


_ALIGNED = pa.schema([("seg", pa.int64()), ("chunk", pa.int64()), ("i", pa.int32()), ("ok", pa.bool_()), ("times", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("links", pa.list_(pa.int64()))])
_ALIGNED_SQL = "seg bigint, chunk bigint, i int, ok boolean, times bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<bigint>"


def _aligned(first: str, second: str):
    """Dictionary entries, equal segments one after another, to rows of two kinds: (seg, chunk, i, ok) of each entry, and each
    distinct segment's alignment with the times that it occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(first, second)
        last, seg = None, (TaskContext.get().partitionId() << 32) - 1
        waiting: list[str] = []  # distinct segments not aligned yet; the last one may still get entries
        first_of, times, chars = seg + 1, [], 0
        entries: list[pa.RecordBatch] = []
        owners: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found = align(p, waiting)
            m = len(found)
            ok = np.array([f[0] for f in found])
            yield _rows(
                _ALIGNED, m, seg=pa.array(np.arange(first_of, first_of + m)), ok=pa.array(ok), times=pa.array(times, pa.int64()), n_a=pa.array([f[1] for f in found], pa.int64()), n_b=pa.array([f[2] for f in found], pa.int64()),
                n_groups=pa.array([len(f[4]) for f in found], pa.int64()), groups=pa.array([f[3] for f in found], pa.string()),
                links=pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(f[4]) for f in found]), pa.int32()), pa.array(np.concatenate([f[4] for f in found]))),
            )
            for batch, owner in zip(entries, owners, strict=True):
                yield _rows(_ALIGNED, len(owner), seg=pa.array(owner), chunk=batch.column(0), i=batch.column(1), ok=pa.array(ok[owner - first_of]))

        for batch in batches:
            at = 0
            names, counts = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            owner = np.zeros(len(names), np.int64)
            for k, (name, n) in enumerate(zip(names, counts, strict=True)):
                if name != last:
                    if len(waiting) >= GROUP or chars >= GROUP_CHARS:
                        entries.append(batch.slice(at, k - at))
                        owners.append(owner[at:k])
                        yield from flush()
                        first_of, at, chars = seg + 1, k, 0
                        for done in (waiting, times, entries, owners):
                            done.clear()
                    last, seg = name, seg + 1
                    waiting.append(name)
                    times.append(0)
                    chars += len(name)
                times[-1] += n
                owner[k] = seg
            entries.append(batch.slice(at))
            owners.append(owner[at:])
        if waiting:
            yield from flush()

    return work


def _spoilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (chunk, n_ids, ids, bad): counts of the segments of documents that hold one of ``bad``."""
    for batch in batches:
        found: dict[int, Counter] = {}
        for chunk, n, raw, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = _numbers(raw, n)
            if np.isin(ids, bad).any():
                found.setdefault(chunk, Counter()).update(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True)))
        rows = [(c, i, n) for c, counts in found.items() for i, n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["chunk", "i", "less"])


#: Columns of a dictionary that add up over a document; each group has one link.
_SUMS = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]
_OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary rows as (chunk, part): those of a chunk among PACK rows as one compressed table, as many narrow rows shuffle badly."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        table = table.take(np.argsort(table.column("chunk").to_numpy(), kind="stable"))
        chunks, starts = np.unique(table.column("chunk").to_numpy(), return_index=True)
        table, parts = table.drop_columns("chunk").combine_chunks(), []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(table)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table.slice(a, b - a))
            parts.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "part"])

    rows, n = [], 0
    for batch in batches:
        rows.append(batch)
        n += len(batch)
        if n >= PACK:
            yield flush(rows)
            rows, n = [], 0
    if n:
        yield flush(rows)


def _composed(docs: pa.Table, words: pa.Table, details: bool) -> pa.Table:
    """The documents of one chunk from the parts of its dictionary."""
    if not len(words):  # texts without segments only
        words = pa.table({c: pa.array([], k) for c, k in [("i", pa.int32()), ("ok", pa.bool_()), *((c, pa.int64()) for c in _SUMS), ("groups", pa.string())]})
    else:
        words = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in words.column("part").to_pylist()])
    order = np.argsort(words.column("i").to_numpy())
    ok = words.column("ok").to_numpy(zero_copy_only=False)[order]
    sums = np.stack([words.column(c).to_numpy()[order] for c in _SUMS])
    shown = words.column("groups").to_pylist()
    shown = [shown[k] for k in order.tolist()]
    rows = []
    for doc, n, raw in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "n_ids", "ids")), strict=True):
        ids = _numbers(raw, n)
        good = len(ids) > 0 and bool(ok[ids].all())
        text = ";".join([shown[k] for k in ids.tolist()]) if good else ""
        a, b, g, best, total = sums[:, ids].sum(1).tolist() if good else [0] * len(_SUMS)
        row = (doc, a, b, g, g, best, total, hashlib.sha256(text.encode()).hexdigest() if good else "")
        rows.append(row + ((text,) if details else ()))
    kinds = [pa.int64()] * (1 + len(_OUT)) + [pa.string()] * (2 if details else 1)
    names = ["doc_id", *_OUT, "groups_sha256"] + (["groups"] if details else [])
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None, chunk: int = CHUNK, details: bool = False) -> DataFrame:
    """One row for each row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if wanted, groups.

    The text with a space before it is encoded by a byte-level tokenizer (A) and by a sentence-piece model (B) without special
    tokens, whose strings are text like other. Byte offsets at which tokens of both end cut them into groups, and link the two
    tokens. The count of a pair of ids is that of its links in all rows; ``n_best`` counts links that no other partner
    of their B id beats, ``count_sum`` adds the counts of all links. ``groups`` are the ids, as ``a1,a2|b1;a3|b2,b3``.
    A text that is null or empty, or whose tokens do not give its bytes back (it holds U+2581), has zeros and '' and counts
    for nothing. Rows with a null or a repeated id count like others; other columns are left out; an empty
    table gives no row. A text without space is one segment, in memory once.
    """
    first, second = first or tokenizer_path(FIRST), second or tokenizer_path(SECOND)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = written(texts.mapInArrow(_parts(first, second, chunk), "chunk bigint, doc_id bigint, n_ids bigint, ids binary, i int, n bigint, segment string"), "segments", "zstd")
    numbers, entries = parts.filter("ids is not null").select("chunk", "doc_id", "n_ids", "ids"), parts.filter("segment is not null").select("chunk", "i", "n", "segment")
    table = written(entries.repartition("segment").sortWithinPartitions("segment").mapInArrow(_aligned(first, second), _ALIGNED_SQL), "alignments", "zstd")
    where, distinct = table.filter("i is not null").select("seg", "chunk", "i", "ok"), table.filter("i is null").drop("chunk", "i")
    bad = where.filter("not ok").groupBy("chunk").agg(F.collect_list("i").alias("bad"))  # bounded by a chunk's dictionary
    less = numbers.join(bad, "chunk").select("chunk", "n_ids", "ids", "bad").mapInArrow(_spoilt, "chunk bigint, i int, less bigint")
    less = written(less.join(where, ["chunk", "i"]).groupBy("seg").agg(F.sum("less").alias("less")), "spoilt")
    linked = distinct.filter("ok").select("seg", "times", F.explode("links").alias("pair"))
    times = linked.groupBy("pair").agg(F.sum("times").alias("times")).unionByName(linked.join(less, "seg").groupBy("pair").agg((-F.sum("less")).alias("times")))
    pairs = written(times.groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    best = pairs.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))
    ranked = pairs.join(best, b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    scored = linked.select("seg", "pair", F.pmod(F.xxhash64("seg"), F.lit(SALTS)).cast("int").alias("salt")).join(ranked, ["pair", "salt"])
    scored = scored.groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    sums = distinct.join(scored, "seg", "left").select("seg", "n_a", "n_b", "n_groups", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups")
    words = where.join(sums, "seg").select("chunk", "i", "ok", *_SUMS, "groups").mapInArrow(_packed, "chunk bigint, part binary")
    out = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _OUT) + ", groups_sha256 string" + (", groups string" if details else "")
    return numbers.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(lambda d, w: _composed(d, w, details), out)
