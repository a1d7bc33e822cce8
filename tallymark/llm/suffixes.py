"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept only at minimisers: word positions whose run of GRAM words hashes lowest in some window of
``least - GRAM + 1`` neighbouring runs, so every passage of ``least`` words holds a kept position that its
content alone decides.

1. Kept runs that occur in one document only are dropped, after counting with partial aggregates.
2. The suffixes at the rest are sorted, in ranges over all machines; each is compared with its neighbours,
   which gives the longest match to its right. The same over reversed prefixes gives the match to its left.
   Equal suffixes collapse before the sort, and the rows at the ends of a range count as fully matched, which
   the last step puts right.
3. Matches of at least ``least`` words in all are confirmed: every stretch of ``least`` words in them
   is counted by document, by a 64-bit hash of its words, and confirmed stretches are joined to spans, each with its parts
   that hold no word of a stretch seen here first.

Documents with equal texts collapse before all this and come back as wholes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import written

#: Words of the shortest passage, and words of the runs at which suffixes are kept.
LEAST, GRAM = 50, 16
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Words of a text (cut at ASCII space, case kept) as 64-bit hashes."""

    def __init__(self, cache: int = 400_000):
        self.cache, self.known = cache, {}

    def words(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").split()
        known = self.known
        if new := set(found).difference(known):
            if len(known) > self.cache:
                known.clear()
                new = set(found)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words along the last axis, by doubling: runs of a power of two from halves, the rest from two that overlap."""
    if h.shape[-1] < n:
        return np.zeros((*h.shape[:-1], 0), np.uint64)
    size, x = 1, h
    while 2 * size <= n:
        x = _mixed(x[..., : x.shape[-1] - size] * _P + x[..., size:])
        size *= 2
    return x if size == n else _mixed(x[..., : h.shape[-1] - n + 1] * _P + x[..., n - size : n - size + h.shape[-1] - n + 1])


def minimisers(grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first, last): the positions that are lowest (leftmost on ties) of some window of that many grams, and the starts of those windows."""
    if len(grams) < window:
        return (np.zeros(0, np.int64),) * 3

    def lower(at: np.ndarray, by: int) -> np.ndarray:
        a, b = at[: len(at) - by], at[by:]
        return np.where(grams[b] < grams[a], b, a)

    lowest, size = np.arange(len(grams)), 1
    while 2 * size <= window:
        lowest, size = lower(lowest, size), 2 * size
    if size < window:
        lowest = lower(lowest, window - size)
    at, first = np.unique(lowest, return_index=True)
    return at, first, np.append(first[1:], len(lowest)) - 1


def _anchors(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, n_words, t1, t2, grams): two hashes of the text, and the run hashes at kept positions, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            n, t1, t2, g = [], [], [], []
            for text in batch.column(1):
                h = hasher.words(text.as_py())
                grams = runs(h, gram)
                digest = xxhash.xxh3_128_digest(h.tobytes())
                n.append(len(h))
                t1.append(int.from_bytes(digest[:8], "little", signed=True))
                t2.append(int.from_bytes(digest[8:], "little", signed=True))
                g.append(np.unique(grams[minimisers(grams, least - gram + 1)[0]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(g, pa.list_(pa.int64()))], ["doc_id", "n_words", "t1", "t2", "grams"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, t1 bigint, t2 bigint, grams array<bigint>")


def _suffixes(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, pos, near, wide, gram, right, left) at the kept positions of (doc_id, text, t1, wanted grams).

    right and left hold up to ``least - gram`` words after the run and, backwards, before it, 4 bytes for each.
    Stretches of ``least`` words that begin ``near`` to ``wide`` words before the position have their lowest run
    there: each stretch belongs to one position, and the same one wherever it occurs.
    """
    reach = least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for doc, text, t1, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                h = hasher.words(text.as_py())
                if int.from_bytes(xxhash.xxh3_128_digest(h.tobytes())[:8], "little", signed=True) != t1:
                    continue  # another row with this id
                grams = runs(h, gram)
                at, first, last = minimisers(grams, least - gram + 1)
                keep = np.isin(grams[at].view(np.int64), np.array(wanted.as_py(), np.int64))
                at, first, last = at[keep], first[keep], last[keep]
                short = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
                back = short[::-1].tobytes()
                ahead, n = short.tobytes(), len(h)
                for i in range(0, len(at), 4096):
                    some = at[i : i + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), doc), pa.int64()), pa.array(some, pa.int64()), pa.array(some - last[i : i + 4096], pa.int64()), pa.array(some - first[i : i + 4096], pa.int64()), pa.array(grams[some].view(np.int64), pa.int64()),
                            pa.array([ahead[4 * (p + gram) : 4 * min(n, p + gram + reach)] for p in some.tolist()], pa.binary()),
                            pa.array([back[4 * (n - p) : 4 * min(n, n - p + reach)] for p in some.tolist()], pa.binary()),
                        ],
                        ["doc_id", "pos", "near", "wide", "gram", "right", "left"],
                    )

    return rows.mapInArrow(run, "doc_id bigint, pos bigint, near bigint, wide bigint, gram bigint, right binary, left binary")


def common_prefix(a: bytes, b: bytes) -> int:
    """Words of 4 bytes that two contexts share from their start."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    x, y = np.frombuffer(a, "<u4", n), np.frombuffer(b, "<u4", n)
    return int((x != y).argmax())


def _matched(suffixes: DataFrame, side: str, reach: int) -> DataFrame:
    """(gram, side, how far it matches): sorted in ranges, each distinct context compared with its neighbours."""
    distinct = suffixes.groupBy("gram", side).agg(F.count("*").alias("times"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a row is held back until the one after it is known; the ends of a range count as matched
        held: tuple | None = None
        longest = 0
        for batch in batches:
            out = []
            for gram, context, times in zip(batch["gram"], batch[side], batch["times"], strict=True):
                context = bytes(context)
                same = common_prefix(held[1], context) if held and held[0] == gram else 0
                if held:
                    out.append((held[0], held[1], max(longest, same)))
                longest = len(context) // 4 if times > 1 or held is None else same
                held = (gram, context)
            yield pd.DataFrame(out, columns=["gram", side, "far"])
        if held:
            yield pd.DataFrame([(held[0], held[1], len(held[1]) // 4)], columns=["gram", side, "far"])

    ordered = distinct.repartitionByRange("gram", side).sortWithinPartitions("gram", side)
    return ordered.mapInPandas(run, f"gram bigint, {side} binary, far int")


def _padded(contexts: list[bytes], reach: int) -> np.ndarray:
    """Contexts of up to ``reach`` words as rows of that many."""
    return np.frombuffer(b"".join(c.ljust(4 * reach, b"\0") for c in contexts), "<u4").reshape(len(contexts), reach).astype(np.uint64)


def _stretches(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """(hash, doc_id, start) of every stretch of ``least`` words within a match, each from the position it belongs to.

    The run at the position counts as one word, and where it stands in the stretch is part of the hash.
    """
    reach = least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts = np.arange(reach, -1, -1)
        for batch in batches:
            number = {k: batch.column(k).to_numpy() for k in ("doc_id", "pos", "near", "wide", "gram", "far_right", "far_left")}
            before, after = _padded(batch.column("left").to_pylist(), reach)[:, ::-1], _padded(batch.column("right").to_pylist(), reach)
            own = runs(np.hstack([before, number["gram"].view(np.uint64)[:, None], after]), reach + 1)
            least_left = np.maximum(number["near"], reach - number["far_right"])
            most_left = np.minimum(number["wide"], number["far_left"])
            which, column = np.nonzero((lefts >= least_left[:, None]) & (lefts <= most_left[:, None]))
            hashes = _mixed(own[which, column] * _P + lefts[column].astype(np.uint64)).view(np.int64)
            columns = hashes, number["doc_id"][which], number["pos"][which] - lefts[column]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["hash", "doc_id", "start"])

    return rows.mapInArrow(run, "hash bigint, doc_id bigint, start bigint")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, n_words, first, later): maximal spans of words all of whose stretches of ``least`` words occur in another document.

    Words are cut at ASCII space; start counts words from 0. ``later`` holds the parts (start, n_words) of the
    span whose words lie only in stretches that a document with a smaller id holds; a part may be shorter than
    ``least`` words. A text with copies is one span; all of it is later in all but the document of the smallest
    id, where copies of the whole do not count and other documents do. Dropping the later parts leaves every
    stretch that differing texts hold whole in the document of the smallest id. ``first`` says that
    the later parts are not the whole span, so dropping only spans that are not first loses nothing either,
    but leaves the later parts of mixed spans. Documents
    without such a passage have no row, nor have null, empty and shorter texts; repeats within one document
    alone do not count. Rows without an id take no part; rows with one id and one text are one document. Other
    columns are left out. An empty table gives no row.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    anchors = written(_anchors(rows, least, gram), "anchors").filter(F.col("n_words") >= least)
    texts = written(anchors.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n_words").alias("n_words"), F.first("grams").alias("grams")), "texts")
    copies = anchors.select("doc_id", "t1", "t2").join(texts.filter("rep < last").select("t1", "t2", "rep", "n_words"), ["t1", "t2"]).distinct()
    copy = F.col("doc_id") != F.col("rep")
    whole = texts.filter("rep < last").select(F.col("rep").alias("doc_id"), F.lit(True).alias("copied")).distinct()
    wholes = copies.select("doc_id", F.lit(0).cast("bigint").alias("span"), F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end"), F.when(copy, 0).cast("bigint").alias("low"), F.when(copy, F.col("n_words")).alias("high"))

    kept = texts.select("rep", "t1", F.explode("grams").alias("gram"))
    shared = kept.groupBy("gram").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("gram")
    wanted = kept.join(shared, "gram").groupBy("rep", "t1").agg(F.collect_list("gram").alias("wanted"))  # bounded by a document's length
    found = rows.join(written(wanted, "wanted"), F.col("doc_id") == F.col("rep")).select("doc_id", "text", "t1", "wanted")
    suffixes = written(_suffixes(found, least, gram), "suffixes")
    reach = least - gram
    right = _matched(suffixes, "right", reach).withColumnRenamed("far", "far_right")
    left = _matched(suffixes, "left", reach).withColumnRenamed("far", "far_left")
    matched = suffixes.join(right, ["gram", "right"]).join(left, ["gram", "left"]).filter(F.col("far_left") + F.col("far_right") >= reach)
    stretches = written(_stretches(matched.select("doc_id", "pos", "near", "wide", "gram", "right", "left", "far_right", "far_left"), least, gram), "stretches")
    # written before the join back, so that the rows of a stretch that very many texts hold can be split there
    confirmed = stretches.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("hash", "low")
    confirmed = written(confirmed, "confirmed")
    hits = stretches.join(confirmed, "hash").select("doc_id", "start", (F.col("low") < F.col("doc_id")).alias("later")).join(whole, "doc_id", "left")
    # of the words of a later stretch, those in no first stretch around it are one run, maybe an empty one
    by_doc, own = Window.partitionBy("doc_id"), F.when(~F.col("later"), F.col("start"))
    forward, earlier = by_doc.orderBy("start"), by_doc.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    near = hits.withColumn("before", F.last(own, True).over(forward)).withColumn("after", F.last(own, True).over(by_doc.orderBy(F.desc("start"))))
    low, high = F.greatest("start", F.col("before") + least), F.least(F.col("start") + least, "after")
    runs_of = near.withColumn("low", F.when(F.col("later") & (low < high), low)).withColumn("high", F.when(F.col("low").isNotNull(), high))
    new_span = F.coalesce(F.col("start") - F.lag("start").over(forward) > least, F.lit(True))
    new_part = F.col("low").isNotNull() & F.coalesce(F.col("low") > F.last("high", True).over(earlier), F.lit(True))
    marked = runs_of.withColumn("new_span", new_span.cast("int")).withColumn("new_part", new_part.cast("int"))
    numbered = marked.withColumn("span", F.when(F.col("copied").isNull(), F.sum("new_span").over(forward)).otherwise(F.lit(0))).withColumn("part", F.sum("new_part").over(forward))
    parts = numbered.groupBy("doc_id", "span", "part").agg(F.min("start").alias("start"), (F.max("start") + least).alias("end"), F.min("low").alias("low"), F.max("high").alias("high"))
    later = F.when(F.col("low").isNotNull(), F.struct(F.col("low").alias("start"), (F.col("high") - F.col("low")).alias("n_words")))
    spans = parts.drop("part").unionByName(wholes).groupBy("doc_id", "span").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n_words"), F.coalesce(F.sum(F.col("high") - F.col("low")), F.lit(0)).alias("n_later"), F.sort_array(F.collect_list(later)).alias("later"))
    return spans.select("doc_id", "start", "n_words", (F.col("n_later") < F.col("n_words")).alias("first"), "later")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of (start, n_words) spans; the space after a dropped word goes with it."""
    raw = text.encode()
    words = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", raw)]
    out, at = [], 0
    for start, n in sorted(spans):
        out.append(raw[at : max(at, words[start][0])])
        at = max(at, words[start + n][0] if start + n < len(words) else len(raw))
    return b"".join([*out, raw[at:]]).decode()
