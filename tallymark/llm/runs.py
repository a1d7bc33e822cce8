"""Periodic runs of words: stretches that repeat a shorter one four times or more.

Every run has a Lyndon root, which under one of two orders of the words (the given one and its reverse) is the longest
Lyndon word at the places where it begins (Bannai et al., 2017). A stack scanned from right to left keeps the
longest Lyndon words; to grow one, two suffixes are compared by their longest common extension, found by
direct comparison of a few words and then by binary search over a rolling hash. The same extension to the left and to the right
of a Lyndon word and its end gives the run, which is then verified word by word.

Words that cannot lie in any run are taken out before: in a run each word occurs as often as the root is repeated, so a word
that is rarer in the stretch around it ends that stretch, until nothing changes much.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods that a run has at least, and words.
TIMES, LEAST = 4, 6
#: Words compared one by one before the hash is asked.
DIRECT = 8
_MOD, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E68D % ((1 << 61) - 1)


class Sequence:
    """Numbers with the longest common extension of two places, to the right and to the left."""

    def __init__(self, numbers: list[int], base: int = _BASE):
        self.s, self.n, self.base = numbers, len(numbers), base
        self.hashes: list[int] = []
        self.powers: list[int] = []

    def _hash(self) -> None:
        base = self.base
        self.hashes = list(accumulate(self.s, lambda h, x: (h * base + x + 1) % _MOD, initial=0))
        self.powers = list(accumulate(range(self.n), lambda p, _: p * base % _MOD, initial=1))

    def same(self, i: int, j: int, length: int) -> bool:
        h, p = self.hashes, self.powers[length]
        return (h[i + length] - h[j + length] - (h[i] - h[j]) * p) % _MOD == 0

    def right(self, i: int, j: int) -> int:
        """Words that agree from i and from j on, i < j."""
        s, n = self.s, self.n
        k, most = 0, min(DIRECT, n - j)
        while k < most and s[i + k] == s[j + k]:
            k += 1
        if k < DIRECT or k == n - j:
            return k
        if not self.hashes:
            self._hash()
        step = k
        while j + k + step <= n and self.same(i + k, j + k, step):
            k += step
            step *= 2
        step = min(step, n - j - k)
        low, high = 0, step  # agree for low words; not for more than high
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i + k, j + k, middle):
                low = middle
            else:
                high = middle - 1
        return k + low

    def left(self, i: int, j: int, most: int) -> int:
        """Words that agree before i and before j, i < j, at most ``most``."""
        s, most = self.s, min(most, i)
        k = 0
        while k < most and k < DIRECT and s[i - 1 - k] == s[j - 1 - k]:
            k += 1
        if k < DIRECT or k == most:
            return k
        if not self.hashes:
            self._hash()
        low, high = k, most
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i - middle, j - middle, middle):
                low = middle
            else:
                high = middle - 1
        return low


def lyndon_runs(seq: Sequence, reverse: bool, times: int, least: int, out: set[tuple[int, int, int]]) -> None:
    """Adds (start, end, period) of the runs whose roots are Lyndon words under the order, or its reverse."""
    s, n = seq.s, seq.n
    ends, reach = [0] * (n + 1), [0] * (n + 1)  # of the Lyndon word at each place its end, and how far the words there and at its end agree
    for i in range(n - 1, -1, -1):
        x, j, same = s[i], i + 1, 0
        while j < n:
            y = s[j]
            if x != y:
                if (x < y) == reverse:
                    same = 0
                    break
            else:
                same = reach[i + 1] + 1 if ends[i + 1] == j + 1 else seq.right(i, j)
                if j + same == n or (s[i + same] < s[j + same]) == reverse:
                    break
            j = ends[j]
            same = 0
        ends[i], reach[i] = j, same
        period = j - i
        if same > (times - 2) * period:  # the leftmost root of a run has so many after it, and less than a period before it
            before = seq.left(i, j, period)
            if before < period and before + period + same >= max(times * period, least):
                out.add((i - before, j + same, period))


def _verified(s: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether the run is one, and no neighbour extends it, word by word."""
    inside = np.array_equal(s[start : end - period], s[start + period : end])
    return bool(inside and (start == 0 or s[start - 1] != s[start - 1 + period]) and (end == len(s) or s[end] != s[end - period]))


def _stretches(s: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of stretches outside of which no run lies: none of their words is rarer in them than ``times``.

    Words that are rarer split a stretch; it ends when a round takes out fewer than one in twenty.
    """
    keep = np.arange(len(s))
    label = np.zeros(len(s), np.int64)
    wide = int(s.max()) + 1 if len(s) else 1
    while len(keep):
        _, where, counts = np.unique(label * wide + s[keep], return_inverse=True, return_counts=True)
        stay = counts[where] >= times
        was, keep = len(keep), keep[stay]
        if not len(keep):
            return []
        # a new stretch begins after a gap; places were neighbours before, so their labels need no look
        label = np.cumsum(np.concatenate(([0], (np.diff(keep) > 1).astype(np.int64))))
        long = np.bincount(label)[label] >= least
        keep, label = keep[long], label[long]
        if len(keep) and len(keep) >= was * 0.95:
            break
    if not len(keep):
        return []
    cuts = np.flatnonzero(np.diff(keep) > 1)
    return list(zip(keep[np.concatenate(([0], cuts + 1))].tolist(), (keep[np.concatenate((cuts, [len(keep) - 1]))] + 1).tolist(), strict=True))


def runs_of(numbers: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``times`` periods and ``least`` numbers, by start, then period.

    Numbers stand for words; ``times`` is 2 at least.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    out: list[tuple[int, int, int]] = []
    for start, end in _stretches(numbers, times, least):
        part, base = numbers[start:end], _BASE
        while True:
            found: set[tuple[int, int, int]] = set()
            seq = Sequence(part.tolist(), base)
            for reverse in (False, True):
                lyndon_runs(seq, reverse, times, least, found)
            if all(_verified(part, *r) for r in found):
                break
            base = base * 31 % _MOD  # two unlike stretches had one hash: again with another base
        out += [(start + a, b - a, p) for a, b, p in found]
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, in one document of ten (by its id) with a tail that repeats; a null id plants nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Of n places those that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


_FIELDS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_COLUMNS = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least: int = LEAST, plant: bool = False, details: bool = False) -> DataFrame:
    """One row for each row: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    Words are runs of characters other than ASCII space, numbered from 0. A run is as long as its smallest period holds, ``times``
    periods and ``least`` words at least; of equally long ones the row shows the first, then that of the smallest period,
    and nulls where there is none. ``runs_sha256`` is that of each run's ``start,length,period`` and a line feed, ``collapsed_sha256``
    that of the words left when all but the first period of each run is dropped, joined by a space. With ``details``
    come ``runs``, an array of (start, length, period), and ``collapsed``, that text. ``plant`` puts repeats into one
    document of ten, for measurements. A null or empty text has no words; rows with a null or a repeated id are treated
    like others; other columns are left out; an empty table gives no row. A text is worked on by one task, in
    n log n steps.
    """
    fields = _FIELDS + ([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())] if details else [])
    schema = pa.schema(fields)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if plant:
                    words = planted(words, doc)
                number = {w: i for i, w in enumerate(set(words))}
                found = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), times, least) if len(words) >= least else []
                if found:
                    best = max(found, key=lambda r: (r[1], -r[0], -r[2]))
                    rest = [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()]
                    shown = (*best, best[1] * 1000 // best[2])
                else:
                    rest, shown = words, (None,) * 4
                left = b" ".join(rest)
                row = (doc, len(found), *shown, hashlib.sha256("".join(f"{a},{b},{p}\n" for a, b, p in found).encode()).hexdigest(), hashlib.sha256(left).hexdigest())
                rows.append(row + (([{"start": a, "length": b, "period": p} for a, b, p in found], left.decode()) if details else ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    extra = ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" if details else ""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(find, _COLUMNS + extra)
