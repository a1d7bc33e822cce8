"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items.

Texts and items are normalised alike (A-Z in lower case; words are runs of ASCII letters, digits and
non-ASCII characters). Words of the benchmark are numbered, every window of 13 consecutive item words is
a pattern of numbers, and each text's numbers are scanned once; hits are mapped back to word positions
and from there to character offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import dropped, written

#: Words in a window; an item with fewer is one window.
WINDOW = 13
#: A document is contaminated from one hit word in this many.
SHARE = 20
#: Benchmark characters in one automaton; a larger benchmark takes several passes over the texts.
AUTOMATON_CHARS = 2_000_000

#: Everything outside [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z, becomes a space.
_TABLE = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


class Automaton:
    """Patterns of numbered words. Pickles as its patterns; the trie is built once in each process."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.patterns: dict[tuple[int, ...], set[int]] = {}
        self.ids: list[str] = []
        self.numbers: dict[bytes, int] = {}
        for item, text in items:
            at = len(self.ids)
            self.ids.append(item)
            for w in windows_of(words_of(text), window):
                key = tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w)
                self.patterns.setdefault(key, set()).add(at)
        self.trie = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"trie": None}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open word ranges that are hit, and the items with a hit."""
        if not self.patterns or not words:
            return [], set()
        if self.trie is None:
            self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, owners in self.patterns.items():
                self.trie.add_word(key, (len(key), owners))
            self.trie.make_automaton()
        get = self.numbers.get
        numbers = tuple([get(w, 0) for w in words])
        ranges: list[tuple[int, int]] = []
        items: set[int] = set()
        if any(numbers):
            for end, (n, owners) in self.trie.iter(numbers):
                items |= owners
                ranges.append((end + 1 - n, end + 1))
        return merged(ranges), {self.ids[i] for i in items}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as half-open character ranges of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)] if ranges else []
    out, byte, char = [], 0, 0
    for a, b in ranges:  # in order, so each part of the text is decoded once
        ends = []
        for to in (at[a][0], at[b - 1][1]):
            char += len(raw[byte:to].decode("utf-8", "surrogatepass"))
            byte = to
            ends.append(char)
        out.append((ends[0], ends[1]))
    return out


#: What contamination() adds.
FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,words:array<struct<start:bigint,end:bigint>>,chars:array<struct<start:bigint,end:bigint>>>"


def _shards(benchmark: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in parts of about ``chars`` characters; one part is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = -(-size // chars) or 1
    for k in range(n):
        yield [(r["i"], r["t"]) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "found", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``docs`` with a column ``out_col`` of type FOUND: words, hit words, items, and hit ranges in words and characters.

    All columns of docs are kept; one named like ``out_col`` is replaced. A null or wordless text has no
    words and no hits. Items with a null id or text, or without words, give no window; equal items are all
    listed. An empty benchmark finds nothing. Each part of the benchmark is one automaton of bounded size and
    one pass over the texts, which adds to what the passes before it found; passes but the last are written,
    so driver and workers hold one automaton at a time, however large the benchmark is.
    """
    context, before, scanned = docs.sparkSession.sparkContext, None, None
    for part in _shards(benchmark, item_col, item_text_col, automaton_chars):
        if before is not None:
            last, scanned = scanned, written(docs, "scanned")
            docs = scanned
            before.destroy()
            if last is not None:
                dropped(last)
        automaton = context.broadcast(Automaton(part, window))
        docs = docs.withColumn(out_col, _pass(automaton)(F.col(text_col), F.lit(None).cast(FOUND) if before is None else F.col(out_col)))
        before = automaton
    return docs


def _pass(automaton: Broadcast) -> Callable[[Column, Column], Column]:
    """A function of (text, what was found before it) that adds what this automaton finds."""

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series, known: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t, old, old_items in zip(texts, known["words"], known["items"], strict=True):
            words = words_of(t)
            ranges, items = automaton.value.scan(words)
            if old is not None:
                ranges = merged(ranges + [(r["start"], r["end"]) for r in old])
                items |= set(old_items)
            rows.append((len(words), sum(b - a for a, b in ranges), sorted(items), [{"start": a, "end": b} for a, b in ranges], [{"start": a, "end": b} for a, b in char_spans(t or "", ranges)]))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "words", "chars"])

    return found


def is_contaminated(found: str = "found", share: int = SHARE) -> Column:
    """Some word is hit, and at least one in ``share``."""
    hit = F.col(f"{found}.n_hit")
    return (hit > 0) & (hit * share >= F.col(f"{found}.n_words"))
