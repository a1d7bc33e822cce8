"""Near-duplicates by MinHash with tensored banding.

Texts are compared by their sets of word shingles. Two small collections of hash tuples are drawn for each
set; every pair of a tuple from one and a tuple from the other is a table key, so 2 * SIDE tuples serve
SIDE ** 2 tables and the hashing costs a square root of what independent tables would
(Christiani, 2019: fast locality-sensitive hashing frameworks).

1. Rows with equal sets collapse to one, so copies cost nothing after that.
2. Tuples that one set alone has cannot be part of a shared key; keys are formed of the others only.
3. In every table bucket each set is a candidate for the bucket's pivot, the member that comes first in one
   global order; distinct candidates are confirmed on the full sets, and confirmed links give components.
4. Buckets that still hold several components are settled. Their members meet in the buckets of their first
   tuples (coarser, so that a pair with many common keys meets seldom) or, where that is less work, in those of
   their keys. Of a bucket, the members outside its largest component are compared with all others, in blocks of
   BLOCK sets: an upper bound of the common shingles, counted on bit maps, rules out far pairs without a row for
   any of them; the rest are confirmed on the full sets, until the block's links connect what they can.

Every pair of sets that share a table key is thus in one component or compared, so a link is missed only if its two
sets share no key at all: at the threshold about 4 times in 10,000, at a similarity of 0.85 twice in 100,000.
A bucket of M sets, R of them outside its largest component, makes M * (R / BLOCK + 1) + R * M / BLOCK rows at
most: in proportion to its size while R is within a block, whatever M is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import dropped, written
from tallymark.llm.graph import components

#: Words in a shingle and least similarity, in percent, of the general interface.
WORDS, PERCENT = 5, 80
#: Tuples in each of the two collections, and hashes in a tuple.
SIDE, TUPLE = 16, 4
#: Sets in a block when buckets are settled; a set of more than LONG shingles counts as several.
BLOCK, LONG = 256, 2048
#: Bits of the widest bit map.
BITS = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, words: int, cache: int = 150_000):
        self.words, self.cache, self.known = words, cache, {}

    def hashes(self, text: str | None) -> np.ndarray:
        """Words are lower-cased (A-Z) and cut at ASCII space; fewer than a shingle's words are one shingle."""
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        known = self.known
        if new := set(found).difference(known):
            if len(known) > self.cache:
                known.clear()
                new = set(found)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mixed(out * _MIX + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def tuples(shingles: np.ndarray, side: int = SIDE, size: int = TUPLE) -> np.ndarray:
    """2 * side tuple hashes of a set that is not empty: first those of one collection, then of the other."""
    seeds = _mixed(np.arange(1, 2 * side * size + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[None, at : at + 512] * seeds[:, None]).min(1))
    out = np.zeros(2 * side, np.uint64)
    for i in range(size):
        out = _mixed(out * _MIX + least.reshape(2 * side, size)[:, i])
    return out


def _sketches(rows: DataFrame, words: int, side: int, size: int) -> DataFrame:
    """(doc_id, n, s1, s2, tuples): size of the set, two hashes of it, its tuples (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            n, s1, s2, t = [], [], [], []
            for text in batch.column(1):
                h = shingler.hashes(text.as_py())
                n.append(len(h))
                first, second = hashes_of(h.tobytes())
                s1.append(first)
                s2.append(second)
                t.append(tuples(h, side, size).view(np.int64) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(t, pa.list_(pa.int64()))], ["doc_id", "n", "s1", "s2", "tuples"])

    return rows.mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, tuples array<bigint>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of (rep, text, s1): a set as the bytes of its sorted hashes, where its first hash is s1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            reps, sets = [], []
            for rep, text, s1 in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = shingler.hashes(text.as_py()).tobytes()
                if hashes_of(raw)[0] == s1:
                    reps.append(rep)
                    sets.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], ["rep", "shingles"])

    return rows.mapInArrow(run, "rep bigint, shingles binary")


def hashes_of(raw: bytes) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set's bytes; equal sets have equal ones."""
    digest = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough."""
    left, right = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(f"s_{k}")) for k in ("a", "b"))

    @F.pandas_udf("boolean")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)], dtype=bool)

    return pairs.join(left, "a").join(right, "b").filter(same("s_a", "s_b")).select("a", "b")


def bit_maps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words for each set: the bits that its hashes fall on."""
    bits = 64
    while bits < min(BITS, 4 * max(map(len, sets))):
        bits *= 2
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, s in zip(out, sets, strict=True):
        marks = np.zeros(bits, bool)
        marks[s & np.uint64(bits - 1)] = True
        row[:] = np.packbits(marks)
    return out.view(np.uint64)


def settled(components: list[int], probes: list[bool], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links between a probe and another set of the block connect, as many as a forest of them has.

    A set has at least as many hashes that another lacks as it has bits that the other lacks; so the bits bound
    the common hashes from above, and only pairs that pass the bound are confirmed.
    """
    names, of = np.unique(components, return_inverse=True)
    if len(names) < 2:
        return []
    maps, n = bit_maps(sets), np.array([len(s) for s in sets])
    bits = np.bitwise_count(maps).sum(1, dtype=np.int64)
    out = []
    for i in np.flatnonzero(probes):
        others = np.flatnonzero((of != of[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            both = np.bitwise_count(maps[some] & maps[i]).sum(1, dtype=np.int64)
            most = np.minimum(n[some] - bits[some], n[i] - bits[i]) + both
            for j in some[100 * most >= percent * (n[some] + n[i] - most)]:
                if of[i] != of[j] and linked(sets[i], sets[j], percent):
                    out.append((int(components[i]), int(components[j])))
                    of[of == of[j]] = of[i]
    return out


def _settled(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between components in the buckets of (bucket, rep, n, component), see the head of this file."""
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum(F.ceil(F.col("n") / LONG)).alias("weight"))
    sized = counts.groupBy("bucket").agg(F.sum("weight").alias("weight"), F.max(F.struct("weight", "component")).alias("most"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / block)).cast("int")
    sized = sized.select("bucket", F.col("most.component").alias("largest"), blocks(F.col("weight")).alias("bases"), blocks(F.col("weight") - F.col("most.weight")).alias("parts"))
    sized = written(sized, "sized")  # so that a crowded bucket's rows can be split in the join
    placed = members.join(sized, "bucket").withColumn("probe", F.col("component") != F.col("largest"))
    base, part = F.pmod(F.xxhash64("rep"), F.col("bases")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("parts")).cast("int")
    to = lambda p, q: F.struct(p.cast("int").alias("base"), q.cast("int").alias("part"))
    own = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: to(base, q))
    other = F.transform(F.filter(F.sequence(F.lit(0), F.col("bases") - 1), lambda p: p != base), lambda p: to(p, part))
    rows = placed.join(sets, "rep").select("bucket", "component", "shingles", F.when(F.col("probe"), part).alias("probe"), F.explode(F.when(F.col("probe"), F.concat(own, other)).otherwise(own)).alias("to"))
    rows = rows.select("bucket", "to.base", "to.part", "component", (F.col("probe") == F.col("to.part")).alias("probe"), "shingles")
    keys = ["bucket", "base", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for *key, component, probe, raw in zip(*columns, strict=True):
                if key != now:
                    out += _links_of(held, percent)
                    now, held = key, []
                held.append((component, bool(probe), np.frombuffer(raw, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        out = _links_of(held, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def _links_of(held: list[tuple[int, bool, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    return settled(*(list(x) for x in zip(*held, strict=True)), percent) if held else []


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, side: int = SIDE, size: int = TUPLE, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Other columns are left out.

    component_id is the smallest doc_id reachable over links, the row's own included; kept says that it is
    the row's own. Null, empty and wordless texts have no shingles and no links. Rows with one id are one
    node. A row without an id takes no part: its component_id is null and it is kept. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(_sketches(rows, words, side, size), "sketches")
    full = sketches.filter("n > 0 and doc_id is not null")
    # equal sets are one class, named by its smallest id
    classes = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("tuples").alias("tuples"))
    classes = written(classes, "classes")
    named = full.select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", "rep")
    moved = named.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    ties = named.join(moved.filter("low < high").select("doc_id", "low"), "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))

    drawn = classes.select("rep", "n", F.posexplode("tuples").alias("i", "tuple")).select("rep", "n", (F.col("i") < side).alias("left"), F.xxhash64("i", "tuple").alias("tuple"))
    common = drawn.groupBy("tuple").agg(F.count("*").alias("members")).filter("members > 1").select("tuple")
    of = lambda left: F.collect_list(F.when(F.col("left") == left, F.col("tuple")))  # noqa: E731  2 * side at most
    tupled = drawn.join(common, "tuple").groupBy("rep", "n").agg(of(True).alias("lefts"), of(False).alias("rights"))
    tupled = written(tupled.filter((F.size("lefts") > 0) & (F.size("rights") > 0)), "tuples")
    key = F.flatten(F.transform("lefts", lambda x: F.transform("rights", lambda y: F.struct(x.alias("left"), F.xxhash64(x, y).alias("key")))))
    keyed = tupled.select("rep", "n", F.explode(key).alias("k")).select("rep", "n", "k.left", "k.key")
    first_of = F.min(F.struct(F.xxhash64("rep").alias("o"), "rep", "n"))
    shared = keyed.groupBy("key").agg(first_of.alias("pivot"), F.count("*").alias("members")).filter("members > 1").select("key", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n"))
    bucketed = written(keyed.join(shared, "key"), "buckets")
    pairs = bucketed.filter((F.col("rep") != F.col("pivot")) & (F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent))
    pairs = written(pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct(), "pairs")
    # the sets of all classes that share a bucket, made anew from their texts
    wanted = bucketed.select("rep").distinct().join(classes.select("rep", "s1"), "rep")
    sets = written(_sets(rows.join(wanted, rows["doc_id"] == wanted["rep"]).select("rep", "text", "s1"), words), "sets")
    links = written(_confirmed(pairs, sets, percent).union(ties), "links")
    first = components(links)

    label = bucketed.join(first.select(F.col("id").alias("rep"), "component"), "rep", "left").select("left", "key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = label.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    label = written(label.join(mixed, "key", "left_semi"), "labels")
    # a first tuple's bucket, or those of its keys where they make fewer pairs
    coarse = label.select("left", "rep").distinct().groupBy("left").agg(F.count("*").alias("members"))
    fine = label.groupBy("left", "key").agg(F.count("*").alias("k")).groupBy("left").agg(F.sum(F.col("k") * F.col("k")).alias("pairs"))
    by_key = coarse.join(fine, "left").filter((F.col("members") > block) & (F.col("pairs") < F.col("members") * F.col("members"))).select("left", F.lit(True).alias("by_key"))
    by_key = written(by_key, "split")  # so that a crowded tuple's rows can be split in the join
    members = label.join(by_key, "left", "left").select(F.when(F.col("by_key"), F.col("key")).otherwise(F.col("left")).alias("bucket"), "rep", "n", "component").distinct()
    more = components(_settled(written(members, "members"), sets, percent, block)).select(F.col("id").alias("component"), F.col("component").alias("joined"))
    for done in (tupled, bucketed, pairs, sets, links, label, by_key):
        dropped(done)

    found = sketches.join(classes.select("s1", "s2", "rep"), ["s1", "s2"], "left")
    labelled = found.join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(more, "component", "left")
    component = F.when(F.col("n") > 0, F.coalesce("joined", "component")).otherwise(F.col("doc_id"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
