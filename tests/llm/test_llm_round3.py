"""Periodic runs, mixing and alignment against brute force, over small and odd tables and as registered queries."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import alignment, mixing, runs
from tallymark.llm import queries as Q
from tallymark.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, source string, score string, found string"
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (None, "no id at all", None), (None, "no other id", "é"), (5, "x" * 20_000, "c"), (6, "w " * 5_000, "\U0001f642"), (7, "same words here again", "b"), (7, "same words here again", "b"), (7, "other words", "￿"), (8, "same words here again", ""), (9, "ünï cöde\x1cand\x00nul", "c"), (10, "low▁line", "c"), (11, "<|endoftext|> </s>  a\r\n\r\n b ​ c", "b"), (12, "a b " * 40 + "c", "b")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], COLUMNS)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def runs_by_force(s, times=4, least=6):
    out = set()
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            a = i
            while i + p < len(s) and s[i] == s[i + p]:
                i += 1
            if i > a and i - a + p >= max(least, times * p):
                out.add((a, i - a + p, p))
            i += 1
    return sorted(r for r in out if not any(s[r[0] : r[0] + r[1] - q] == s[r[0] + q : r[0] + r[1]] for q in range(1, r[2])))


def test_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        n, k = rng.randrange(0, 100), rng.choice([1, 2, 3, 6])
        s = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            root, a, m = [rng.randrange(k + 1) for _ in range(rng.randrange(1, 9))], rng.randrange(n), rng.randrange(1, 60)
            s[a : a + m] = (root * 60)[:m]
        for times in (2, 4):
            assert runs.runs_of(np.array(s, np.int64), times) == runs_by_force(s, times)


def test_runs_of_long_texts_and_hash_collisions(monkeypatch):
    rng = random.Random(3)
    root = [rng.randrange(50) for _ in range(2500)]
    s = [99, *(root * 6), 98] + [7] * 30_000
    assert runs.runs_of(np.array(s, np.int64)) == [(1, 15_000, 2500), (15_002, 30_000, 1)]
    t = ([1, 2] * 40 + [3]) * 30
    expected = runs_by_force(t)
    asked = []

    class Colliding(runs.Sequence):
        """With the first base, all stretches have one hash."""

        def same(self, i, j, length):
            asked.append(self.base)
            return True if self.base == runs._BASE else super().same(i, j, length)

    monkeypatch.setattr(runs, "Sequence", Colliding)
    assert runs.runs_of(np.array(t, np.int64)) == expected
    assert len(set(asked)) > 1


def run_row(doc, text, plant):
    w = words_of(text)
    n = len(w)
    if plant and doc is not None and n and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = runs_by_force(w)
    gone = {i for a, m, p in found for i in range(a + p, a + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *shown, hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_periodic_runs_of_odd_rows(spark):
    assert rows_of(runs.periodic_runs(table(spark, ODD))) == sorted((run_row(i, t, False) for i, t, _ in ODD), key=repr)
    assert runs.periodic_runs(table(spark, [])).count() == 0
    r = runs.periodic_runs(table(spark, [(12, "a b " * 40 + "c", "b")]), details=True).first()
    assert (r["runs"][0].asDict(), r["collapsed"]) == ({"start": 0, "length": 80, "period": 2}, "a b c")
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(9, np.int64), 1)


def test_op11_query(spark):
    got = rows_of(Q.queries()["op11_periodic_runs"](spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((run_row(r[0], r[1], True) for r in docs), key=repr)
    assert sum(r[1] for r in got) > 0


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        rest, w = total - sum(out.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > most * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / w for s in open_}
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def check_mix(rows, docs):
    size = collections.Counter()
    for _, t, s in docs:
        size[s] += len(words_of(t))
    goal = mix_targets(size)
    source = collections.defaultdict(set)
    for i, t, s in docs:
        source[i, len(words_of(t))].add(s)
    assert len(rows) == len(docs)
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=repr) == sorted(((i, len(words_of(t))) for i, t, _ in docs), key=repr)
    taken, edge = collections.Counter(), collections.Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = next((x for x in source[r["doc_id"], r["size"]] if size[x] == r["source_size"]))
        assert r["target"] == pytest.approx(goal[s])
        key = (r["source_size"], round(r["target"], 6))
        taken[key] += r["taken"]
        edge[key] += r["size"] > 0 and r["taken"] % r["size"] > 0
    wanted = collections.Counter()
    for s in size:
        wanted[size[s], round(goal[s], 6)] += goal[s]
    for key, t in wanted.items():
        assert abs(taken[key] - t) < 4, key


def test_mixing(spark):
    rng = random.Random(5)
    docs = ODD + [(100 + i, "w " * rng.choice([0, 1, 3, 40, 900]), rng.choice("aaaaaabbcd") + rng.choice(["", "x"])) for i in range(600)]
    df = table(spark, docs)
    rows = mixing.mixed(df).collect()
    check_mix(rows, docs)
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.mixed(table(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mixed(table(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]
    assert sum(r["taken"] for r in mixing.mixed(table(spark, [(1, "a b c", "s"), (2, "d", "s"), (3, "e f", "s")])).collect()) == 9
    with pytest.raises(ValueError):
        mixing.targets(df.select("source", F.lit(1).alias("source_size")), weights=(0,))


def test_mixing_is_nested(spark):
    """A larger share takes of every document at least as many words."""
    docs = table(spark, [(i, "w " * (1 + i % 50), "ab"[i % 5 == 0]) for i in range(500)])
    few, many = ({r["doc_id"]: r["taken"] for r in mixing.mixed(docs, share=s).collect()} for s in (0.3, 0.8))
    assert all(few[i] <= many[i] for i in few) and sum(few.values()) < sum(many.values())


def test_op12_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    check_mix(Q.queries()["op12_mixing"](spark, SF).collect(), docs)


def alignment_by_force(docs):
    p = alignment.pair(tokenizer_path(alignment.FIRST), tokenizer_path(alignment.SECOND))
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.SECOND))
    count, kept = collections.Counter(), []
    for i, text in docs:
        links, shown, n = [], [], (0, 0)
        if text:
            a, b = p.a.encode(" " + text, add_special_tokens=False).ids, plain.encode(text)
            xs, ys = [p.a_bytes[x] for x in a], [p.b_bytes[y] for y in b]
            if b"".join(xs) == (" " + text).encode() == b"".join(ys):
                n = len(a), len(b)
                ea, eb = list(itertools.accumulate(map(len, xs))), list(itertools.accumulate(map(len, ys)))
                before = (0, 0)
                for e in sorted(set(ea) & set(eb)):
                    at = ea.index(e) + 1, eb.index(e) + 1
                    links.append((a[at[0] - 1], b[at[1] - 1]))
                    shown.append(",".join(map(str, a[before[0] : at[0]])) + "|" + ",".join(map(str, b[before[1] : at[1]])))
                    before = at
        count.update(links)
        kept.append((i, n, links, ";".join(shown)))
    best = collections.Counter()
    for (_, b), c in count.items():
        best[b] = max(best[b], c)
    out = [(i, *n, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if links else "") for i, n, links, s in kept]
    return sorted(out, key=repr)


def test_alignment_of_odd_rows(spark):
    rng = random.Random(2)
    pieces = ["a", "b ", "  ", "\n", "\t", "\r", ".", "don't", "é", "日本", "\U0001f642", " ", " ", "​", "▁", "<|endoftext|>", "<0x41>", "</s>", "\x00", " the", "123"]
    docs = ODD + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40))), "s") for i in range(400)]
    for chunk in (alignment.CHUNK, 200):
        assert rows_of(alignment.aligned(table(spark, docs), chunk=chunk)) == alignment_by_force([(i, t) for i, t, _ in docs])
    assert alignment.aligned(table(spark, [])).count() == 0
    assert alignment.aligned(table(spark, [(1, "a b", "s")]), details=True).first()["groups"].count("|") == 2


def test_op13_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(Q.queries()["op13_alignment"](spark, SF)) == alignment_by_force(docs)
