"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

from __future__ import annotations

import collections
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import decontam, graph, htmltext, neardup, packing, pii, records, suffixes, tokens, toxicity, urlrules, vectors

LONG = "A sentence of the text that is long enough to count." * 5
DOCS = "doc_id bigint, text string, score string, found string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no id at all"), (5, "x" * 200_000), (6, "w " * 50_000), (7, "same words here again"), (7, "same words here again"), (8, "same words here again"), (9, "ünï\u00a0cöde\x1cand\x00nul")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


def sentence(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def variants(rng, text, n, changes):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(changes):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def near_by_force(rows, words=2, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = sentence(rng, 120)
    texts = [base, base, *variants(rng, base, 40, 4), *variants(rng, base, 25, 9), *(sentence(rng, rng.randrange(1, 80)) for _ in range(60)), "A b", "a B", "one", None, "", "  "]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows), words=2).collect()}
    assert got == near_by_force(rows)


def test_pipeline_keeps_unlike_texts(spark):
    import corpus_pipeline

    w = [f"w{i}" for i in range(100)]
    near = " ".join("changed" if i in (20, 50, 80) else x for i, x in enumerate(w))  # 0.89 of pairs of words, 0.73 of fives
    rows = [(1, " ".join(w)), (2, near), (7, "one text of this id"), (7, "quite another one here"), (7, "one text of this id")]
    got = corpus_pipeline.without_near_copies(spark, docs(spark, rows), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(set(rows))


def test_near_duplicates_odd(spark):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, ODD), words=2).collect()), key=repr)
    assert len(got) == len(ODD)
    assert (None, 3, None, True) in got and (8, 3, 7, False) in got and got.count((7, 3, 7, True)) == 2 and (1, 0, 1, True) in got and (4, 1, 4, True) in got
    assert neardup.near_duplicates(docs(spark, []), words=2).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_crowded_buckets(spark, block):
    """Far variants of one text share buckets without a link, beside a large group of near copies and two groups that few links connect."""
    rng = random.Random(9)
    base, other = sentence(rng, 150, 10**6), sentence(rng, 150, 10**6)
    texts = [*variants(rng, base, 60, 20), *variants(rng, base, 80, 5), *variants(rng, base, 40, 12), *variants(rng, other, 30, 14), *variants(rng, other, 30, 9)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows), words=2, block=block).collect()}
    want = near_by_force(rows)
    assert len({c for _, c in want.values()}) > 50 and got == want


def test_settled():
    """Blocks connect what links connect, whatever the bounds rule out."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        pool = rng.integers(0, 2**63, 40).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 38), replace=False)) for _ in range(25)]
        names = rng.integers(0, 12, 25).tolist()
        probes = [n != 3 for n in names]

        def closed(pairs):
            up = {n: n for n in names}

            def top(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in pairs:
                up[top(a)] = top(b)
            return {frozenset(n for n in up if top(n) == top(m)) for m in up}

        force = [(names[i], names[j]) for i in range(25) for j in range(25) if probes[i] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        got = neardup.settled(names, probes, sets, 80)
        assert closed(got) == closed(force) and len(got) <= len(set(names))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90}
    assert graph.components(edges.limit(0)).count() == 0


def passages_by_force(rows, least=50):
    words = {i: (t or "").encode().split() for i, t in rows}
    where = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = set()
    for i, w in words.items():
        spans = []
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + least
                else:
                    spans.append([k, k + least])
        out |= {(i, a, b - a) for a, b in spans}
    return out


def test_repeated_passages(spark):
    rng = random.Random(2)
    p, q = sentence(rng, 55, 10**6), sentence(rng, 140, 10**6)
    rows = [(i, " ".join([sentence(rng, rng.randrange(0, 60), 10**6), p if i % 3 == 0 else "", q if i % 4 == 0 else q[: len(q) // 2] if i % 5 == 0 else ""])) for i in range(40)]
    rows += [(50, p), (51, p), (52, "a b " * 200), (53, None), (54, ""), (55, " ".join(p.split()[:49]))]
    got = {(r["doc_id"], r["start"], r["n_words"]) for r in suffixes.repeated_passages(docs(spark, rows)).collect()}
    assert got == passages_by_force(rows)
    assert suffixes.repeated_passages(docs(spark, [])).count() == 0
    assert suffixes.repeated_passages(docs(spark, ODD)).count() == 0
    assert suffixes.without("a  b c\nd e", [(1, 2)]) == "a  d e"


def checked_passages(spark, rows):
    """The spans, and how often each stretch is left without their later parts, once brute force agrees."""
    got = sorted(((r["doc_id"], r["start"], r["n_words"], r["first"], [tuple(x) for x in r["later"]]) for r in suffixes.repeated_passages(docs(spark, rows)).collect()))
    assert {g[:3] for g in got} == passages_by_force(rows) and len({g[:3] for g in got}) == len(got)
    stretches = lambda t: {tuple(w[k : k + 50]) for w in [t.split()] for k in range(len(w) - 49)}
    times = collections.Counter(s for t in {t for _, t in rows} for s in stretches(t))
    kept = []
    for dropped in ({i: [x for g in got if g[0] == i for x in g[4]] for i, _ in rows}, {i: [g[1:3] for g in got if g[0] == i and not g[3]] for i, _ in rows}):
        kept.append(collections.Counter(s for i, t in rows for s in stretches(suffixes.without(t, dropped[i]))))
        assert all(kept[-1][s] for s, n in times.items() if n > 1)
    return got, kept[0]


def test_first_passages_stay(spark):
    rng = random.Random(7)
    a, b, c = (sentence(rng, n, 10**6) for n in (60, 70, 200))
    x, y = variants(rng, c, 2, 1)
    rows = [(1, a), (2, f"{a} {b}"), (3, b), (10, x), (11, c), (12, f"{c} more"), (13, f"{y} words")]
    rows += [(20 + i, t) for i, t in enumerate(variants(rng, sentence(rng, 300, 10**6), 8, 3))]
    got, kept = checked_passages(spark, rows)
    assert [g for g in got if g[0] < 4] == [(1, 0, 60, True, []), (2, 0, 130, True, [(0, 60)]), (3, 0, 70, False, [(0, 70)])]
    assert all(kept[tuple(t.split()[:50])] == 1 for t in (a, b))


def test_passages_of_copied_texts(spark):
    rng = random.Random(8)
    p, q = sentence(rng, 80, 10**6), sentence(rng, 60, 10**6)
    own = [sentence(rng, 70, 10**6) for _ in range(12)]
    texts = [f"{own[0]} {p}", f"{own[1]} {p} {q}", f"{p} {own[2]}", f"{own[3]} {p}", own[4], f"{q} {p}", f"{p} {sentence(rng, 30, 10**6)} {q}", p]
    rows = [(1, f"{own[10]} {p} x"), *((10 * k + i, t) for k, t in enumerate(texts, 1) for i in range(3 if k % 4 else 2)), (200, f"{own[2]} y"), (5, f"{own[11]} {own[4]}")]
    got, kept = checked_passages(spark, rows)
    assert [g[3:] for g in got if g[0] in (10, 30, 50, 80, 81)] == [(True, [(70, 80)]), (True, [(0, 80)]), (False, [(0, 70)]), (False, [(0, 80)]), (False, [(0, 80)])]
    assert all(kept[tuple(t.split()[:50])] == 1 for t in (p, q, *own[:5]))


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["grumblefink", "snotwaffle", "blarghead"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = sentence(rng, rng.randrange(20, 120), 300).split()
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), 1))
    rows += [(1000, "w1 w2 grumblefinks w3 snotwafffle w4 w5 blargheads w6"), (1001, None), (1002, ""), (1003, "w1 w2 w3 w4")]
    d, lab = docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (4, 1, 1)], "doc_id bigint, toxic int, doc int")
    model = toxicity.fit(d, lab)
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", toxicity.scored(d, model).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    out = [i for i, t, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in out]) > 0.95
    assert got[1000] >= 0.5 > got[1003] and got[1001] == got[1002]
    assert d.filter("doc_id is null").count() == 0 and spark.sql("select cast(null as bigint) i").select(toxicity.held_out(F.col("i"))).first()[0] is False
    for few in (lab.limit(0), lab.filter("toxic = 1"), lab.filter("toxic = 0")):  # nothing can be learnt: nothing is rejected
        assert d.select(toxicity.scored(d, toxicity.fit(d, few)).alias("s")).filter("s >= 0.5").count() == 0
    long = docs(spark, [(1, "w1 " * 300_000), (2, "x" * 1_000_000), (None, "w1")])
    assert long.select(toxicity.scored(long, model).alias("s")).filter("s between 0 and 1").count() == 3
    empty = toxicity.fit(d.limit(0), lab)
    assert d.limit(0).select(toxicity.scored(d, empty)).count() == 0


SPECIAL = ["<|endoftext|> a<|endoftext|>b", "x <|startoftext|>y", "<|endoftext|", "a<|EndOfText|>b <|STARTOFTEXT|>"]


def plain(name, texts):
    """The ids of whole texts, straight from the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_token_pieces(name, drops):
    e = tokens.Encoder(tokens.tokenizer_path(name), drops)
    texts = ["", None, "a\x1c b  c\u00a0  d ", "I'm it's don't,. x'S... 'tis 's  ", "  lead  two\n\n x\t\ty ", "é, e\u0301! =\u0338 a.b,c;d x1.5% $$$", "ΑΣ ſ K", "a\nb c\n", "x" * 5000, *SPECIAL]
    rng = random.Random(1)
    bits = [" ", " ", "\n", "\t", "  ", "word", "Ünï", "12", "'s", "'", "!?", "<|", "|>", "<|endoftext|>", "\u2003", "x.", "漢字", "\u0301", "\x85", "«", "—"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)]
    want = [np.array(x, "<u2").tobytes() for x in plain(name, texts)]
    assert e.width == 2 and list(e.encode_all(texts)) == want and list(e.encode_all(texts)) == want
    assert tokens.wide(want[3], 2) == np.array(plain(name, texts[3:4])[0], "<u4").tobytes()


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_each_distinct_piece_is_met_once(name, drops):
    """Python's work follows the distinct words, not the words; words around a comma or dash come from their parts."""
    e = tokens.Encoder(tokens.tokenizer_path(name), drops)
    words = [f"{a}{b}" for a in ("the", "ion", "ver", "Schl", "qu") for b in ("ent", "ing", "A", "x", "ably", "ou")]
    texts = ["", "\n", " ".join(f"{a}{p}{b}" for a in words for b in words for p in ",-_") + "\n" + "again, again\n" * 20_000, None, "\n\nend"]
    calls, asked = collections.Counter(), []
    apart = e.apart
    e.apart = lambda pieces: asked.extend(pieces) or apart(pieces)
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        got = list(e.encode_all(texts))
    finally:
        sys.setprofile(None)
    assert got == [np.array(x, "<u2").tobytes() for x in plain(name, texts)]
    assert len(asked) < 6 * len(words) and calls["c_call"] < 2_000


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_token_pieces_over_groups(name, drops, monkeypatch):
    """Texts that begin and end in spaces, line ends and punctuation, in groups of any size, with a cache that overflows."""
    rng = random.Random(2)
    bits = [" ", "\n", "\n ", "\r\n", "\t", "a", "Zb", "é", "\u0301", "9", ".", "_", "-", "'", "'ll", "'s.", "{", "~", "\x7f", "\x00", "<|endoftext|>", "\u2003", "漢"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(4000)]
    want = [np.array(x, "<u2").tobytes() for x in plain(name, texts)]
    for group, cache in ((1, 10), (50, 100), (10**9, 0)):
        monkeypatch.setattr(tokens, "GROUP", group)
        monkeypatch.setattr(tokens, "CACHE", cache)
        e = tokens.Encoder(tokens.tokenizer_path(name), drops)
        assert list(e.encode_all(texts)) == want and list(e.encode_all(texts[::-1])) == want[::-1]
    assert list(e.encode_all([])) == []


CODED = [*ODD, *((20 + i, t) for i, t in enumerate(SPECIAL)), (30, " ".join(f"Item{i}, {i * 7919}." for i in range(3000)))]


def test_packing(spark):
    assert packing.binary_pieces(2048 + 5) == [(0, 2048), (2048, 4), (2052, 1)] and packing.binary_pieces(0) == []
    with pytest.raises(ValueError):
        packing.binary_pieces(5, 3)
    got = packing.packed(docs(spark, CODED)).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in got}) == len(got)
    for (i, _), ids in zip(CODED, plain(packing.TOKENIZER, [t for _, t in CODED]), strict=True):
        times = sum(i == k for k, _ in CODED)  # a repeated row is packed each time
        pieces = sorted(by_doc[i], key=lambda r: r["start"])[::times]
        assert [r["start"] for r in pieces] == [sum(r["length"] for r in pieces[:k]) for k in range(len(pieces))]
        assert all(r["doc_tokens"] == len(ids) + 1 for r in pieces)
        assert b"".join(r["ids"] for r in pieces) == np.array([*ids, 1], "<u4").tobytes()
    assert packing.packed(docs(spark, [])).count() == 0


def test_records(spark, tmp_path):
    got = records.round_trip(docs(spark, CODED), f"file://{tmp_path}/r", with_ids=True, shards=3).collect()
    got.sort(key=lambda r: r["start"])
    want = sorted(CODED, key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    for r, (i, _), ids in zip(got, want, plain(records.TOKENIZER, [t for _, t in want]), strict=True):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, at, len(ids) + 1, zlib.crc32(raw), raw)
        at += len(ids) + 1
    for width, ids in ((2, b"\x01\0"), (4, b"\x01\0\0\0")):
        raw = records.framed(records.payload_of(3, ids, width))
        assert records.record_at(memoryview(raw), 0)[1].tolist() == [1]
        for k in (0, 9, 14, len(raw) - 1):
            with pytest.raises(ValueError):
                records.record_at(memoryview(raw[:k] + bytes([raw[k] ^ 1]) + raw[k + 1 :]), 0)
    assert records.round_trip(docs(spark, []), f"file://{tmp_path}/e").count() == 0


def test_pseudonyms(spark):
    p = pii.Permutation(b"k")
    assert sorted(p.of(i, 97, "x") for i in range(97)) == list(range(97))
    assert all(p.of(p.of(i, 97, "x"), 97, "x", back=True) == i for i in range(97))
    assert p.text(p.text("aZ9-k", "y"), "y", back=True) == "aZ9-k"
    card, t = "4041 8949 7460 8795", "card 4041894974608795, mail a.b@c.org, ip 42.144.35.254, tel +1 (415) 555-1234, born 1984-02-29 or 3/14/1999, DE89 3704 0044 0532 0130 00, password=b7db7aa4a5fc"
    rows = [(1, t), (2, f"again {card} and a.b@c.org"), (3, None), (4, ""), (5, "Nothing 1.2.3 here, 2019 or 4041894974608796 @home 31.02.2001")]
    got = {r["doc_id"]: r["p"] for r in docs(spark, rows).select("doc_id", pii.pseudonymised(F.col("text"), b"k").alias("p")).collect()}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == rows[4][1] and got[5]["found"] == []
    new = got[1]["text"]
    assert len(new) == len(t) and [f["kind"] for f in got[1]["found"]] == ["card", "email", "address", "phone", "date", "date", "iban", "secret"]
    assert not any(x in new for x in ("4041894974608795", "a.b@c", "42.144", "555-1234", "1984-02-29", "b7db7"))
    spans = [new[f["start"] : f["end"]] for f in got[1]["found"]]
    assert pii.luhn_digit(spans[0][:-1]) == spans[0][-1] and pii.iban_rest(spans[6].replace(" ", "")) == 1
    assert spans[0] == got[2]["text"].split("again ")[1][:19].replace(" ", "") and spans[1] in got[2]["text"]


def test_long_values(spark):
    p = pii.Permutation(b"k")
    long = "aB3" * 333_333
    new = p.text(long, "secret")
    assert new != long and p.text(new, "secret", back=True) == long and p.text(long, "secret") == new
    rows = [(1, f"token={long} and sk-{'k' * 90_000}"), (2, " ".join(f"10.{i % 256}.{i // 256}.7" for i in range(8000))), (3, f"password={long}")]
    got = {r["doc_id"]: r["p"] for r in docs(spark, rows).select("doc_id", pii.pseudonymised(F.col("text"), b"k").alias("p")).collect()}
    assert len(got[1]["found"]) == 2 and len(got[2]["found"]) == 8000 and all(len(got[i]["text"]) == len(t) for i, t in rows)
    assert got[1]["text"].split()[0].removeprefix("token=") == got[3]["text"].removeprefix("password=")
    assert docs(spark, []).select(pii.pseudonymised(F.col("text"), b"k")).count() == 0


def test_session_key(spark):
    spark.conf.unset(pii.KEY_SETTING)
    key = pii.session_key(spark)
    assert len(key) == 64 and pii.session_key(spark) == key
    spark.conf.set(pii.KEY_SETTING, "chosen")
    assert pii.session_key(spark) == b"chosen"


@pytest.mark.parametrize(
    ("kind", "value"),
    [
        ("phone", "+1 (017) 555-7713"), ("phone", "+1 (155) 555-7713"), ("phone", "(017) 555-7713"), ("phone", "017-555-7713"), ("phone", "+49 151 23456789"), ("phone", "+86 138 1234 5678"),
        ("phone", "+55 11 91234-5678"), ("phone", "+39 06 6982 1234"), ("phone", "+44 20 7946 0958"), ("phone", "+4915123456789"), ("phone", "+1 (415) 555-1234"),
        ("address", "248.40.198.62"), ("address", "224.0.0.251"), ("address", "255.255.255.255"), ("address", "127.10.20.30"), ("address", "0.12.34.56"), ("address", "8.88.188.8"), ("address", "100.99.1.10"),
        ("card", "0004049893760018"), ("card", "0404 1894 9746 0877"), ("card", "4041 8949 7460 8795"),
    ],
)
def test_values_of_every_form(kind, value):
    p = pii.Permutation(b"k")
    if kind == "card" and value[0] == "0":
        value = value[:-1] + pii.luhn_digit("".join(c for c in value[:-1] if c.isdigit()))
    text = f"see {value}, please"
    [(start, end, found, new)] = pii.found(text, p)
    if found == "card" and value[0] == "+":  # the digits of this phone pass as a card's
        value = value[1:]
    assert text[start:end] == value and found in (kind, "card") and new != value
    shape = lambda v: "".join("9" if c.isdigit() else c for c in v)
    assert shape(new) == shape(value)
    if kind == "card":
        digits = "".join(c for c in new if c.isdigit())
        assert pii.luhn_digit(digits[:-1]) == digits[-1]
    if kind == "address":
        a, b = (int(v.split(".")[0]) for v in (value, new))
        assert all(int(x) < 256 for x in new.split(".")) and (a >= 224) == (b >= 224) and (a in (0, 127)) == (b in (0, 127))


def test_secrets_after_other_names():
    for text, value in (("Credentials: password=hunter22", "hunter22"), ("https://x.org/?token=abcdef123", "abcdef123"), ('{"api_key" : "abcd1234"}', "abcd1234")):
        assert [(text[a:b], k) for a, b, k, _ in pii.found(text, pii.Permutation(b"k"))] == [(value, "secret")]


def test_values_before_other_numbers():
    p = pii.Permutation(b"k")
    for value, then, kinds in (("+1 (826) 555-4081", " 190.137.223.204", ["phone", "address"]), ("+1 (826) 555-4081", " 2019 12", ["phone"]), ("4041 8949 7460 8795", " 12/27", ["card"])):
        got = pii.found(value + then, p)
        assert [x[2] for x in got] == kinds and got[0][0] == 0 and got[0][1] >= len(value)


def test_pseudonyms_differ():
    p = pii.Permutation(b"k")
    values = [f"9.{i}.7.{j}" for i in range(10) for j in range(10)] + [f"{a}.1.2.3" for a in range(256)]
    assert len({pii.address(p, v) for v in values}) == len(values)
    values = [f"+1 (0{i:02d}) 555-7713" for i in range(100)] + [f"+1 (9{i:02d}) 555-7713" for i in range(100)]
    assert len({pii.phone(p, v) for v in values}) == len(values)


def test_contamination(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, n)) for i, n in enumerate([13, 40, 5, 1, 0, 25])] + [(None, "null id item"), (9, None)]
    items[3] = (3, "zqx")
    rows = []
    for i in range(80):
        t = sentence(rng, rng.randrange(0, 150))
        if i % 3 == 0:
            w = items[rng.choice([0, 1, 2, 3, 5])][1].split()
            t = f"{t}! {' -- '.join(w[: rng.randrange(1, len(w) + 1)]).upper()}. {t}"
        rows.append((i, t))
    rows += [(100, None), (101, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for chars in (10**6, 100):
        got = {r["doc_id"]: r["found"] for r in decontam.contamination(docs(spark, rows), bench, automaton_chars=chars).collect()}
        for i, t in rows:
            w, hit, who = decontam.words_of(t), set(), set()
            for k, u in items:
                for x in decontam.windows_of(decontam.words_of(u)) if k is not None else ():
                    for a in range(len(w) - len(x) + 1):
                        if tuple(w[a : a + len(x)]) == x:
                            hit |= set(range(a, a + len(x)))
                            who.add(str(k))
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(who))
            for s, c in zip(got[i]["words"], got[i]["chars"], strict=True):
                assert decontam.words_of(t[c["start"] : c["end"]]) == w[s["start"] : s["end"]]
    assert decontam.contamination(docs(spark, rows), bench.limit(0)).filter("found.n_hit > 0").count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16)).astype("f4")
    x[100:160] = x[3]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    bad = [(1000, None, ""), (1001, [0.0] * 16, ""), (1002, [float("nan")] * 16, ""), (1003, [], ""), (1004, [None] * 16, ""), (1005, [1.0], ""), (None, [1.0] * 16, ""), (5, x[5].tolist(), "")]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, rank string")
    got = collections.defaultdict(list)
    for r in vectors.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, shard=200, query_block=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 700, 20):
        s = x.astype(float) @ x[q].astype(float)
        want = sorted((-s[i], i) for i in range(700) if i != q)[:20]
        assert len(got[q]) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in got[q]) and [(-v, i) for i, v in got[q]] == sorted((-v, i) for i, v in got[q])
        hits += len({i for i, _ in got[q]} & {i for _, i in want})
    assert set(got) == set(range(0, 700, 20)) and hits / (20 * 35) >= 0.9
    assert vectors.nearest_neighbours(frame.limit(0), F.lit(True)).count() == 0
    assert len(vectors.nearest_neighbours(frame.filter("vec_id < 3"), F.lit(True)).collect()) == 6


def test_recall_of_full_shards(spark):
    """The registered query's parameters over the table at sf0.1: the 20 nearest against all products."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], "f8")
    got = collections.defaultdict(list)
    for r in vectors.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, shard=1000).collect():  # two shards
        got[r["query_id"]].append(r["score"])
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = np.delete(x @ x[q], q)
        hits += sum(v >= np.sort(s)[-20] - 1e-9 for v in got[ids[q]])
    assert hits / (20 * len(got)) >= 0.9


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://M.Example.NET/en/5", "http://example.com/de/?q", "http://x.example.com/de", "http://b.org/fr/a/b", "net/", None, "", "http://net", "x://a.net?/", "http://anet/", "http://a.net//", "http://" + "a." * 300 + "net/" + "b/" * 300]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "again")]
    got = urlrules.url_verdicts(spark.createDataFrame(rows, "page_id bigint, url string, rule string"), urlrules.rules_frame(spark)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    net, none = ("net/", "block"), (None, "allow")
    assert [by[i] for i in range(len(urls))] == [net, ("example.net/en/", "allow"), ("example.com/de/", "block"), none, ("org/fr/", "allow"), none, none, none, none, none, none, net, net]
    assert urlrules.url_verdicts(spark.createDataFrame(rows, "page_id bigint, url string, rule string").limit(0), urlrules.rules_frame(spark)).count() == 0
    with pytest.raises(ValueError):
        urlrules.rules_frame(spark, [("a", "x", "block")])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site head</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Big &amp; bold</h1></header><p>One   two<br>three <b>four</b>.<p>Five &lt;six&gt; &eacute;<script>var x = "<p>";</script></p>
<aside>See also</aside><form>Mail <input></form><div class="ad">Buy</div><p>Last &#8212; one</p></article><section id="comments"><p>%s</p></section><footer>&copy; us</footer></body></html>""" % ("I disagree with it all. " * 40)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Big & bold\nOne two\nthree four.\nFive <six> é\nLast — one"), (None, ""), ("", ""), ("<p>only", "only"), ("a < b and c", "a < b and c"), ("<div>x</div><p>y</p><script>z", "x\ny"),
        ("<article><p>cut here &am", "cut here &am"), ("<article><p>cut tag</p><fo", "cut tag"), ('<article><p title="a>b">t</p></article>', "t"), ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<nav>menu</nav>", ""),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div><p>First half.</p><aside><p>See<p>also<p>this</aside><form>a<br>b<br>c<br>d</form><p>The other half, longer.</p></div></body>", "First half.\nThe other half, longer."),
        ("<body><div><p>First half.</p><aside><p>See<p>also<p>this</aside><p>The other half, longer.</p></div><nav>a<p>b<p>c<p>d</nav><p>End</body>", "First half.\nThe other half, longer.\nEnd"),
        ("<body><div><p>The body of the page, long.</p><p>More of it.</p></div><section><article><h3>Card</h3></article><article>Teaser</article></section></body>", "The body of the page, long.\nMore of it.\nCard\nTeaser"),
        ("<body><p>Chrome</p><article><p>The body of the page.</p></article><p>Chrome</p><article>Next</article></body>", "The body of the page.\nNext"),
        *((f'<body><nav>x</nav>{a}<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{b}<footer>y</footer></body>', f"Title\n{LONG}\n{LONG}") for a, b in (('<form id="aspnetForm">', "</form>"), ('<div class="ad-hoc">', "</div>"), ('<div class="menu-recipes">', "</div>"), ('<div id="menu"><div class="widget">', "</div></div>"))),
        ('<body><form><article><h1>T</h1><p>Short.</p><form><p>field</p></form></article></form></body>', "T\nShort."),
        ("<body><form><p>User</p><p>Password</p></form></body>", ""),
        (f'<body><article><p>{LONG}</p><article class="comment"><p>Nice!</p></article></article><article class="comment-body" id="c1"><p>{LONG}</p></article></body>', LONG),
        (f"<body><div><h1>Title</h1><p>By N. N.</p></div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>End.</p></div></body>", "\n".join(["Title", "By N. N.", *[LONG] * 6, "End."])),
        ("<article><p>Let <math><mi>x</mi></math> be.</p></article>", "Let x be."),
        *((f'<body><div class="{c}"><p>Body text</p><div class="sidebar">no</div></div></body>', "Body text") for c in ("content has-sidebar", "no-sidebar", "with_comments", "content-sidebar-wrap", "sidebar-right", "ad-free", "search-results", "js-nav")),
        *((f'<body><p>Body text</p><div class="x {c}"><p>no</div></body>', "Body text") for c in ("ad", "ad-slot", "cookie-notice", "sidebar", "sidebar__inner", "site-footer", "main_nav", "post-comments", "Related-Posts")),
    ],
)
def test_main_text_of_other_shapes(page, text):
    assert htmltext.main_text(page) == text


def test_surge_and_dive():
    rng = random.Random(6)
    for _ in range(300):
        lengths = [rng.choice([1, 3, 10, 40, 200]) for _ in range(rng.randrange(1, 30))]
        w = htmltext.WINDOW
        windows = {i: sum(lengths[i : i + w]) for i in range(len(lengths)) if i == 0 or i + w <= len(lengths)}
        least = min(htmltext.SURGE, htmltext.SHARE * max(windows.values()))
        inside = {k for i, n in windows.items() if n >= least for k in range(i, min(i + w, len(lengths)))}
        assert htmltext.surge_and_dive(lengths) == (min(inside), max(inside) + 1)
    menu = [f"Item {i}" for i in range(12)]
    body = ["A heading", *("A sentence of the text that goes on for a while, as such do." for _ in range(6))]
    page = "<body>" + "".join(f"<div>{t}</div>" for t in [*menu, *body, *menu]) + "</body>"
    kept = htmltext.main_text(page).split("\n")
    assert [x for x in kept if x not in menu] == body and len(kept) < len(body) + 2 * htmltext.WINDOW


def test_long_pages(spark):
    rows = [(i, "u", t, "") for i, t in enumerate(["<article>" + "<p>word " * 100_000, "<div>" * 50_000 + "x", "a<" * 200_000, "<p class='" + "y " * 300_000 + "'>z"])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r["n_chars"] for r in htmltext.extract_pages(pages).collect()}
    assert got[0] == 500_000 - 1 and got[1] == 1 and got[3] == 1 and len(got) == 4
    assert htmltext.extract_pages(pages.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "u", "<article><p>a\u00e9</p></article>", "clash"), (1, "u", None, ""), (None, None, "", "")]
    got = htmltext.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("", 0), ("aé", 2)]
