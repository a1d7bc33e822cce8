"""Registered queries, column by column, against brute force over the whole given table, and the pipeline stage by stage."""

from __future__ import annotations

import collections
import html
import math
import re
import zlib

import numpy as np
import pytest
from test_llm_contamination import by_force as contaminated_by_force
from test_llm_operators import ODD, near_by_force, passages_by_force, plain

from tallymark.llm import pii, toxicity
from tallymark.llm import queries as Q

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_op2_query(spark, texts):
    want = near_by_force(texts)
    got = [tuple(r) for r in Q.queries()["op2_minhash"](spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got) == sorted((i, n, top, i == top) for i, (n, top) in want.items())
    assert any(i != top for i, (_, top) in want.items())


def test_op3_query(spark, texts):
    ids_of = {i: [*ids, 1] for (i, _), ids in zip(texts, plain("word_bpe_49k.json", [t for _, t in texts]), strict=True)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in Q.queries()["op3_packing"](spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids_of)
    for i, ids in ids_of.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part), len(ids)) and len(part) == 4 * r["length"]
            at += r["length"]
        assert at == len(ids)
    for held in sequences.values():  # gapless from 0, at most 2048, a power of two, so without padding
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        total = sum(n for _, n in held)
        assert total <= 2048 and total & (total - 1) == 0


def test_op4_query(spark, texts):
    got = [(r["doc_id"], r["start"], r["n_words"]) for r in Q.queries()["op4_suffixes"](spark, SF).collect()]
    want = passages_by_force(texts)
    assert len(got) == len(want) > 0 and set(got) == want


def test_op5_query(spark, texts):
    """Row by row what the plain functions give; outside the values found, no character moves or changes."""
    p = pii.Permutation(pii.session_key(spark))
    rows = {r["doc_id"]: r for r in Q.queries()["op5_pii"](spark, SF).collect()}
    assert set(rows) == {i for i, _ in texts}
    for i, t in texts:
        spans, image = pii.found(t, p), rows[i]["text"]
        assert rows[i]["n_found"] == len(spans) and rows[i]["kinds"] == ",".join(sorted({k for _, _, k, _ in spans}))
        assert len(image) == len(t)
        at = 0
        for start, end, _, new in [*spans, (len(t), len(t), "", "")]:
            assert image[at:start] == t[at:start] and image[start:end] == new
            at = end
    assert any(r["n_found"] for r in rows.values())


def test_op10_query(spark):
    """The given pages hold their text in one article of headings, paragraphs and line breaks."""
    for r in Q.queries()["op10_html_extraction"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br|div|ul|li|h2|blockquote|pre)\b[^>]*>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]), r["page_id"]


def test_op7_query(spark, texts):
    want, at = [], 0
    ordered = sorted(texts)
    for (i, _), ids in zip(ordered, plain("byte_bpe_50k.json", [t for _, t in ordered]), strict=True):
        want.append((i, at, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        at += len(ids) + 1
    got = Q.queries()["op7_records"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_op8_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], "f8")
    at = {i: k for k, i in enumerate(ids.tolist())}
    got = collections.defaultdict(list)
    for r in Q.queries()["op8_vectors"](spark, SF).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = ids[ids % 20 == 0].tolist()
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        s = x @ x[at[q]]
        found = sorted(got[q])
        k = min(20, len(ids) - 1)
        assert [r for r, _, _ in found] == list(range(1, k + 1)) and q not in {i for _, i, _ in found}
        assert all(math.isclose(v, s[at[i]], abs_tol=1e-12) for _, i, v in found)
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
        want = sorted((-s[at[i]], i) for i in ids.tolist() if i != q)[:k]
        hits += len({i for _, i, _ in found} & {i for _, i in want})
    assert hits >= 0.95 * 20 * len(asked)


def test_pipeline_by_force(spark):
    """run() over a given table: each stage redone by brute force over all rows that the one before kept."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rejected = {r["doc_id"] for r in docs.filter(toxicity.scored(docs, model) >= toxicity.THRESHOLD).select("doc_id").collect()}
    kept = [tuple(r) for r in docs.select("doc_id", "text").collect() if r["doc_id"] not in rejected]
    tops = near_by_force(kept, words=5)
    kept = [(i, t) for i, t in kept if tops[i][1] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in contaminated_by_force(kept, items) if r[5]}
    kept = [i for i, _ in kept if i not in dirty]
    got = collections.defaultdict(list)
    for r in C.run(spark, SMALL).collect():
        got[r["doc_id"]].append(r)
    assert sorted(got) == sorted(kept) and dirty
    for i, pieces in got.items():
        pieces.sort(key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"], i
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in pieces)


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, number):
    """Null ids and texts, repeated rows, empty and long texts, clashing columns, an empty table."""
    import corpus_pipeline as C

    name, stage = C.STAGES[number]
    odd = spark.createDataFrame([(i, t, "clash", 1, "clash", "clash") for i, t in ODD], "doc_id bigint, text string, score string, length int, kept string, found string")
    out = stage(spark, odd, SMALL)
    assert stage(spark, odd.limit(0), SMALL).count() == 0
    ids = sorted((r["doc_id"] for r in out.select("doc_id").distinct().collect()), key=lambda i: (i is None, i or 0))
    want = sorted({i for i, _ in ODD}, key=lambda i: (i is None, i or 0))
    if name == "near-duplicates":
        want.remove(8)  # the text of document 7
    assert ids == want
    if number < 4:
        assert out.columns == odd.columns and out.count() == (len(ODD) if name != "near-duplicates" else len(ODD) - 2)
