"""Toxicity: held-out rows of a given table, a brute-force score, and what few or noisy labels teach."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallymark.llm import queries as Q
from tallymark.llm import toxicity

SF = "/root/testdata/sf0.01"
#: Words that only toxic rows of the training part have.
PLAIN = {"trash", "pathetic", "worthless", "idiot", "disgusting", "loser", "scum", "clown", "moron", "stupid"}


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.queries()["op1_toxicity"](spark, SF).join(docs.select("doc_id", "text"), "doc_id").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return rows.toPandas()


def test_held_out_rows(judged):
    """No clean row held out is rejected, and every toxic one with a plain toxic word is."""
    rows = judged[judged["held_out"] & judged["toxic"].notna()]
    plain = np.array([bool(PLAIN & set(toxicity.words_of(t))) for t in rows["text"]])
    toxic = rows["toxic"].to_numpy() == 1
    assert (toxic & plain).sum() >= 4 and len(rows) > 50
    assert rows["predicted"].to_numpy()[toxic & plain].all()
    assert rows["predicted"].to_numpy()[~toxic].sum() == 0


def test_scores_by_force():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 40))) + " grumblefink" * (i % 3 == 0) for i in range(120)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(120)])
    scorer = model.collapsed()
    for text in [*texts[:10], "grumblefinks w1 w2", "", None, "unknown words only"]:
        words = sorted(set((text or "").lower().split()))
        vectors = [np.mean([model.table[s] for s in toxicity.slots_of(w)], axis=0) for w in words]
        hidden = np.sum(vectors, axis=0) / len(words) ** toxicity.POWER if words else np.zeros(model.table.shape[1])
        z = hidden @ model.softmax + model.bias
        want = np.exp(z[1]) / np.exp(z).sum()
        assert scorer.score(text) == pytest.approx(want, abs=1e-4)
    assert scorer.score("w1 grumblefimk w2") > 0.5 > scorer.score("w1 w3 w2")


def test_single_texts_are_not_learnt():
    """Labels that no word goes with leave every slot without a vector."""
    rng = random.Random(6)
    texts = [" ".join(f"x{rng.randrange(10**9)}" for _ in range(50)) for _ in range(100)]
    model = toxicity.train(texts, [i % 2 for i in range(100)])
    assert not model.table.any() and np.array_equal(model.bias, toxicity.UNTAUGHT)
    few = toxicity.train(["bad word"] * 4 + ["good one"] * 4, [1] * 4 + [0] * 4)
    assert not few.table.any() and few.collapsed().score("bad word") < 0.5
    enough = toxicity.train(["bad word"] * 10 + ["good one"] * 10, [1] * 10 + [0] * 10)
    assert enough.collapsed().score("bad word") > 0.5 > enough.collapsed().score("good one")


def test_telling_slots():
    texts_of = np.array([[0, 3, 50, 0, 0], [90, 0, 50, 4, 0]])
    assert toxicity.telling(texts_of, np.array([1000, 100])).tolist() == [True, False, True, True, False]
    assert not toxicity.telling(texts_of, np.array([1000, 0])).any()


def test_stage_drops_rejected_rows(spark):
    import corpus_pipeline as C

    name, stage = C.STAGES[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = {r["doc_id"] for r in Q.op1_toxicity(spark, SF).filter("predicted = 1").select("doc_id").collect()}
    kept = stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - scored
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b")], "doc_id bigint, text string, score string")
    assert stage(spark, odd, SF).count() == 3 and stage(spark, odd.limit(0), SF).count() == 0
