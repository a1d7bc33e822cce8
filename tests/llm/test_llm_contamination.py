"""The registered decontamination query, column by column, against windows looked up in a dictionary."""

from __future__ import annotations

import hashlib
import re

from tallymark.llm import queries as Q

SF = "/root/testdata/sf0.001"
WINDOW = 13
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def by_force(documents, items):
    holders = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            holders.setdefault(tuple(w[i : i + WINDOW]), set()).add(str(item))
    lengths = sorted({len(k) for k in holders})
    for doc_id, text in documents:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if who := holders.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= who
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def test_whole_query(spark):
    documents = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(by_force(documents, items))
    got = sorted(tuple(r) for r in Q.op6_decontamination(spark, SF).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == want
    assert any(r[5] for r in want) and any(not r[2] for r in want)
