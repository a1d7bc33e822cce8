"""The registered queries over the small tables."""

from __future__ import annotations

import re

import oracle
import pytest

from tallymark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_names_and_sql():
    found = Q.queries()
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in found] == list(range(1, 14))
    assert set(Q.oracle_sql()) <= set(found)


def test_url_filters_match_sql(spark):
    assert oracle.difference(Q.queries()["op9_url_filters"](spark, SF).toPandas(), oracle.connect(SF).sql(Q.oracle_sql()["op9_url_filters"]).df()) == ""


COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op5_pii": "doc_id text n_found kinds",
    "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10_html_extraction": "page_id url text n_chars",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = Q.queries()[name](spark, SF)
    assert df.columns == COLUMNS[name].split()
    assert df.count() == spark.read.parquet(f"{SF}/{'pages' if name.startswith('op10') else 'documents'}.parquet").count()


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents.limit(60).union(documents.limit(3))
    for name, stage in C.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns, name
        assert 0 < out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert len({r["doc_id"] for r in docs.collect()}) == docs.count()
    assert C.STAGES[4][1](spark, docs, SF).count() >= docs.count()
