"""The operators of this folder as queries over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import alignment, decontam, htmltext, mixing, neardup, packing, pii, records, runs, suffixes, toxicity, urlrules, vectors
from tallymark.llm.common import prepared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    score = toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


#: The contract of op2: shingles of two words.
OP2_WORDS = 2


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=OP2_WORDS)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(_table(spark, sf_dir, "documents"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", pii.pseudonymised(F.col("text"), pii.session_key(spark)).alias("p"))
    return docs.select("doc_id", "p.text", F.size("p.found").cast("bigint").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("p.found.kind")), ",").alias("kinds"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontam.contamination(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), decontam.is_contaminated("found").alias("contaminated"),
    )


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(_table(spark, sf_dir, "documents"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.url_verdicts(_table(spark, sf_dir, "pages"), urlrules.rules_frame(spark))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_minhash, op3_packing, op4_suffixes, op5_pii, op6_decontamination, op7_records, op8_vectors, op9_url_filters, op10_html_extraction, op11_periodic_runs, op12_mixing, op13_alignment)
    return {f.__name__: lambda spark, sf_dir, f=f: f(prepared(spark), sf_dir) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filters": urlrules.ORACLE}
