"""A corpus from raw documents to packed token ids, in five stages of ``tallymark.llm`` operators.

Each stage takes the documents that the one before kept; results go through Parquet in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontam, neardup, packing, pii, toxicity
from tallymark.llm.common import prepared, written

#: Not expressible in SQL: the first stage scores with a model that it trains.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. The model learns from labels of rows that are not held out.

    Without labels of both kinds all documents stay. Null and empty texts score as texts without words; rows
    with a null or repeated id are judged like others; an empty table stays empty.
    """
    prepared(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.scored(docs, model) < toxicity.THRESHOLD)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; of rows with one id and one text, one. Shingles have five words."""
    prepared(spark)
    kept = neardup.near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    one = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    repeated = one.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if not repeated.isEmpty():
        several = one.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        one = one.join(repeated, "doc_id", "left_anti").unionByName(several)
    return one.unionByName(docs.filter("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule clears."""
    prepared(spark)
    found = "contamination of the text"
    marked = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col=found)
    return marked.filter(~decontam.is_contaminated(f"`{found}`")).drop(found)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms of the same length. Null and empty texts stay what they are."""
    prepared(spark)
    return docs.withColumn("text", pii.pseudonymised(F.col("text"), pii.session_key(spark))["text"])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in pieces of power-of-two lengths, each with its ids. A null or empty text is the end id alone."""
    prepared(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
