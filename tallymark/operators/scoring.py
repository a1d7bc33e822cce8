"""Scores of calls, with what the whole corpus says about repeated outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import signals as S
from tallymark.functions.text import normal_output


def weight() -> Column:
    """A call's weight, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.col("weight"), F.lit(1))).cast("bigint")


def output_clusters(calls: DataFrame) -> DataFrame:
    """(model, out_key, n): weighted calls for each output that is not empty. The key is of bounded length, outputs are clipped."""
    keyed = calls.select("model", normal_output(F.col("output_excerpt")).alias("out_key"), weight().alias("w")).filter("out_key != ''")
    return keyed.groupBy("model", "out_key").agg(F.sum("w").alias("n"))


def duplication(calls: DataFrame) -> DataFrame:
    """(model, total_outputs, dup_rate): the share of outputs that repeat, at three digits, by model."""
    by_model = output_clusters(calls).groupBy("model").agg(F.sum("n").alias("total_outputs"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("d"))
    return by_model.select("model", "total_outputs", F.round(F.col("d") / F.col("total_outputs"), 3).alias("dup_rate")).orderBy("model")


def check_thresholds(likely: float, maybe: float) -> None:
    if not 0 < maybe <= likely <= 1:
        raise ValueError("thresholds have to satisfy 0 < maybe <= likely <= 1")


def with_scores(calls: DataFrame, likely: float = S.LIKELY, maybe: float = S.MAYBE) -> DataFrame:
    """calls with signals, score and verdict.

    Clusters are counted with partial aggregates and joined back, so a single output that most calls give is
    summed where it lies; its rows are then split over tasks by adaptive skew handling.
    """
    check_thresholds(likely, maybe)
    clusters = output_clusters(calls).select(F.col("model").alias("c_model"), F.col("out_key").alias("c_key"), F.col("n").alias("cluster"))
    prompt, output = F.col("prompt_excerpt"), F.col("output_excerpt")
    # what a row shows by itself is told before the join, on the partitions of the scan: those of the join may be few
    own = {
        "short_output": S.short_output(F.col("output_tokens"), output),
        "structured_output": S.structured_output(output),
        "decision_language": S.decision_language(prompt),
        "question_shape": S.question_shape(prompt),
        "short_input": S.short_input(F.col("input_tokens"), prompt),
    }
    rows = calls.withColumn("out_key", normal_output(output)).withColumn("own", F.struct(*(c.alias(n) for n, c in own.items()))).withColumn("factor", S.penalty(prompt, F.col("own.decision_language") > 0))
    rows = rows.join(clusters, (F.col("model") == F.col("c_model")) & (F.col("out_key") == F.col("c_key")), "left")
    found = F.struct(*(F.col(f"own.{n}").alias(n) for n in own), S.low_diversity(F.coalesce("cluster", F.lit(0))).alias("low_output_diversity"))
    rows = rows.withColumn("signals", found).withColumn("score", S.score(F.col("signals"), prompt, F.col("factor")))
    empty = (F.coalesce(prompt, F.lit("")) == "") & (F.coalesce(output, F.lit("")) == "")
    return rows.withColumn("verdict", F.when(empty, "insufficient").otherwise(S.verdict(F.col("score"), likely, maybe))).drop("c_model", "c_key", "cluster", "out_key", "own", "factor")
