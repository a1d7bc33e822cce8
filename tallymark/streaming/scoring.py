"""Scores of a stream of calls: row by row, with the cluster sizes of a table that is kept beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import signals as S
from tallymark.functions.text import normal_output


def scored_stream(calls: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """calls (a stream or a table) with score and verdict; clusters: (model, out_key, n) of what came before.

    A stream cannot know how often an output will still repeat, so low_output_diversity counts what
    ``clusters`` has and is 0 without it: a batch over everything may score a row up to 0.1 higher.
    """
    prompt, output = F.col("prompt_excerpt"), F.col("output_excerpt")
    rows = calls.withColumn("out_key", normal_output(output))
    n = F.lit(0)
    if clusters is not None:
        rows = rows.join(clusters.select(F.col("model").alias("c_model"), F.col("out_key").alias("c_key"), F.col("n").alias("cluster")), (F.col("model") == F.col("c_model")) & (F.col("out_key") == F.col("c_key")), "left").drop("c_model", "c_key")
        n = F.coalesce("cluster", F.lit(0))
    signals = F.struct(
        S.short_output(F.col("output_tokens"), output).alias("short_output"), S.structured_output(output).alias("structured_output"), S.decision_language(prompt).alias("decision_language"),
        S.question_shape(prompt).alias("question_shape"), S.short_input(F.col("input_tokens"), prompt).alias("short_input"), S.low_diversity(n).alias("low_output_diversity"),
    )
    rows = rows.withColumn("score", S.score(signals, prompt)).withColumn("verdict", F.when((prompt == "") & (output == ""), "insufficient").otherwise(S.verdict(F.col("score"))))
    return rows.select(*calls.columns, "score", "verdict")


def verdicts_by_time(scored: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, verdict, calls) with a watermark: rows later than ``late`` are left out."""
    return scored.withWatermark(time, late).groupBy(F.window(time, window), "verdict").agg(F.sum("weight").alias("calls"))
