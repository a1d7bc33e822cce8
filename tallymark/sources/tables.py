"""Calls and decisions made of the standard tables, so that every operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Models of the event calls, by user; some are unknown to the price table.
MODELS = ["gpt-4o", "openai/gpt-4o-mini-2024-07-18", "gpt-4.1", "gpt-4.1-mini", "gpt-4.1-nano", "o3-mini", "o4-mini", "claude-3-5-haiku-20241022", "claude-3-5-sonnet", "claude-3-7-sonnet-latest", "claude-sonnet-4-20250514", "claude-opus-4", "mystery-1", "Local/Tiny"]
#: Prompts of the event calls, by type; any other type asks for a story.
PROMPTS = {
    "view": "Classify this page view as relevant or not.",
    "signup": "Is this signup spam? Answer yes or no",
    "click": "Rate the intent of this click from 1 to 500",
    "error": "Summarize the error below for the team.",
    "purchase": "Does this purchase look like fraud?",
}
OTHER_PROMPT = "Write a story about this event."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chosen(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def calls_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for each event: prompt by type, output the type, the properties or the value, model by user."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    prompt = F.lit(OTHER_PROMPT)
    for kind, text in PROMPTS.items():
        prompt = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(prompt)
    output = F.when(i % 3 == 0, F.col("event_type")).when(i % 3 == 1, F.col("props")).otherwise(F.floor("value").cast("string"))
    return e.select(
        i.cast("string").alias("call_id"), F.concat(F.lit("events#L"), i.cast("string")).alias("source"), F.lit("generic").alias("format"), _chosen(MODELS, F.col("user_id") % len(MODELS)).alias("model"),
        F.when(i % 7 != 0, 20 + i % 3000).alias("input_tokens"), F.when(i % 5 != 0, i % 150).alias("output_tokens"), prompt.alias("prompt_excerpt"), output.alias("output_excerpt"),
        F.when(i % 4 == 0, F.floor("value") / 1000).alias("logged_cost_usd"), F.lit(None).cast("string").alias("timestamp"), (1 + i % 3).alias("weight"), i.alias("ordinal"),
    )


def calls_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows without text: line items by flag, status and month of shipping."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    rows = t.agg(F.count("*").alias("n"), F.sum(F.floor("l_extendedprice").cast("bigint")).alias("cents"), F.sum(F.floor("l_quantity").cast("bigint")).alias("q"))
    key = F.concat_ws("-", "l_returnflag", "l_linestatus", "month")
    return rows.select(
        key.alias("call_id"), F.concat(F.lit("usage#"), key).alias("source"), F.lit("generic").alias("format"), F.concat(F.lit("gpt-4o-"), F.lower("l_returnflag")).alias("model"),
        F.col("q").alias("input_tokens"), F.col("n").alias("output_tokens"), F.lit("").alias("prompt_excerpt"), F.lit("").alias("output_excerpt"), (F.col("cents") / 1e6).alias("logged_cost_usd"),
        F.col("month").alias("timestamp"), F.col("n").alias("weight"), F.lit(0).cast("bigint").alias("ordinal"),
    )


def calls_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yes-or-no question for each labelled document."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(
        F.col("doc_id").cast("string").alias("call_id"), F.concat(F.lit("labels#L"), F.col("doc_id").cast("string")).alias("source"), F.lit("generic").alias("format"), F.lit("gpt-4o-mini").alias("model"),
        F.lit(None).cast("bigint").alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"), F.concat(F.lit("Is this document toxic? Answer yes or no: "), F.col("text")).alias("prompt_excerpt"),
        F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("output_excerpt"), F.lit(None).cast("double").alias("logged_cost_usd"), F.lit(None).cast("string").alias("timestamp"), F.lit(1).cast("bigint").alias("weight"), F.col("doc_id").alias("ordinal"),
    )


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it."""
    c = table(spark, sf_dir, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return user.join(reply, ["conv_id", "turn"])


def decisions_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each event: p from the value, right for four ids in five."""
    i = F.col("event_id")
    p = F.least(F.floor("value") / 500, F.lit(1.0))
    return table(spark, sf_dir, "events").select(p.alias("p"), (i % 5 != 0).alias("correct"), F.lit("events").alias("model"), F.col("event_type").alias("question"), i.alias("ordinal"))


def decisions_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each labelled document: p from the id, right where the quality is 1."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select((0.5 + (F.col("doc_id") * 7919 % 500) / 1000).alias("p"), (F.col("quality") == 1).alias("correct"), F.lit("labels").alias("model"), F.col("lang").alias("question"), F.col("doc_id").alias("ordinal"))
