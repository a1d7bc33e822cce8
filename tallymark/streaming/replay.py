"""A second answer beside each logged call, as both arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import normal_output


def shadow_replay(calls: DataFrame, answers: DataFrame, time: str = "ts", limit: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(call_id, model, ts, output, answer, delay_ms, agrees): each call with the answer that another model gave within ``limit`` after it.

    calls has call_id, model, output_excerpt and the time; answers has call_id, answer and the time. Over streams both have a watermark
    of ``late``: a call waits no longer than the limit and the watermark, and then comes out with nulls; rows that arrive later than
    the watermark are left out. An answer without a call is dropped, one that comes before its call too. Outputs are compared in their normal form.
    """
    left = calls.select("call_id", "model", F.col(time).alias("ts"), F.col("output_excerpt").alias("output"))
    right = answers.select(F.col("call_id").alias("a_call"), "answer", F.col(time).alias("a_ts"))
    if calls.isStreaming:
        left, right = left.withWatermark("ts", late), right.withWatermark("a_ts", late)
    near = (F.col("call_id") == F.col("a_call")) & (F.col("a_ts") >= F.col("ts")) & (F.col("a_ts") <= F.col("ts") + F.expr(f"interval {limit}"))
    rows = left.join(right, near, "leftOuter")
    return rows.select("call_id", "model", "ts", "output", "answer", (F.unix_millis("a_ts") - F.unix_millis("ts")).alias("delay_ms"), (normal_output(F.col("output")) == F.when(F.col("answer").isNotNull(), normal_output(F.col("answer")))).alias("agrees"))
