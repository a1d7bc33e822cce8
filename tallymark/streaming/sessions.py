"""Sessions of calls: stretches of one key without a longer gap than allowed, over a table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call_sessions(calls: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str | None = None, once: list[str] | None = None) -> DataFrame:
    """(key, began, ended, calls, weight) of each session; it ends ``gap`` after its last call.

    ``late`` sets a watermark, which a stream needs to close sessions; rows later than that are left out. ``once`` names the
    columns that make two rows the same call, of which one counts: in a stream within the watermark.
    """
    if late:
        calls = calls.withWatermark(time, late)
    if once:
        calls = calls.dropDuplicatesWithinWatermark(once) if calls.isStreaming else calls.dropDuplicates(once)
    size: Column = F.greatest(F.lit(1), F.coalesce(F.col("weight"), F.lit(1))) if "weight" in calls.columns else F.lit(1)
    found = calls.groupBy(key, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("calls"), F.sum(size).cast("bigint").alias("weight"))
    return found.select(key, F.col("session.start").alias("began"), F.col("session.end").alias("ended"), "calls", "weight")
