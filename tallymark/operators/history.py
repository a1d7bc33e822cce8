"""Prices that hold from a date on: each call takes the newest price of its model that is not later than itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Time that calls and validities are cut into, so that a model's calls meet in many tasks.
BUCKET = "month"


def asof_prices(calls: DataFrame, prices: DataFrame, key: str = "model", time: str = "ts", since: str = "since", bucket: str = BUCKET) -> DataFrame:
    """calls with the columns of the price that holds at their time, nulls where none does yet.

    Each price holds from ``since`` until the next of its key; of two with one key and time the table should have but one, else
    calls meet both. Validities are cut into buckets of time, and a call looks only into its own, by an equi-join: calls are neither
    sorted nor gathered by model, and a model that has most of them is spread over its buckets. The newest price of each key holds
    in all later buckets, as far as there are calls: their last time is one aggregate.
    """
    until = F.lead(since).over(Window.partitionBy(key).orderBy(since))  # a key's prices, not its calls
    held = prices.withColumn("until", until).withColumn("first", F.date_trunc(bucket, since))
    end = F.coalesce(F.date_trunc(bucket, "until"), F.date_trunc(bucket, F.lit(calls.agg(F.max(time)).first()[0]).cast("timestamp")), F.col("first"))
    held = held.withColumn("bucket", F.explode(F.sequence("first", F.greatest("first", end), F.expr(f"interval 1 {bucket}")))).drop("first")
    held = held.withColumnsRenamed({key: "(key)", since: "(since)", "until": "(until)", "bucket": "(bucket)"})
    at = F.col(time)
    fits = (F.col(key) == F.col("(key)")) & (F.date_trunc(bucket, at) == F.col("(bucket)")) & (at >= F.col("(since)")) & (F.col("(until)").isNull() | (at < F.col("(until)")))
    return calls.join(held, fits, "left").drop("(key)", "(until)", "(bucket)").withColumnRenamed("(since)", since)
