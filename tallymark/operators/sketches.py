"""Counts of distinct outputs and quantiles of probabilities from sketches that are stored by day and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import normal_output
from tallymark.operators.scoring import weight

#: Size of a distinct sketch as a power of two; its relative standard error is 1.04 / sqrt(2 ** LOG).
LOG = 14
#: Size of a quantile sketch; a rank is off by about 0.5 % of all values.
K = 400


def distinct_error(log: int = LOG) -> float:
    """Relative error that an estimate stays under in all but about three of a thousand cases."""
    return 3 * 1.04 / 2 ** (log / 2)


def daily_sketches(calls: DataFrame, day: Column, log: int = LOG, k: int = K) -> DataFrame:
    """(model, day, calls, outputs, tokens): a distinct sketch of outputs that are not empty and a quantile sketch of output tokens.

    Rows of this table add up: a day is computed once and kept, whatever is asked later.
    """
    out = normal_output(F.col("output_excerpt"))
    return calls.groupBy("model", day.alias("day")).agg(F.sum(weight()).alias("calls"), F.hll_sketch_agg(F.when(out != "", out), F.lit(log)).alias("outputs"), F.kll_sketch_agg_bigint("output_tokens", F.lit(k)).alias("tokens"))


def merged(sketches: DataFrame, *by: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(by, calls, distinct_outputs, one column for each quantile of output tokens) over any days and models."""
    rows = sketches.groupBy(*by).agg(F.sum("calls").alias("calls"), F.hll_union_agg("outputs").alias("o"), F.kll_merge_agg_bigint("tokens").alias("t"))
    some = F.kll_sketch_get_n_bigint("t") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_bigint("t", F.lit(q))).alias(f"p{round(q * 100)}") for q in quantiles]
    return rows.select(*by, "calls", F.hll_sketch_estimate("o").alias("distinct_outputs"), *at)
