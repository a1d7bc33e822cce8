"""Whether stated probabilities can be trusted: bins, calibration errors, risk against coverage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import staged

#: Coverages that the table shows.
LEVELS = [0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0]
#: Points that a thinned curve has, about.
POINTS = 60


def check_bins(bins: int) -> None:
    if not 2 <= bins <= 50:
        raise ValueError("bins have to be 2 to 50")


def _binned(decisions: DataFrame, bins: int) -> DataFrame:
    check_bins(bins)
    return decisions.withColumn("bin", F.least(F.floor(F.col("p") * bins).cast("int"), F.lit(bins - 1))).withColumn("y", F.col("correct").cast("int"))


def reliability_bins(decisions: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, lo, hi, n, conf, acc, gap, abs_gap); empty bins have zeros."""
    found = _binned(decisions, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))
    every = decisions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    rows = every.join(found, "bin", "left").select("bin", (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("conf", F.lit(0.0)).alias("conf"), F.coalesce("acc", F.lit(0.0)).alias("acc"))
    return rows.withColumn("gap", F.col("acc") - F.col("conf")).withColumn("abs_gap", F.abs("gap")).orderBy("bin")


def summary(decisions: DataFrame, bins: int = 10) -> DataFrame:
    """One row: n, accuracy, avg_p, ece, mce, brier, model of the first decision."""
    b = reliability_bins(decisions, bins).agg(
        F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("abs_gap")), F.sum("n")), F.lit(0.0)).alias("ece"), F.coalesce(F.max(F.when(F.col("n") > 0, F.col("abs_gap"))), F.lit(0.0)).alias("mce")
    )
    y = F.col("correct").cast("double")
    t = decisions.agg(F.count("*").alias("n"), F.coalesce(F.avg(y), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg("p"), F.lit(0.0)).alias("avg_p"), F.coalesce(F.avg(F.pow(F.col("p") - y, F.lit(2.0))), F.lit(0.0)).alias("brier"), F.min_by("model", "ordinal").alias("model"))
    return t.join(F.broadcast(b))  # two single rows


def groups(decisions: DataFrame, bins: int = 10) -> DataFrame:
    """(question, n, accuracy, ece, avg_p), most decisions first; an empty question is ``(unlabeled)``."""
    q = F.when(F.coalesce(F.col("question"), F.lit("")) == "", "(unlabeled)").otherwise(F.col("question"))
    parts = _binned(decisions, bins).groupBy(q.alias("question"), "bin").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.min("ordinal").alias("first"))
    rows = parts.groupBy("question").agg(F.sum("n").alias("n"), (F.sum("sy") / F.sum("n")).alias("accuracy"), (F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece"), (F.sum("sp") / F.sum("n")).alias("avg_p"), F.min("first").alias("first"))
    return rows.orderBy(F.desc("n"), "first").drop("first")


def _ranked(decisions: DataFrame) -> tuple[DataFrame, int]:
    """The curve (k, coverage, sel_acc, threshold), and how many decisions there are.

    Ranks come from range partitions, which are written: each is sorted and counted by itself, and the counts of those
    before it (one row for each partition) are added, so no task sees more than its range.
    """
    spark = decisions.sparkSession
    order = [F.desc("p"), F.asc("ordinal")]
    ranged = decisions.select("p", "ordinal", F.col("correct").cast("int").alias("y")).repartitionByRange(*order)
    ranged = staged(ranged.withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.count("*").alias("c"), F.sum("y").alias("h")).orderBy("part").collect()
    before, k, h = [], 0, 0
    for r in sums:
        before.append((r["part"], k, h))
        k, h = k + r["c"], h + r["h"]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, k0 bigint, h0 bigint"))
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.join(offsets, "part").select("p", (F.col("k0") + F.count("*").over(w)).alias("k"), (F.col("h0") + F.sum("y").over(w)).alias("hits"))
    return rows.select("k", (F.col("k") / F.lit(max(k, 1))).alias("coverage"), (F.col("hits") / F.col("k")).alias("sel_acc"), F.col("p").alias("threshold")), k


def risk_coverage(decisions: DataFrame) -> DataFrame:
    """(k, coverage, sel_acc, threshold): accuracy of the k surest decisions, for every k."""
    return _ranked(decisions)[0]


def rank_at(level: float, n: int) -> int:
    """The fewest of n decisions that cover ``level`` of them, within 1e-9."""
    k = max(1, math.ceil((level - 1e-9) * n))
    return next(i for i in (k - 1, k, k + 1) if i > 0 and i / n >= level - 1e-9)


def coverage_table(decisions: DataFrame) -> DataFrame:
    """(level, sel_acc) at the fewest decisions that reach each coverage; null if none does."""
    curve, n = _ranked(decisions)
    ranks = [(x, rank_at(x, n) if n else None) for x in LEVELS]
    levels = decisions.sparkSession.createDataFrame(ranks, "level double, k bigint")
    return levels.join(curve.filter(F.col("k").isin([k for _, k in ranks if k])), "k", "left").select("level", "sel_acc").orderBy("level")


def thinned(decisions: DataFrame, points: int = POINTS) -> DataFrame:
    """The curve at every N // points-th decision, and at the last."""
    curve, n = _ranked(decisions)
    return curve.filter(((F.col("k") - 1) % max(1, n // points) == 0) | (F.col("k") == n)).orderBy("k")


def compared(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(level, candidate, baseline): accuracy at each coverage side by side."""
    a, b = coverage_table(candidate), coverage_table(baseline)
    return a.select("level", F.col("sel_acc").alias("candidate")).join(b.select("level", F.col("sel_acc").alias("baseline")), "level").orderBy("level")
