"""An audit of logged calls: what they are, what they cost, what moving the decisions would save."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import signals as S
from tallymark.operators.maps import build_maps
from tallymark.operators.pricing import CONSERVATIVE, LOGGED, OPTIMISTIC, price_table, savings, with_costs
from tallymark.operators.scoring import duplication, weight, with_scores


class Audit:
    """Scored and priced calls and the aggregates over them, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, calls: DataFrame, overrides: dict[str, tuple[float, float]] | None = None, likely: float = S.LIKELY, maybe: float = S.MAYBE):
        self.spark, self.calls = spark, calls
        self.rows = with_costs(with_scores(calls, likely, maybe), price_table(spark, overrides))

    def cache(self) -> Audit:
        """Keeps the rows for several aggregates, on disk where memory runs out."""
        self.rows = self.rows.persist()
        return self

    def release(self) -> None:
        """Gives up what cache() keeps."""
        self.rows.unpersist()

    @cached_property
    def by_verdict(self) -> DataFrame:
        """(verdict, calls, spend): all four verdicts, zeros kept."""
        found = self.rows.groupBy("verdict").agg(F.sum(weight()).alias("calls"), F.sum("cost_usd").alias("spend"))
        every = self.spark.createDataFrame([(v, i) for i, v in enumerate(S.VERDICTS)], "verdict string, place int")
        return every.join(found, "verdict", "left").orderBy("place").select("verdict", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("spend", F.lit(0.0)).alias("spend"))

    def rollup(self, time: str = "timestamp") -> DataFrame:
        """(level, verdict, model, month, calls, spend): one pass gives the whole, each verdict, each model, each model's verdicts and each verdict's months.

        ``level`` names the columns that a row is for, joined by a plus; the others are null. A null model or time stays a group of its own.
        """
        rows = self.rows.select("verdict", "model", F.substring(time, 1, 7).alias("month"), weight().alias("w"), "cost_usd")
        sets = [[], ["verdict"], ["model"], ["verdict", "model"], ["verdict", "month"]]
        names = ["verdict", "model", "month"]
        found = rows.groupingSets(sets, *names).agg(F.grouping_id(*names).alias("g"), F.sum("w").alias("calls"), F.sum("cost_usd").alias("spend"))
        level = F.lit("all")
        for s in sets[1:]:  # a bit is set where the column is summed over
            level = F.when(F.col("g") == sum(1 << (2 - i) for i, n in enumerate(names) if n not in s), "+".join(s)).otherwise(level)
        return found.select(level.alias("level"), *names, "calls", "spend")

    def totals(self) -> DataFrame:
        """One row: calls, spend, what could move, and how costs are known."""
        moves = F.col("verdict").isin("likely", "maybe")
        logged = F.col("price_key") == LOGGED
        return self.rows.agg(
            F.coalesce(F.sum(weight()), F.lit(0)).alias("total_calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_spend"), F.coalesce(F.sum(F.when(moves, F.col("cost_usd"))), F.lit(0.0)).alias("migratable_spend"),
            F.coalesce(F.sum(F.when(logged, weight())), F.lit(0)).alias("logged_calls"), F.coalesce(F.sum(F.when(~logged, weight())), F.lit(0)).alias("estimated_calls"),
        )

    def savings(self, conservative: float = CONSERVATIVE, optimistic: float = OPTIMISTIC) -> DataFrame:
        """(scenario, divisor, saved)."""
        spend = F.col("migratable_spend")
        each = [F.struct(F.lit(n).alias("scenario"), F.lit(float(d)).alias("divisor"), savings(spend, d).alias("saved")) for n, d in (("conservative", conservative), ("optimistic", optimistic))]
        return self.totals().select(F.inline(F.array(*each)))

    def models(self) -> DataFrame:
        return self.rows.select("model").distinct().orderBy("model")

    def models_table(self) -> DataFrame:
        """(model, calls, cost, likely), dearest first."""
        return self.rows.groupBy("model").agg(F.sum(weight()).alias("calls"), F.sum("cost_usd").alias("cost"), F.coalesce(F.sum(F.when(F.col("verdict") == "likely", weight())), F.lit(0)).alias("likely")).orderBy(F.desc("cost"), "model")

    def unknown_models(self) -> DataFrame:
        """(model, priced_at) of models that no price key fits."""
        return self.rows.filter("is_fallback").select("model", F.col("price_key").alias("priced_at")).distinct().orderBy("model")

    def signal_tally(self) -> DataFrame:
        """(signal, calls) in which each signal is above 0."""
        sums = self.rows.agg(*(F.coalesce(F.sum(F.when(F.col(f"signals.{n}") > 0, weight())), F.lit(0)).alias(n) for n in S.WEIGHTS))
        return sums.unpivot([], list(S.WEIGHTS), "signal", "calls")

    def duplication(self) -> DataFrame:
        return duplication(self.calls)

    def top(self, n: int = 10) -> DataFrame:
        """The n best candidates: by score, cost and order of reading."""
        return self.rows.orderBy(F.desc("score"), F.desc("cost_usd"), "ordinal").limit(n)

    def maps(self) -> DataFrame:
        """Sketches of typed questions over the likely calls."""
        likely = self.rows.filter("verdict = 'likely'")
        return build_maps(likely.select(F.col("prompt_excerpt").alias("prompt"), F.col("output_excerpt").alias("output"), "score", weight().alias("weight"), F.col("source").alias("origin"), "ordinal"))
