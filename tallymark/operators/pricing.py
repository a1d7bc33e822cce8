"""Prices of calls: longest matching price key, tokens known or estimated, and what a move would save."""

from __future__ import annotations

import json
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.text import normal_model
from tallymark.operators.scoring import weight

#: USD for a million input and output tokens.
PRICES = {
    "gpt-4o": (2.5, 10.0),
    "gpt-4o-mini": (0.15, 0.6),
    "gpt-4.1": (2.0, 8.0),
    "gpt-4.1-mini": (0.4, 1.6),
    "gpt-4.1-nano": (0.1, 0.4),
    "o3-mini": (1.1, 4.4),
    "o4-mini": (1.1, 4.4),
    "claude-3-5-haiku": (0.8, 4.0),
    "claude-3-5-sonnet": (3.0, 15.0),
    "claude-3-7-sonnet": (3.0, 15.0),
    "claude-sonnet-4": (3.0, 15.0),
    "claude-opus-4": (15.0, 75.0),
}
LOGGED, FALLBACK = "(logged)", "(table median)"
#: Divisors of the two savings scenarios.
CONSERVATIVE, OPTIMISTIC = 100.0, 400.0


def load_prices(path: str, spark: SparkSession | None = None) -> dict[str, tuple[float, float]]:
    """Overrides from a JSON file: ``{model: [in, out]}``, also under a key ``models``. With a session, of any store that Spark reads."""
    if spark is None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    else:
        data = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    data = data.get("models", data) if isinstance(data, dict) else None
    if not isinstance(data, dict) or not all(isinstance(v, (list, tuple)) and len(v) == 2 for v in data.values()):
        raise ValueError("a price file maps models to pairs of rates")
    return {k: (float(a), float(b)) for k, (a, b) in data.items()}


def fallback_rates() -> tuple[float, float]:
    return median(a for a, _ in PRICES.values()), median(b for _, b in PRICES.values())


def price_table(spark: SparkSession, overrides: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(price_key, in_rate, out_rate, tier): overrides are tier 0, the table is tier 1. Overrides are a file that the driver read."""
    rows = [(0, k, float(a), float(b)) for k, (a, b) in (overrides or {}).items()] + [(1, k, a, b) for k, (a, b) in PRICES.items()]
    table = spark.createDataFrame(rows, "tier int, price_key string, in_rate double, out_rate double")
    return table.withColumn("price_key", F.when(F.col("tier") == 0, normal_model(F.col("price_key"))).otherwise(F.col("price_key")))


def model_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, price_key, in_rate, out_rate, is_fallback) of distinct models.

    Exact hits win over prefixes, overrides over the table within each, longer prefixes over shorter ones.
    Every prefix of a model's name meets the keys in an equi-join, so no price table is too large for it.
    """
    names = models.select("model").distinct().withColumn("m", normal_model(F.col("model")))
    prefixes = names.select("model", "m", F.explode(F.transform(F.sequence(F.lit(0), F.length("m")), lambda i: F.substring(F.col("m"), F.lit(1), i))).alias("price_key"))
    rank = F.struct(
        F.when(F.col("price_key") == F.col("m"), F.col("tier")).otherwise(F.col("tier") + 2).alias("r"),
        (-F.length("price_key")).alias("l"),
        F.col("price_key").alias("k"),
    )
    best = prefixes.join(prices, "price_key").groupBy("model").agg(F.min_by(F.struct("price_key", "in_rate", "out_rate"), rank).alias("p"))
    a, b = fallback_rates()
    none = F.col("p").isNull()
    return names.select("model").join(best, "model", "left").select(
        "model", F.coalesce("p.price_key", F.lit(FALLBACK)).alias("price_key"), F.coalesce("p.in_rate", F.lit(a)).alias("in_rate"), F.coalesce("p.out_rate", F.lit(b)).alias("out_rate"), none.alias("is_fallback")
    )


def with_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with cost_usd, price_key, is_fallback and approximated.

    A logged cost stands as it is; else tokens (a quarter of the excerpt's characters where unknown) at the
    model's rates, times the weight.
    """
    rates = model_prices(calls, prices).withColumnRenamed("model", "r_model")
    rows = calls.join(rates, F.col("model").eqNullSafe(F.col("r_model")), "left")
    logged = F.col("logged_cost_usd").isNotNull()

    def tokens(n: str, text: str) -> Column:
        return F.coalesce(F.col(n), F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 4))

    def guessed(n: str, text: str) -> Column:
        return F.col(n).isNull() & (F.coalesce(F.col(text), F.lit("")) != "")

    cost = (tokens("input_tokens", "prompt_excerpt") * F.col("in_rate") + tokens("output_tokens", "output_excerpt") * F.col("out_rate")) / 1e6 * weight()
    return rows.select(
        *calls.columns,
        F.when(logged, F.col("logged_cost_usd")).otherwise(cost).alias("cost_usd"),
        F.when(logged, F.lit(LOGGED)).otherwise(F.col("price_key")).alias("price_key"),
        (~logged & F.col("is_fallback")).alias("is_fallback"),
        (~logged & (guessed("input_tokens", "prompt_excerpt") | guessed("output_tokens", "output_excerpt"))).alias("approximated"),
    )


def savings(spend: Column, divisor: float) -> Column:
    if divisor <= 0:
        raise ValueError("a divisor has to be above 0")
    return spend * (1 - 1 / divisor)
