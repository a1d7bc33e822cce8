"""A second opinion on scored rows: by default from a stand-in that reads the score, else over HTTP."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 25


class ClientError(RuntimeError):
    """The service gave no usable answer."""


def ask(question: str, options: list[str], score: float, base_url: str | None = None, token: str = "", timeout: float = 10, prompt: str = "", site: str = "log call") -> dict:
    """{choice, p, mock}. Without a URL, or with mock://, the stand-in answers. ``site`` says what is asked about: a log call or a code site."""
    if not base_url or base_url.startswith("mock://"):
        yes = min(0.99, max(0.02, score))
        choice = "yes" if yes >= 0.5 else "no"
        return {"choice": choice if choice in options else sorted(options)[0], "p": round(yes if choice == "yes" else 1 - yes, 4), "mock": True}
    body = json.dumps({"question": question, "options": options, "state": {"prompt": prompt, "score": score, "site": site}}).encode()
    request = urllib.request.Request(f"{base_url.rstrip('/')}/decisions", body, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            data = json.load(answer)
        if data["choice"] not in options:
            raise ClientError(f"not one of the options: {data['choice']}")
        return {"choice": data["choice"], "p": float(data["p"]), "mock": False}
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise ClientError(str(e)) from e


def of_calls(scored: DataFrame) -> DataFrame:
    """What opinions() asks about, of an audit's rows."""
    return scored.select(F.col("source").alias("origin"), F.col("prompt_excerpt").alias("prompt"), "score", "verdict", "cost_usd", "ordinal")


def of_sites(findings: DataFrame) -> DataFrame:
    """The same of code findings; by place where they score alike."""
    return findings.select(F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("origin"), F.col("prompt_excerpt").alias("prompt"), "score", "verdict", F.lit(0.0).alias("cost_usd"), F.struct("path", "line").alias("ordinal"))


def opinions(rows: DataFrame, limit: int = LIMIT, base_url: str | None = None, token: str = "", site: str = "log call") -> DataFrame:
    """(origin, score, verdict, choice, p, mock, agrees) of the ``limit`` first of (origin, prompt, score, verdict, cost_usd, ordinal).

    Rows of the highest score come first, of those the dearest. A row that the service fails on has null answers.
    """
    top = rows.orderBy(F.desc("score"), F.desc("cost_usd"), "ordinal").limit(limit).select("origin", "score", "verdict", *(["prompt"] if base_url else []))
    if base_url and not base_url.startswith("mock://"):

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for s, prompt in zip(batch["score"], batch.pop("prompt"), strict=True):
                    try:
                        out.append(ask("Is this call a decision?", ["yes", "no"], float(s), base_url, token, prompt=prompt or "", site=site))
                    except ClientError:
                        out.append({"choice": None, "p": None, "mock": None})
                yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=["choice", "p", "mock"])], axis=1)

        answered = top.mapInPandas(run, "origin string, score double, verdict string, choice string, p double, mock boolean")
    else:
        yes = F.least(F.lit(0.99), F.greatest(F.lit(0.02), F.col("score")))
        answered = top.drop("prompt").withColumn("choice", F.when(yes >= 0.5, "yes").otherwise("no")).withColumn("p", F.round(F.when(yes >= 0.5, yes).otherwise(1 - yes), 4)).withColumn("mock", F.lit(True))
    return answered.withColumn("agrees", (F.col("choice") == "yes") == F.col("verdict").isin("likely", "maybe"))


def agreement(opinions: DataFrame) -> DataFrame:
    """One row: n, agreement, errors, mock."""
    good = F.col("choice").isNotNull()
    return opinions.agg(
        F.count_if(good).alias("n"), F.coalesce(F.avg(F.when(good, F.col("agrees").cast("double"))), F.lit(0.0)).alias("agreement"), F.count_if(~good).alias("errors"), F.coalesce(F.bool_and(F.when(good, F.col("mock"))), F.lit(True)).alias("mock")
    )
