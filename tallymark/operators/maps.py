"""Similar calls clustered into sketches of typed questions."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import normal_output, role, template
from tallymark.session import staged

#: Options that a sketch lists at most, and origins.
OPTIONS, ORIGINS = 10, 5
JSON_NOTE = "output is JSON: make each field a choice option or a score range"


def build_maps(items: DataFrame) -> DataFrame:
    """One row per (role, template): calls, scores, kind, options or range or note, example, origins; most calls first.

    items: prompt, output, score, weight, origin, ordinal. Distinct outputs and origins are counted in two
    levels, so a cluster with many of them gathers no more than it shows. Roles and templates are found once
    and written, as five aggregates read them.
    """
    keyed = staged(items.select(role(F.col("prompt")).alias("role"), template(F.col("prompt")).alias("template"), "*", normal_output(F.col("output")).alias("out")))
    keys = ["role", "template"]
    main = keyed.groupBy(*keys).agg(
        F.sum("weight").alias("calls"), F.min("score").alias("low"), F.max("score").alias("high"), F.min("ordinal").alias("first"),
        F.min_by("prompt", F.when(F.col("prompt") != "", F.struct(F.length("prompt"), "ordinal"))).alias("example"),
        F.min_by("out", F.when(F.col("out") != "", F.col("ordinal"))).alias("first_out"),
    )
    outs = keyed.filter("out != ''").select(*keys, "out").distinct()
    ranked = outs.withColumn("number", F.when(F.col("out").rlike(r"\A-?[0-9]+(?:\.[0-9]+)?\z"), F.col("out")).try_cast("double"))
    kinds = ranked.groupBy(*keys).agg(
        F.count("*").alias("n_out"), F.bool_and(F.col("out").isin("yes", "no", "true", "false")).alias("booleans"), F.bool_and(F.col("number").isNotNull()).alias("numbers"), F.min("number").alias("n_low"), F.max("number").alias("n_high"),
    )
    few = ranked.join(kinds.filter(F.col("n_out") <= OPTIONS).select(*keys), keys).groupBy(*keys).agg(F.array_sort(F.collect_list("out")).alias("outs"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("origin"))
    origins = keyed.filter("origin != ''").select(*keys, "origin").distinct().withColumn("i", place).filter(F.col("i") <= ORIGINS).groupBy(*keys).agg(F.array_sort(F.collect_list("origin")).alias("origins"))
    rows = main.join(kinds, keys, "left").join(few, keys, "left").join(origins, keys, "left")
    n = F.coalesce("n_out", F.lit(0))
    yes_first = F.concat(F.filter("outs", lambda x: x == "yes"), F.filter("outs", lambda x: x == "true"), F.filter("outs", lambda x: ~x.isin("yes", "true")))
    booleans, numbers = (n > 0) & F.col("booleans"), (n > 0) & ~F.coalesce("booleans", F.lit(False)) & F.col("numbers")
    other = ~F.coalesce(booleans, F.lit(False)) & ~F.coalesce(numbers, F.lit(False))
    as_json = other & F.coalesce(F.substring("first_out", 1, 1).isin("{", "["), F.lit(False))
    return rows.select(
        "role", F.when(F.col("template") == "", "(mixed)").otherwise(F.col("template")).alias("template"), F.when(F.coalesce(numbers, F.lit(False)), "Score").otherwise("Choice").alias("kind"),
        "calls", F.col("low").alias("score_low"), F.col("high").alias("score_high"),
        F.when(booleans, yes_first).when(other & ~as_json & (n <= OPTIONS), F.coalesce("outs", F.array().cast("array<string>"))).alias("options"),
        F.when(numbers, F.struct(F.col("n_low").alias("lo"), F.col("n_high").alias("hi"))).alias("range"),
        F.when(as_json, JSON_NOTE).when(other & (n > OPTIONS), F.concat(n.cast("string"), F.lit(" distinct outputs: narrow the options before moving"))).alias("note"),
        F.coalesce("example", F.lit("")).alias("example"), F.coalesce("origins", F.array().cast("array<string>")).alias("origins"), "first",
    ).orderBy(F.desc("calls"), "first")


def unique_names(maps: list[tuple[str, str]]) -> list[str]:
    """Class names for (role, template) in order: the role, else with one of three template words, else numbered."""
    given: dict[str, None] = {}
    for kind, words in maps:
        longer = [kind + w.capitalize() for w in re.findall("[a-z]+", words.lower()) if w != "you"][:3]
        numbered = (f"{(longer or [kind])[-1]}{i}" for i in itertools.count(2))
        given[next(n for n in itertools.chain([kind], longer, numbered) if n not in given)] = None
    return list(given)
