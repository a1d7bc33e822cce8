"""Queries over the standard tables, one or more for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import signals as S
from tallymark.functions import text as X
from tallymark.operators import calibration, codescan, history, migrate, selfcheck, sketches
from tallymark.operators.audit import Audit
from tallymark.operators.maps import build_maps
from tallymark.operators.pricing import load_prices, model_prices, price_table
from tallymark.operators.scoring import duplication, output_clusters, weight, with_scores
from tallymark.plans import report
from tallymark.session import scratch
from tallymark.sources import tables as T
from tallymark.sources.calls import as_int, field, messages_text, read_all, read_calls, read_decisions, sniffed
from tallymark.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]


def _audit(spark: SparkSession, d: str) -> Audit:
    return Audit(spark, T.calls_events(spark, d))


def _both(spark: SparkSession, d: str) -> Audit:
    return Audit(spark, T.calls_events(spark, d).unionByName(T.calls_usage(spark, d)))


def _signal(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return with_scores(T.calls_events(spark, d)).select("call_id", F.col(f"signals.{name}").alias("value"))

    return run


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


#: Source text around the words of a document, by the rest of its id by five: a call in Python that looks its answer up, one in a script,
#: a file that does not parse, a call through a general name that reads JSON, a script without a call.
SOURCES = [
    ("py", 'LABELS = ("refund", "bug")\ndef route(c, t):\n    r = c.chat.completions.create(model="gpt-4o", messages=[{"role": "user", "content": "%s"}])\n    x = r.choices[0].message.content\n    return x if x in LABELS else "other"\n'),
    ("ts", '// one\nconst r = await client.messages.create({ model: "claude-sonnet-4", messages: [{ role: "user", content: "%s" }] });\n'),
    ("py", "def f(:\n# %s\n"),
    ("py", 'import json\nMODEL = "o3-mini"\ndef rate(llm):\n    return json.loads(llm.invoke("%s", model=MODEL).text)\n'),
    ("js", 'foo.complete = "%s";\n'),
]


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A source file for each document, with its words as the prompt."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
    i = F.col("doc_id")
    kinds = [(F.concat(i.cast("string"), F.lit(f".{suffix}")), F.replace(F.lit(code), F.lit("%s"), words)) for suffix, code in SOURCES]
    path, content = (F.element_at(F.array(*x), (i % len(SOURCES)).cast("int") + 1) for x in zip(*kinds, strict=True))
    return T.table(spark, d, "documents").select(path.alias("path"), content.alias("content"))


def code_sites(spark: SparkSession, d: str) -> DataFrame:
    found = codescan.scored_sites(codescan.sites(_sources(spark, d)))
    return found.select("path", "line", "language", "api", "model", "prompt_excerpt", F.array_join("handling", ", ").alias("handling"), "score", "verdict")


def code_roots(spark: SparkSession, d: str) -> DataFrame:
    """Two trees of the same files: where each finding is, with the totals of both."""
    found, totals = codescan.scan_roots({"x": _sources(spark, d), "y/": _sources(spark, d)})
    return found.select("path", "line", "verdict", *(F.lit(n).alias(k) for k, n in totals.items()))


def code_sites_sql(spark: SparkSession, d: str) -> DataFrame:
    """The table function in SQL: Python sources, how many sites each has and whether it parses."""
    codescan.register(spark)
    _sources(spark, d).filter("path like '%.py'").createOrReplaceTempView("python_sources")
    return spark.sql("SELECT path, count_if(NOT error) sites, bool_or(error) broken, coalesce(max(line), 0) line FROM python_sources, LATERAL python_sites(content) GROUP BY path")


def site_marks(spark: SparkSession, d: str) -> DataFrame:
    """How many marks the patch of each file puts in."""
    files = _sources(spark, d)
    p = migrate.patches(codescan.scored_sites(codescan.sites(files)), files, S.MAYBE)
    return p.select("path", F.size(F.regexp_extract_all("patch", F.lit(r"(?m)^\+.*TODO"), 0)).alias("marks"))


def _maps(items: DataFrame) -> DataFrame:
    m = build_maps(items)
    return m.select("role", "template", "kind", "calls", "score_low", "score_high", F.array_join("options", "|").alias("options"), F.col("range.lo").alias("lo"), F.col("range.hi").alias("hi"), "example", F.array_join("origins", "|").alias("origins"))


def map_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", X.role(F.col("text")).alias("role"), X.template(F.col("text")).alias("template"))


def conversation_calls(spark: SparkSession, d: str) -> DataFrame:
    p = T.conversation_pairs(spark, d)
    return p.select("conv_id", "turn", X.clipped(F.col("prompt")).alias("prompt_excerpt"), X.clipped(F.col("output"), limit=200).alias("output_excerpt"))


def _read(lines: Callable[[DataFrame], DataFrame], name: str) -> Query:
    """Calls of the events, written as files that ``lines`` gives the records of, and read back."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = scratch(spark, name)
        records = lines(T.calls_events(spark, d))
        if name.endswith(".csv"):
            records.write.csv(path, header=True, escape='"')
        else:
            records.select(F.to_json(F.struct("*"))).write.text(path)
        tokens = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("input_tokens", "output_tokens")]
        return read_calls(spark, path)[0].select("model", "format", *tokens, "prompt_excerpt", "output_excerpt", "logged_cost_usd", "weight", *([] if name.endswith(".csv") else ["call_id"]))

    return run


def _choice(c: str) -> Column:
    return F.struct(F.array(F.struct(F.struct(F.col(c).alias("content")).alias("message"))).alias("choices"))


def _messages(c: str) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), F.col(c).alias("content")))


def as_litellm(calls: DataFrame) -> DataFrame:
    usage = F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"))
    return calls.select(F.col("call_id").alias("id"), "model", _messages("prompt_excerpt").alias("messages"), _choice("output_excerpt").alias("response"), usage.alias("usage"), F.col("logged_cost_usd").alias("response_cost"))


def as_langfuse(calls: DataFrame) -> DataFrame:
    usage = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"))
    return calls.select(F.col("call_id").alias("id"), F.lit("GENERATION").alias("type"), "model", F.col("prompt_excerpt").alias("input"), F.col("output_excerpt").alias("output"), usage.alias("usage"), F.col("logged_cost_usd").alias("totalCost"))


def as_generic(calls: DataFrame) -> DataFrame:
    """Prompts are lists of messages, outputs objects with choices."""
    return calls.select(F.col("call_id").alias("id"), F.col("model").alias("model_name"), _messages("prompt_excerpt").alias("prompt"), _choice("output_excerpt").alias("completion"), "input_tokens", "output_tokens", F.col("logged_cost_usd").alias("cost"), F.col("weight").alias("request_count"))


def as_usage(calls: DataFrame) -> DataFrame:
    """Two columns of one name but for case: the last counts."""
    return calls.select("model", F.col("input_tokens").alias(" Input_Tokens"), "output_tokens", F.lit("7").alias("Cost"), F.col("logged_cost_usd").alias("cost"), F.col("weight").alias("requests"), F.col("prompt_excerpt").alias("prompt"), F.col("output_excerpt").alias("answer"))


def read_decision_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "decisions.jsonl")
    T.decisions_events(spark, d).select(F.to_json(F.struct(F.col("p").alias("prob"), F.col("correct").alias("outcome"), "model", "question"))).write.text(path)
    return read_decisions(spark, path)[0].groupBy("p", "correct", "model", "question").agg(F.count("*").alias("n"))


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = scratch(spark, name)
    lines.write.text(path)
    return path


def read_skips(spark: SparkSession, d: str) -> DataFrame:
    """Lines of ten kinds: no record, a list of two (also the first line), text after a record, two records, a repeated key, NaN."""
    record = F.to_json(F.struct("model", F.col("weight").alias("n")))
    again = F.concat(F.lit('{"n":7,"usage":{"input":1,"input":2},'), F.substring(record, 2, 1 << 20))
    kinds = {0: F.concat(F.lit("["), record, F.lit(","), record, F.lit(",3]")), 1: F.lit("{bad"), 2: F.concat(record, F.lit(" junk")), 3: F.concat(record, record), 4: again, 5: F.concat(F.lit('{"cost":NaN,'), F.substring(record, 2, 1 << 20))}
    text = record
    for k, x in kinds.items():
        text = F.when(F.col("ordinal") % 10 == k, x).otherwise(text)
    calls, skipped = read_calls(spark, _written(spark, T.calls_events(spark, d).select(text), "skips.jsonl"))
    return calls.agg(F.count("*").alias("calls"), F.sum("weight").alias("weight"), F.count("input_tokens").alias("with_tokens")).join(skipped)  # two single rows


def read_document(spark: SparkSession, d: str) -> DataFrame:
    """One JSON value: the nations in a list under ``data``."""
    n = T.table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    whole = n.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("n"), F.col("n_name").alias("model")))).alias("data"))))
    return read_calls(spark, _written(spark, whole, "nations.json"))[0].select("model", "weight", F.col("ordinal"))


def sniffed_formats(spark: SparkSession, d: str) -> DataFrame:
    calls = T.calls_events(spark, d)
    of = [shape(calls).select(F.col("id").cast("bigint").alias("event_id"), F.to_json(F.struct("*")).alias("t")) for shape in (as_litellm, as_langfuse, as_generic)]
    rows = [df.filter(F.col("event_id") % 3 == i) for i, df in enumerate(of)]
    return rows[0].union(rows[1]).union(rows[2]).select("event_id", sniffed(F.parse_json("t")).alias("format"))


def decision_fields(spark: SparkSession, d: str) -> DataFrame:
    """Lines of four kinds: names and values of other kinds, a first key that is null, and a p above 1."""
    i = F.col("event_id")
    kinds = ['{"p": 0.75, "correct": "Hit"}', '{"probability": "0.25", "outcome": 0, "question": "q"}', '{"p": null, "prob": 0.5, "correct": true}', '{"confidence": 1.5, "hit": true}']
    text = F.element_at(F.array(*map(F.lit, kinds)), (i % 4 + 1).cast("int"))
    rows, skipped = read_decisions(spark, _written(spark, T.table(spark, d, "events").select(text), "fields.jsonl"))
    return rows.groupBy("p", "correct", "question").agg(F.count("*").alias("n")).join(skipped)


def message_texts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as lists of messages; contents are strings, or lists of a string and of parts with a text."""
    c = T.table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    plain, parts = F.to_json(F.struct("role", F.col("text").alias("content"))), F.to_json(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")))
    message = F.struct("turn", F.when(F.col("turn") % 2 == 0, plain).otherwise(parts).alias("m"))
    listed = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("ms"))  # bounded by a conversation
    return listed.select("conv_id", messages_text(F.parse_json(F.concat(F.lit("["), F.array_join("ms.m", ","), F.lit("]")))).alias("text"))


def read_union(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file and a JSONL file as one."""
    path = scratch(spark, "usage.csv")
    calls = T.calls_events(spark, d)
    as_usage(calls).write.csv(path, header=True, escape='"')
    lines = _written(spark, as_generic(calls).select(F.to_json(F.struct("*"))), "calls.jsonl")
    both, skipped = read_all(spark, [path, lines])
    return both.groupBy(F.shiftright("ordinal", 40).alias("file")).agg(F.count("*").alias("calls"), F.sum("weight").alias("weight")).join(skipped)


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the events with their time."""
    e = T.table(spark, d, "events").select(F.col("event_id").alias("ordinal"), "ts", "user_id")
    return T.calls_events(spark, d).drop("timestamp").join(e, "ordinal").withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd"))


def audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    calls = T.calls_events(spark, d).withColumn("timestamp", F.concat(F.lit("2024-0"), (F.col("ordinal") % 7 + 1).cast("string"), F.lit("-01")))
    return _rounded(Audit(spark, calls).rollup(), "spend", digits=4)


def asof_prices(spark: SparkSession, d: str) -> DataFrame:
    """Line items as calls, by the newest price of their supplier's model; orders as the history of prices."""
    model = lambda c: (F.col(c) % len(T.MODELS)).cast("int").alias("model")
    prices = T.table(spark, d, "orders").groupBy(model("o_custkey"), F.col("o_orderdate").alias("since")).agg(F.max("o_totalprice").alias("rate"))
    items = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", model("l_suppkey"), F.col("l_shipdate").alias("ts"))
    return history.asof_prices(items, prices).select("l_orderkey", "l_linenumber", "l_partkey", "model", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("ts", "since")), "rate")


def price_file(spark: SparkSession, d: str) -> DataFrame:
    """Prices of customers as models, in a file of one for each nation; a customer's model is its nation's, by name, suffix and date."""
    n = T.table(spark, d, "nation")
    whole = n.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("House/"), "n_name"), F.array(F.col("n_nationkey") + 1, F.lit(2.5))))).alias("models"))))  # a price file is small
    prices = price_table(spark, load_prices(_written(spark, whole, "prices.json"), spark))
    name = F.concat(F.lower("n_name"), (F.col("c_custkey") % 3).cast("string"), F.lit("-2024-01-31"))
    models = T.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(name.alias("model"))
    return model_prices(models, prices)


def call_sessions(spark: SparkSession, d: str) -> DataFrame:
    calls = _dated(spark, d)
    found = sessions.call_sessions(calls.union(calls), "user_id", gap="2 hours", once=["call_id"])
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("began", "ended")})


def sketched_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Exact figures by model, and whether those from daily sketches lie within their stated errors."""
    calls = _dated(spark, d)
    about = sketches.merged(sketches.daily_sketches(calls, F.to_date("ts")), "model", quantiles=(0.5,))
    out = X.normal_output(F.col("output_excerpt"))
    exact = calls.groupBy("model").agg(F.count_distinct(F.when(out != "", out)).alias("outputs"), F.sum(weight()).alias("n"))
    low, high = (calls.groupBy("model").agg(F.percentile("output_tokens", F.lit(q)).alias(c)) for q, c in ((0.47, "low"), (0.53, "high")))
    rows = about.join(exact, "model").join(low, "model").join(high, "model")
    near = F.abs(F.col("distinct_outputs") - F.col("outputs")) <= F.greatest(F.lit(1.0), sketches.distinct_error() * F.col("outputs"))
    return rows.select("model", "outputs", "n", near.alias("outputs_near"), F.col("p50").between(F.floor("low"), F.ceil("high")).alias("median_near"), (F.col("calls") == F.col("n")).alias("same_calls"))


#: Prices that come before those of the table.
OVERRIDES = {"GPT-4o": (9.0, 8.0), "mystery": (1.0, 2.0)}


def top_likely(spark: SparkSession, d: str) -> DataFrame:
    rows = report.candidates(_audit(spark, d), 10)
    return spark.createDataFrame([(r["place"], r["source"], r["why"]) for r in rows], "place bigint, source string, why string")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "verdict_counts": lambda s, d: _audit(s, d).by_verdict.select("verdict", "calls"),
        **{f"signal_{n}": _signal(n) for n in S.WEIGHTS},
        "call_scores": lambda s, d: with_scores(T.calls_events(s, d)).select("call_id", "score", "verdict"),
        "label_scores": lambda s, d: with_scores(T.calls_labels(s, d).withColumn("prompt_excerpt", X.clipped(F.col("prompt_excerpt")))).groupBy("verdict").agg(F.count("*").alias("calls")),
        "output_clusters": lambda s, d: output_clusters(T.calls_events(s, d)),
        "corpus_duplication": lambda s, d: duplication(T.calls_events(s, d)),
        "model_normalize": lambda s, d: T.calls_events(s, d).select("model").distinct().select("model", X.normal_model(F.col("model")).alias("normal")),
        "price_lookup": lambda s, d: model_prices(T.calls_events(s, d), price_table(s)),
        "call_costs": lambda s, d: _rounded(_audit(s, d).rows.select("call_id", "cost_usd", "price_key", "is_fallback", "approximated"), "cost_usd", digits=9),
        "spend_by_verdict": lambda s, d: _rounded(_both(s, d).by_verdict, "spend", digits=4),
        "audit_totals": lambda s, d: _rounded(_both(s, d).totals(), "total_spend", "migratable_spend", digits=4),
        "savings_scenarios": lambda s, d: _rounded(_both(s, d).savings(), "saved", digits=4),
        "unknown_models": lambda s, d: _both(s, d).unknown_models(),
        "distinct_models": lambda s, d: _both(s, d).models(),
        "models_table": lambda s, d: _rounded(_audit(s, d).models_table(), "cost", digits=4),
        "signal_tally": lambda s, d: _audit(s, d).signal_tally(),
        "top_candidates": lambda s, d: _rounded(_audit(s, d).top(10).select("call_id", "score", "cost_usd", "verdict"), "cost_usd", digits=9),
        "prompt_clip": lambda s, d: T.table(s, d, "documents").select("doc_id", X.clipped(F.col("text")).alias("excerpt")),
        "output_norm": lambda s, d: T.table(s, d, "documents").select("doc_id", X.normal_output(F.col("text")).alias("normal")),
        "redact_documents": lambda s, d: T.table(s, d, "documents").select("doc_id", X.redacted(F.col("text")).alias("safe")),
        "map_documents": map_documents,
        "decision_maps": lambda s, d: _maps(with_scores(T.calls_events(s, d)).filter("verdict = 'likely'").select(F.col("prompt_excerpt").alias("prompt"), F.col("output_excerpt").alias("output"), "score", "weight", F.col("source").alias("origin"), "ordinal")),
        "reliability_bins": lambda s, d: _rounded(calibration.reliability_bins(T.decisions_events(s, d)), "lo", "hi", "conf", "acc", "gap", "abs_gap"),
        "calibration_summary": lambda s, d: _rounded(calibration.summary(T.decisions_events(s, d)), "accuracy", "avg_p", "ece", "mce", "brier"),
        "calibration_groups": lambda s, d: _rounded(calibration.groups(T.decisions_labels(s, d)), "accuracy", "ece", "avg_p"),
        "risk_coverage": lambda s, d: _rounded(calibration.risk_coverage(T.decisions_events(s, d)), "coverage", "sel_acc", "threshold"),
        "coverage_table": lambda s, d: _rounded(calibration.coverage_table(T.decisions_labels(s, d)), "sel_acc"),
        "rc_thinned": lambda s, d: _rounded(calibration.thinned(T.decisions_events(s, d)), "coverage", "sel_acc", "threshold"),
        "calibration_compare": lambda s, d: _rounded(calibration.compared(T.decisions_labels(s, d), T.decisions_events(s, d)), "candidate", "baseline"),
        "selfcheck_mock": lambda s, d: selfcheck.opinions(selfcheck.of_calls(_audit(s, d).rows)),
        "selfcheck_agreement": lambda s, d: selfcheck.agreement(selfcheck.opinions(selfcheck.of_calls(_audit(s, d).rows))),
        "event_json_fields": lambda s, d: T.table(s, d, "events").select("event_id", as_int(field(F.try_parse_json("props"), "missing", "k")).alias("k")),
        "conversation_calls": conversation_calls,
        "code_sites": code_sites,
        "code_sites_sql": code_sites_sql,
        "read_litellm": _read(as_litellm, "calls.jsonl"),
        "read_langfuse": _read(as_langfuse, "calls.ndjson"),
        "read_generic": _read(as_generic, "calls.jsonl"),
        "read_usage_csv": _read(as_usage, "usage.csv"),
        "read_decisions": read_decision_lines,
        "code_roots": code_roots,
        "site_marks": site_marks,
        "read_skips": read_skips,
        "read_document": read_document,
        "read_union": read_union,
        "sniffed_formats": sniffed_formats,
        "decision_fields": decision_fields,
        "message_texts": message_texts,
        "markdown_cells": lambda s, d: T.table(s, d, "documents").select("doc_id", X.cell(F.coalesce("text", F.lit("")), 80).alias("cell")),
        "strict_verdicts": lambda s, d: with_scores(T.calls_events(s, d), 0.8, 0.5).groupBy("verdict").agg(F.sum("weight").alias("calls")),
        "signals_by_value": lambda s, d: with_scores(T.calls_events(s, d)).select("call_id", report.by_value(F.col("signals")).alias("why")),
        "top_likely": top_likely,
        "price_file": price_file,
        "audit_rollup": audit_rollup,
        "asof_prices": asof_prices,
        "call_sessions": call_sessions,
        "sketched_outputs": sketched_outputs,
        "price_overrides": lambda s, d: model_prices(T.calls_events(s, d), price_table(s, OVERRIDES)),
    }
    return q


_LIST = ", ".join(f"'{m}'" for m in T.MODELS)
_WHEN = " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in T.PROMPTS.items())
#: Word characters outside ASCII become a word character that no stem holds.
_PLAIN = r"regexp_replace(regexp_replace({0}, '[^\x00-\x7F\pL\pN]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
_EVENTS = rf"""
e AS (SELECT CAST(event_id AS VARCHAR) call_id, 'events#L' || event_id source, ([{_LIST}])[CAST(user_id % {len(T.MODELS)} AS INT) + 1] model,
  CASE WHEN event_id % 7 <> 0 THEN 20 + event_id % 3000 END input_tokens, CASE WHEN event_id % 5 <> 0 THEN event_id % 150 END output_tokens,
  CASE {_WHEN} ELSE '{T.OTHER_PROMPT}' END prompt,
  CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN props ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END output,
  CASE WHEN event_id % 4 = 0 THEN floor(value) / 1000 END logged, 1 + event_id % 3 weight, event_id ordinal FROM events)"""


def _steps(c: str, table: list[tuple[int, float]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} <= {n} THEN {v}" for n, v in table) + " ELSE 0.0 END"


def _scored(calls: str) -> str:
    """CTEs from calls(call_id, source, model, input_tokens, output_tokens, prompt, output, weight, ordinal)."""
    decision, generative = "|".join(S.DECISION), "|".join(S.GENERATIVE)
    p = _PLAIN.format("prompt")
    return rf"""
k AS (SELECT *, trim(regexp_replace(lower(output), '\s+', ' ', 'g')) out_key, len(regexp_extract_all({p}, '(?i){decision}')) dec, len(regexp_extract_all({p}, '(?i){generative}')) gen FROM {calls}),
c AS (SELECT model, out_key, sum(greatest(1, weight)) n FROM k WHERE out_key <> '' GROUP BY ALL),
g AS (SELECT k.*,
  CAST(CASE WHEN output_tokens IS NOT NULL THEN {_steps("output_tokens", S.OUTPUT_TOKENS)} ELSE {_steps("length(trim(output))", S.OUTPUT_CHARS)} END AS DOUBLE) short_output,
  CAST(CASE WHEN output = '' THEN 0 WHEN left(output, 1) IN ('{{', '[') THEN CASE WHEN json_valid(output) THEN 1 ELSE 0.5 END WHEN lower(output) IN ('yes', 'no', 'true', 'false') THEN 1
    WHEN regexp_full_match(output, '-?[0-9]+(\.[0-9]+)?') THEN 1 WHEN regexp_full_match(output, '[A-Za-z0-9][A-Za-z0-9_\-/ ]{{0,47}}') AND len(string_split(output, ' ')) <= 4 THEN 0.8 ELSE 0 END AS DOUBLE) structured_output,
  CAST(CASE WHEN dec = 0 THEN 0 ELSE least(1, 0.5 + 0.15 * dec) END AS DOUBLE) decision_language,
  CAST(least(1, CASE WHEN prompt LIKE '%?' THEN 0.7 ELSE 0 END + CASE WHEN regexp_matches(prompt, '(?i)^\s*({"|".join(S.STARTERS)})\b') THEN 0.3 ELSE 0 END) AS DOUBLE) question_shape,
  CAST(CASE WHEN input_tokens IS NOT NULL THEN {_steps("input_tokens", S.INPUT_TOKENS)} ELSE {_steps("length(trim(prompt))", S.INPUT_CHARS)} END AS DOUBLE) short_input,
  CAST(CASE WHEN coalesce(n, 0) >= 5 THEN 1 WHEN coalesce(n, 0) >= 2 THEN 0.6 ELSE 0 END AS DOUBLE) low_output_diversity
  FROM k LEFT JOIN c USING (model, out_key)),
s AS (SELECT *, CASE WHEN prompt = '' AND output = '' THEN 'insufficient' WHEN score >= 0.6 THEN 'likely' WHEN score >= 0.35 THEN 'maybe' ELSE 'unlikely' END verdict FROM (
  SELECT *, round(({" + ".join(f"CAST({w} AS DOUBLE) * {n}" for n, w in S.WEIGHTS.items())}) * CASE WHEN gen > 0 AND dec = 0 THEN 0.6::DOUBLE ELSE 1 END, 4) score FROM g))"""


def _priced() -> str:
    from tallymark.operators.pricing import PRICES, fallback_rates

    rows = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in PRICES.items())
    a, b = fallback_rates()
    normal = r"regexp_replace(regexp_extract(lower(trim(model)), '[^/]*$'), '(-\d{4}-\d{2}-\d{2}|-\d{8})$', '')"
    return rf"""
r(rk, ra, rb) AS (VALUES {rows}),
m AS (SELECT model, {normal} normal FROM (SELECT DISTINCT model FROM s)),
lp AS (SELECT model, max_by(rk, (CASE WHEN rk = normal THEN 1000 ELSE 0 END) + length(rk)) pk FROM m JOIN r ON starts_with(normal, rk) GROUP BY model),
mp AS (SELECT m.model, coalesce(pk, '(table median)') price_key, coalesce(ra, {a}::DOUBLE) in_rate, coalesce(rb, {b}::DOUBLE) out_rate, pk IS NULL is_fallback FROM m LEFT JOIN lp USING (model) LEFT JOIN r ON pk = rk),
w AS (SELECT s.*, CASE WHEN logged IS NOT NULL THEN logged ELSE (coalesce(input_tokens, length(prompt) // 4) * in_rate + coalesce(output_tokens, length(output) // 4) * out_rate) / 1e6::DOUBLE * greatest(1, weight) END cost_usd,
  CASE WHEN logged IS NOT NULL THEN '(logged)' ELSE mp.price_key END price_key, logged IS NULL AND is_fallback is_fallback,
  logged IS NULL AND ((input_tokens IS NULL AND prompt <> '') OR (output_tokens IS NULL AND output <> '')) approximated FROM s JOIN mp USING (model))"""


def oracle_sql() -> dict[str, str]:
    events = f"WITH {_EVENTS}, {_scored('e')}"
    priced = f"{events}, {_priced()}"
    usage = """u AS (SELECT l_returnflag || '-' || l_linestatus || '-' || strftime(l_shipdate, '%Y-%m') call_id, count(*) n, sum(CAST(floor(l_extendedprice) AS BIGINT)) cents, sum(CAST(floor(l_quantity) AS BIGINT)) q, lower(l_returnflag) f
      FROM lineitem GROUP BY l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m')),
    b AS (SELECT * FROM e UNION ALL BY NAME SELECT call_id, 'usage#' || call_id source, 'gpt-4o-' || f model, q input_tokens, n output_tokens, '' prompt, '' output, cents / 1e6::DOUBLE logged, n weight, 0 ordinal FROM u)"""
    both = f"WITH {_EVENTS}, {usage}, {_scored('b')}, {_priced()}"
    verdicts = "v(verdict) AS (VALUES ('likely'), ('maybe'), ('unlikely'), ('insufficient'))"
    strip = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
    t = strip.format("text")
    ev = "d AS (SELECT least(floor(value) / 500, 1.0::DOUBLE) p, CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END y, event_type question, event_id ordinal FROM events)"
    lb = "d AS (SELECT 0.5::DOUBLE + (doc_id * 7919 % 500) / 1000 p, CASE WHEN quality = 1 THEN 1 ELSE 0 END y, lang question, doc_id ordinal FROM labels JOIN documents USING (doc_id))"
    bins = "b AS (SELECT least(CAST(floor(p * 10) AS INT), 9) bin, count(*) n, avg(p) conf, avg(y) acc FROM d GROUP BY 1)"
    curve = "rc AS (SELECT k, hits, p, (SELECT count(*) FROM d) n FROM (SELECT row_number() OVER (ORDER BY p DESC, ordinal) k, sum(y) OVER (ORDER BY p DESC, ordinal ROWS UNBOUNDED PRECEDING) hits, p FROM d))"
    levels = f"l(level) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in calibration.LEVELS)})"
    at = "SELECT level, round((SELECT min_by(hits / k, k) FROM rc WHERE k / n >= level - 1e-9), 6) sel_acc FROM l"
    redact = "text"
    for pattern, to in X.REDACTIONS:
        redact = f"regexp_replace({redact}, '{pattern}', '{to}', 'g')"
    role = "CASE " + " ".join(f"WHEN regexp_matches({_PLAIN.format('coalesce(text, chr(32))')}, '(?i){p}') THEN '{n}'" for p, n in X.ROLES) + f" ELSE '{X.DEFAULT_ROLE}' END"
    stop = ", ".join(f"'{w}'" for w in X.STOPWORDS)
    words = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+'), lambda w: w NOT IN ({stop}))"
    checked = f"{priced}, o AS (SELECT source origin, score, verdict, CASE WHEN score >= 0.5 THEN 'yes' ELSE 'no' END choice, round(CASE WHEN score >= 0.5 THEN least(0.99::DOUBLE, score) ELSE 1 - greatest(0.02::DOUBLE, score) END, 4) p, true mock FROM w ORDER BY score DESC, w.cost_usd DESC, ordinal LIMIT 25)"

    def clip(c: str, limit: int) -> str:
        x = strip.format(f"coalesce({c}, '')")
        return f"CASE WHEN length({x}) > {limit} THEN left({x}, 300) || ' … ' || right({x}, 120) ELSE {x} END"

    read = "SELECT {0} model, '{1}' AS format, coalesce(input_tokens, -1)::BIGINT input_tokens, coalesce(output_tokens, -1)::BIGINT output_tokens, prompt prompt_excerpt, output output_excerpt, logged logged_cost_usd, {2}::BIGINT weight{3} FROM e"
    labelled = f"""WITH l AS (SELECT doc_id::VARCHAR call_id, 'labels#L' || doc_id source, 'gpt-4o-mini' model, NULL::BIGINT input_tokens, NULL::BIGINT output_tokens, {clip("'Is this document toxic? Answer yes or no: ' || text", 440)} prompt,
      CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END output, 1 weight, doc_id ordinal FROM labels JOIN documents USING (doc_id)), {_scored('l')}"""
    why = " UNION ALL ".join(f"SELECT call_id, {i} i, '{n}' n, {n} v FROM s" for i, n in enumerate(S.WEIGHTS))
    why = f"y AS (SELECT call_id, coalesce(string_agg(n || ' ' || printf('%.2f', v), ', ' ORDER BY v DESC, i) FILTER (v > 0), '') why FROM ({why}) GROUP BY 1)"
    # the words of a document in a script: its call shows them where they fit its reach, else what stands between two quotes
    head = len('messages.create({ model: "claude-sonnet-4", messages: [{ role: "user", content: "')
    code = rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) w FROM documents),
    q AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 1 OR length(w) BETWEEN 12 AND {codescan.REACH - head - 1} THEN w ELSE ', messages: [{{ role:' END w FROM d WHERE doc_id % 5 IN (0, 1, 3)),
    a AS (SELECT doc_id::VARCHAR call_id, '' source, '' model, NULL::BIGINT input_tokens, NULL::BIGINT output_tokens, CASE WHEN length(w) > 320 THEN left(w, 240) || ' … ' || right(w, 80) ELSE w END prompt, '' AS output, 1 weight, doc_id ordinal FROM q), {_scored('a')},
    c1 AS (SELECT ordinal, prompt, ordinal % 5 r, decision_language, question_shape, short_input, gen, dec FROM g),
    c2 AS (SELECT *, CASE WHEN score >= 0.6 THEN 'likely' WHEN score >= 0.35 THEN 'maybe' ELSE 'unlikely' END verdict FROM (SELECT ordinal || CASE r WHEN 1 THEN '.ts' ELSE '.py' END AS path, CASE r WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 4 END line, CASE r WHEN 1 THEN 'js' ELSE 'python' END AS language,
      CASE r WHEN 0 THEN 'c.chat.completions.create' WHEN 1 THEN 'messages.create (pattern)' ELSE 'llm.invoke' END api, CASE r WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-sonnet-4' ELSE 'o3-mini' END model, prompt prompt_excerpt, CASE r WHEN 0 THEN 'enum membership, reads completion text' WHEN 1 THEN '' ELSE 'json parse' END AS handling,
      round(({S.WEIGHTS['short_output']}::DOUBLE * CASE r WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0 ELSE 0.7::DOUBLE END + {S.WEIGHTS['structured_output']}::DOUBLE * CASE r WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0 ELSE 1 END + {S.WEIGHTS['decision_language']}::DOUBLE * decision_language + {S.WEIGHTS['question_shape']}::DOUBLE * question_shape + {S.WEIGHTS['short_input']}::DOUBLE * short_input) * CASE WHEN gen > 0 AND dec = 0 THEN 0.6::DOUBLE ELSE 1 END, 4) score FROM c1))"""
    cell = r"replace(replace(coalesce(text, ''), '|', '\|'), chr(10), ' ⏎ ')"
    return {
        "code_roots": f"{code}, t AS (SELECT 2 * count(*) files_scanned, 2 * count(*) FILTER (doc_id % 5 = 2) errors, (SELECT 2 * count(*) FROM c2) sites, (SELECT 2 * count(*) FROM c2 WHERE verdict IN ('likely', 'maybe')) decision_shaped FROM documents) SELECT x || path AS path, line, verdict, t.* FROM c2, t, (VALUES ('x/'), ('y/')) y(x)",
        "code_sites_sql": "SELECT doc_id || '.py' AS path, CASE WHEN doc_id % 5 = 2 THEN 0 ELSE 1 END sites, doc_id % 5 = 2 broken, CASE doc_id % 5 WHEN 0 THEN 3 WHEN 3 THEN 4 ELSE 0 END line FROM documents WHERE doc_id % 5 IN (0, 2, 3)",
        "site_marks": f"{code} SELECT path, 1 marks FROM c2 WHERE score >= {S.MAYBE}",
        "code_sites": f"{code} SELECT path, line, language, api, model, prompt_excerpt, handling, score, verdict FROM c2",
        "read_skips": f"WITH {_EVENTS}, k AS (SELECT weight, ordinal % 10 r, CASE WHEN ordinal % 10 = 0 THEN 2 WHEN ordinal % 10 < 4 THEN 0 ELSE 1 END c FROM e) SELECT sum(c)::BIGINT calls, sum(c * weight)::BIGINT weight, count(*) FILTER (r = 4) with_tokens, count(*) FILTER (c = 0) skipped FROM k",
        "read_document": "SELECT n_name model, greatest(1, n_nationkey) weight, n_nationkey + 1 ordinal FROM nation",
        "read_union": f"WITH {_EVENTS} SELECT f AS file, count(*) calls, sum(weight)::BIGINT weight, 0::BIGINT skipped FROM e, (VALUES (0), (1)) x(f) GROUP BY 1",
        "price_file": "WITH m AS (SELECT DISTINCT lower(n_name) || (c_custkey % 3) base FROM customer JOIN nation ON c_nationkey = n_nationkey), x AS (SELECT base, max_by(lower(n_name), length(n_name)) price_key, max_by(n_nationkey + 1, length(n_name))::DOUBLE in_rate FROM m JOIN nation ON starts_with(base, lower(n_name)) GROUP BY 1) SELECT base || '-2024-01-31' model, price_key, in_rate, 2.5::DOUBLE out_rate, false is_fallback FROM x",
        "audit_rollup": f"{priced}, y AS (SELECT *, '2024-0' || (ordinal % 7 + 1) AS month FROM w) SELECT CASE GROUPING(verdict, model, month) WHEN 7 THEN 'all' WHEN 3 THEN 'verdict' WHEN 5 THEN 'model' WHEN 1 THEN 'verdict+model' ELSE 'verdict+month' END AS level, verdict, model, month, sum(greatest(1, weight))::BIGINT calls, round(sum(cost_usd), 4) spend FROM y GROUP BY GROUPING SETS ((), (verdict), (model), (verdict, model), (verdict, month))",
        "asof_prices": f"WITH p AS (SELECT CAST(o_custkey % {len(T.MODELS)} AS INT) model, o_orderdate since, max(o_totalprice) rate FROM orders GROUP BY 1, 2), l AS (SELECT *, CAST(l_suppkey % {len(T.MODELS)} AS INT) model FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l.model, strftime(l_shipdate, '%Y-%m-%d') ts, strftime(since, '%Y-%m-%d') since, rate FROM l ASOF LEFT JOIN p ON l.model = p.model AND l_shipdate >= since",
        "call_sessions": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM g)
          SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') began, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') ended, count(*) calls, sum(1 + event_id % 3)::BIGINT weight FROM s GROUP BY user_id, k""",
        "sketched_outputs": f"{events} SELECT model, count(DISTINCT out_key) FILTER (out_key <> '') outputs, sum(weight)::BIGINT n, true outputs_near, true median_near, true same_calls FROM k GROUP BY 1",
        "sniffed_formats": "SELECT event_id, ['litellm', 'langfuse', 'generic'][CAST(event_id % 3 AS INT) + 1] AS format FROM events",
        "decision_fields": "SELECT p, correct, question, (SELECT count(*) FROM events WHERE event_id % 4 = k) n, (SELECT count(*) FROM events WHERE event_id % 4 > 1) skipped FROM (VALUES (0, 0.75::DOUBLE, true, ''), (1, 0.25::DOUBLE, false, 'q')) x(k, p, correct, question)",
        "message_texts": "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (text <> ''), '') AS text FROM conversations GROUP BY 1",
        "markdown_cells": f"SELECT doc_id, CASE WHEN length({cell}) > 80 THEN left({cell}, 79) || '…' ELSE {cell} END AS cell FROM documents",
        "strict_verdicts": f"{events}, v AS (SELECT weight, CASE WHEN verdict = 'insufficient' THEN verdict WHEN score >= 0.8 THEN 'likely' WHEN score >= 0.5 THEN 'maybe' ELSE 'unlikely' END verdict FROM s) SELECT verdict, sum(weight)::BIGINT calls FROM v GROUP BY 1",
        "signals_by_value": f"{events}, {why} SELECT * FROM y",
        "top_likely": f"{priced}, {why}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, w.cost_usd DESC, ordinal) place FROM w) SELECT place, source, why FROM t JOIN y USING (call_id) WHERE place <= 10 AND verdict = 'likely'",
        "price_overrides": f"{priced} SELECT model, CASE WHEN normal = 'gpt-4o' THEN 'gpt-4o' WHEN starts_with(normal, 'mystery') THEN 'mystery' ELSE price_key END price_key, CASE WHEN normal = 'gpt-4o' THEN 9 WHEN starts_with(normal, 'mystery') THEN 1 ELSE in_rate END in_rate, CASE WHEN normal = 'gpt-4o' THEN 8 WHEN starts_with(normal, 'mystery') THEN 2 ELSE out_rate END out_rate, is_fallback AND NOT starts_with(normal, 'mystery') is_fallback FROM mp JOIN m USING (model)",
        "label_scores": f"{labelled} SELECT verdict, count(*) calls FROM s GROUP BY 1",
        "read_litellm": f"WITH {_EVENTS} " + read.format("", "litellm", "1", ", call_id"),
        "read_langfuse": f"WITH {_EVENTS} " + read.format("", "langfuse", "1", ", call_id"),
        "read_generic": f"WITH {_EVENTS} " + read.format("", "generic", "weight", ", call_id"),
        "read_usage_csv": f"WITH {_EVENTS} " + read.format("", "generic", "weight", ""),
        "read_decisions": f"WITH {ev} SELECT p, y = 1 correct, 'events' model, question, count(*) n FROM d GROUP BY ALL",
        "verdict_counts": f"{events}, {verdicts} SELECT v.verdict, coalesce(sum(weight), 0)::BIGINT calls FROM v LEFT JOIN s USING (verdict) GROUP BY 1",
        **{f"signal_{n}": f"{events} SELECT call_id, {n} AS value FROM s" for n in S.WEIGHTS},
        "call_scores": f"{events} SELECT call_id, score, verdict FROM s",
        "output_clusters": f"{events} SELECT model, out_key, n::BIGINT n FROM c",
        "corpus_duplication": f"{events} SELECT model, sum(n)::BIGINT total_outputs, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n), 3) dup_rate FROM c GROUP BY 1",
        "model_normalize": f"{priced} SELECT model, normal FROM m",
        "price_lookup": f"{priced} SELECT * FROM mp",
        "call_costs": f"{priced} SELECT call_id, round(cost_usd, 9) cost_usd, price_key, is_fallback, approximated FROM w",
        "spend_by_verdict": f"{both}, {verdicts} SELECT v.verdict, coalesce(sum(weight), 0)::BIGINT calls, round(coalesce(sum(cost_usd), 0), 4) spend FROM v LEFT JOIN w USING (verdict) GROUP BY 1",
        "audit_totals": f"{both} SELECT sum(greatest(1, weight))::BIGINT total_calls, round(sum(cost_usd), 4) total_spend, round(sum(cost_usd) FILTER (verdict IN ('likely', 'maybe')), 4) migratable_spend, (sum(weight) FILTER (price_key = '(logged)'))::BIGINT logged_calls, (sum(weight) FILTER (price_key <> '(logged)'))::BIGINT estimated_calls FROM w",
        "savings_scenarios": f"{both}, x AS (SELECT sum(cost_usd) FILTER (verdict IN ('likely', 'maybe')) m FROM w) SELECT scenario, divisor, round(m * (1 - 1 / divisor), 4) saved FROM x, (VALUES ('conservative', 100::DOUBLE), ('optimistic', 400::DOUBLE)) y(scenario, divisor)",
        "unknown_models": f"{both} SELECT DISTINCT model, '(table median)' priced_at FROM w WHERE is_fallback",
        "distinct_models": f"{both} SELECT DISTINCT model FROM w",
        "models_table": f"{priced} SELECT model, sum(weight)::BIGINT calls, round(sum(cost_usd), 4) AS cost, coalesce(sum(weight) FILTER (verdict = 'likely'), 0)::BIGINT likely FROM w GROUP BY 1",
        "signal_tally": f"{events} " + " UNION ALL ".join(f"SELECT '{n}' AS signal, coalesce(sum(weight) FILTER ({n} > 0), 0)::BIGINT calls FROM s" for n in S.WEIGHTS),
        "top_candidates": f"{priced} SELECT call_id, score, round(cost_usd, 9) cost_usd, verdict FROM w ORDER BY score DESC, w.cost_usd DESC, ordinal LIMIT 10",
        "prompt_clip": f"SELECT doc_id, {clip('text', 440)} AS excerpt FROM documents",
        "output_norm": rf"SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'), '^ | $', '', 'g') AS normal FROM documents",
        "redact_documents": f"SELECT doc_id, {redact} AS safe FROM documents",
        "map_documents": f"SELECT doc_id, {role} AS role, array_to_string(({words})[1:5], ' ') AS template FROM documents",
        "reliability_bins": f"WITH {ev}, {bins} SELECT CAST(i AS INT) bin, round(i / 10, 6) lo, round((i + 1) / 10, 6) hi, coalesce(n, 0) n, round(coalesce(conf, 0), 6) conf, round(coalesce(acc, 0), 6) acc, round(coalesce(acc - conf, 0), 6) gap, round(coalesce(abs(acc - conf), 0), 6) abs_gap FROM range(10) x(i) LEFT JOIN b ON bin = i",
        "calibration_summary": f"WITH {ev}, {bins} SELECT count(*) n, round(avg(y), 6) accuracy, round(avg(p), 6) avg_p, round(avg((p - y) ** 2), 6) brier, 'events' model, round((SELECT sum(n * abs(acc - conf)) / sum(n) FROM b), 6) ece, round((SELECT max(abs(acc - conf)) FROM b), 6) mce FROM d",
        "calibration_groups": f"WITH {lb}, b AS (SELECT question, least(CAST(floor(p * 10) AS INT), 9) bin, count(*) n, sum(p) sp, sum(y) sy FROM d GROUP BY 1, 2) SELECT question, sum(n)::BIGINT n, round(sum(sy)::DOUBLE / sum(n), 6) accuracy, round(sum(abs(sy - sp)) / sum(n), 6) ece, round(sum(sp) / sum(n), 6) avg_p FROM b GROUP BY 1",
        "risk_coverage": f"WITH {ev}, {curve} SELECT k, round(k / n, 6) coverage, round(hits / k, 6) sel_acc, round(p, 6) threshold FROM rc",
        "coverage_table": f"WITH {lb}, {curve}, {levels} {at}",
        "rc_thinned": f"WITH {ev}, {curve} SELECT k, round(k / n, 6) coverage, round(hits / k, 6) sel_acc, round(p, 6) threshold FROM rc WHERE (k - 1) % greatest(1, n // 60) = 0 OR k = n",
        "calibration_compare": f"WITH {levels}, x AS (WITH {lb}, {curve} {at}), z AS (WITH {ev}, {curve} {at}) SELECT level, x.sel_acc candidate, z.sel_acc baseline FROM x JOIN z USING (level)",
        "selfcheck_mock": f"{checked} SELECT *, (choice = 'yes') = (verdict IN ('likely', 'maybe')) agrees FROM o",
        "selfcheck_agreement": f"{checked} SELECT count(*) n, avg(CASE WHEN (choice = 'yes') = (verdict IN ('likely', 'maybe')) THEN 1.0::DOUBLE ELSE 0 END) agreement, 0::BIGINT errors, true mock FROM o",
        "event_json_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events",
        "conversation_calls": f"SELECT conv_id, u.turn, {clip('u.text', 440)} prompt_excerpt, {clip('a.text', 200)} output_excerpt FROM conversations u JOIN conversations a USING (conv_id) WHERE u.role = 'user' AND a.role = 'assistant' AND a.turn = u.turn + 1",
        "decision_maps": f"""{events}, i AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(prompt, '(?i){p}') THEN '{n}'" for p, n in X.ROLES)} ELSE '{X.DEFAULT_ROLE}' END AS role,
          array_to_string(list_filter(regexp_extract_all(lower(prompt), '[a-z'']+'), lambda w: w NOT IN ({stop}))[1:5], ' ') AS template FROM s WHERE verdict = 'likely'),
        a AS (SELECT role, template, sum(weight)::BIGINT calls, min(score) score_low, max(score) score_high, min(prompt) example, list_sort(list(DISTINCT source))[1:5] origins, list_sort(list(DISTINCT out_key) FILTER (out_key <> '')) outs, min_by(out_key, ordinal) FILTER (out_key <> '') first_out,
          bool_and(out_key IN ('yes', 'no', 'true', 'false')) FILTER (out_key <> '') bools, bool_and(regexp_full_match(out_key, '-?[0-9]+(\\.[0-9]+)?')) FILTER (out_key <> '') nums, min(TRY_CAST(out_key AS DOUBLE)) lo, max(TRY_CAST(out_key AS DOUBLE)) hi FROM i GROUP BY 1, 2)
        SELECT role, CASE WHEN template = '' THEN '(mixed)' ELSE template END AS template, CASE WHEN nums THEN 'Score' ELSE 'Choice' END kind, calls, score_low, score_high,
          CASE WHEN nums OR left(first_out, 1) IN ('{{', '[') OR len(outs) > 10 THEN NULL ELSE array_to_string(outs, '|') END AS options, CASE WHEN nums THEN lo END lo, CASE WHEN nums THEN hi END hi, example, array_to_string(origins, '|') origins FROM a""",
    }
