"""Readers of logged calls (JSONL, NDJSON, JSON, CSV, TSV) and of decisions, into the fixed schemas.

All files of a kind are read in one scan, in parts; a file's name, format and place are columns from small tables. JSON is
checked and read as Python reads it (NaN, repeated keys of which the last counts, nothing after a value), each record once,
into the fields that some format knows, as variants; field names are looked up by alias in order. A list of any length is
read in parts, too, and so are rows with line ends inside quotes. Formats are told by the first record of a file.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions.signals import is_json
from tallymark.functions.text import clipped, stripped
from tallymark.session import staged
from tallymark.sources.parts import list_elements, quoted_rows, text_rows

#: Suffixes that are read.
SUFFIXES = (".jsonl", ".ndjson", ".json", ".csv", ".tsv")
#: Names of fields, first one first.
INPUT_TOKENS = "input_tokens prompt_tokens input_token_count prompt_token_count".split()
OUTPUT_TOKENS = "output_tokens completion_tokens output_token_count completion_token_count".split()
USAGE_INPUT = "input_tokens prompt_tokens input prompt".split()
USAGE_OUTPUT = "output_tokens completion_tokens output completion".split()
COST = "cost cost_usd total_cost response_cost amount spend_usd totalCost".split()
PROMPT = "prompt input_text question user_message input".split()
OUTPUT = "output completion response output_text answer".split()
COUNT = "request_count n_requests requests row_count n".split()
TIME = "timestamp created_at ts date day time".split()
MODEL = "model model_name model_slug name".split()
P = "p prob probability confidence conf".split()
CORRECT = "correct is_correct outcome label_ok hit".split()
#: Fields that are looked at, in one list.
FIELDS = list(dict.fromkeys(["id", "request_id", "row_id", *MODEL, *INPUT_TOKENS, *OUTPUT_TOKENS, "usage", *COST, "calculatedTotalCost", *PROMPT, *OUTPUT, "messages", "body", *COUNT, *TIME, "call_type_ts", "startTime"]))
#: What a call has.
CALLS = "call_id string, source string, format string, model string, input_tokens bigint, output_tokens bigint, prompt_excerpt string, output_excerpt string, logged_cost_usd double, timestamp string, weight bigint, ordinal bigint"
#: What Python's splitlines() splits at.
LINES = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def field(v: Column, *names: str) -> Column:
    """The first of the named fields that is neither missing, null nor an empty string, as a variant."""
    found = [F.try_variant_get(v, f"$['{n}']" if "." not in n else "$" + "".join(f"['{x}']" for x in n.split(".")), "variant") for n in names]
    text = [F.try_variant_get(x, "$", "string") for x in found]
    return F.coalesce(*(F.when(t.isNotNull() & (t != ""), x) for x, t in zip(found, text, strict=True)))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def as_text(v: Column) -> Column:
    """A variant's string; null unless it is one."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number(text: Column) -> Column:
    """The number that Python reads in a text: space around it and single underscores between digits pass, a letter after it does not."""
    t = stripped(text)
    digits = r"[0-9]+(?:_[0-9]+)*"
    plain = t.rlike(rf"\A[+-]?(?:{digits}\.?(?:{digits})?|\.{digits})(?:[eE][+-]?{digits})?\z")
    return F.when(plain, F.translate(t, "_", "").try_cast("double")).when(t.rlike(r"(?i)\A[+-]?(?:inf|infinity|nan)\z"), t.try_cast("double"))


def as_float(v: Column) -> Column:
    return F.when(kind(v) != "BOOLEAN", number(F.try_variant_get(v, "$", "string")))


def as_int(v: Column) -> Column:
    """Truncated to a whole number; true and false are none."""
    return as_float(v).try_cast("bigint")


def text_of(v: Column) -> Column:
    """A content: a string, or a list of strings and of objects with text or content, joined by line ends."""
    parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(as_text(x), as_text(field(x, "text", "content")), F.lit("")))
    return F.coalesce(as_text(v), F.array_join(F.filter(parts, lambda t: t != ""), "\n"), F.lit(""))


def messages_text(v: Column) -> Column:
    parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda m: F.coalesce(as_text(m), text_of(F.try_variant_get(m, "$.content", "variant")), F.lit("")))
    return F.coalesce(F.array_join(F.filter(parts, lambda t: t != ""), "\n"), F.lit(""))


def sniffed(v: Column) -> Column:
    """The format that a record shows."""
    keys = F.transform(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.lower)
    usage = F.map_keys(F.try_variant_get(v, "$.usage", "map<string,variant>"))

    def has(keys: Column, *names: str) -> Column:
        return F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, names))), F.lit(False))

    return (
        F.when(has(keys, "messages", "response_cost"), "litellm")
        .when(F.coalesce(F.lower(as_text(field(v, "type"))) == "generation", F.lit(False)) | has(keys, "totalcost", "calculatedtotalcost"), "langfuse")
        .when(has(usage, "prompt_tokens", "completion_tokens") & ~has(usage, "input"), "litellm")
        .when(has(usage, "input") & has(usage, "output") & ~has(usage, "prompt_tokens"), "langfuse")
        .otherwise("generic")
    )


def _named(path: str) -> str:
    """The suffix of a path."""
    return os.path.splitext(path)[1].lower()


def expand(path: str, spark: SparkSession | None = None) -> list[str]:
    """A file, or the files of a folder by suffix, sorted within each. A folder that has a suffix is a file in parts.

    Folders of other stores than the local one are listed by Spark.
    """
    if _named(path) in SUFFIXES:
        return [path]
    if "://" in path and spark is not None:
        either = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in SUFFIXES)
        names = sorted(unquote(n) for n in spark.read.option("pathGlobFilter", f"*{{{either}}}").text(path).inputFiles())
    elif os.path.isdir(path):
        names = [os.path.join(path, n) for n in sorted(os.listdir(path))]
    else:
        return [path]
    return [n for s in SUFFIXES for n in names if n.lower().endswith(s)]


def _files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """(key, place, file, flat) of each file in order, and the paths of JSON and of flat ones. A local path has to exist, others are left to Spark."""
    rows = []
    for i, p in enumerate(paths):
        if _named(p) not in SUFFIXES:
            raise ValueError(f"unsupported suffix: {p}")
        if "://" not in p and not os.path.exists(p):
            raise FileNotFoundError(p)
        key = p if "://" in p else f"file:{os.path.abspath(p)}"
        rows.append((re.sub("^file:/+", "file:/", key.rstrip("/")), i, key.rstrip("/").rpartition("/")[2], _named(p) in (".csv", ".tsv")))
    table = spark.createDataFrame(rows, "key string, place bigint, file string, flat boolean")
    return table, [p for p, r in zip(paths, rows, strict=True) if not r[3]], [p for p, r in zip(paths, rows, strict=True) if r[3]]


def _key() -> Column:
    """The file that a path is, or is a part of."""
    parent = F.regexp_replace("path", r"/[^/]*\z", "")
    named = rf"(?i)(?:{'|'.join(re.escape(s) for s in SUFFIXES)})\z"
    return F.when(parent.rlike(named), parent).otherwise(F.col("path"))


def pieces(line: Column) -> Column:
    """The lines that Python makes of one between line feeds, stripped, without blank ones."""
    some = F.when(line.rlike(LINES), F.split(line, LINES)).otherwise(F.array(line))
    return F.filter(F.transform(some, lambda x: stripped(x)), lambda x: x != "")


def variant_of(text: Column) -> Column:
    """A text that is_json() passes as a variant; of repeated keys the last counts, NaN and infinities are strings."""
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))  # control characters are in no valid text
    parts = F.transform(F.split(hidden, '"', -1), lambda t, i: F.when(i % 2 == 0, F.regexp_replace(t, "(-?Infinity|NaN)", '"$1"')).otherwise(t))
    quoted = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.try_parse_json(F.when(F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity")), quoted).otherwise(text))


def _members(v: Column) -> Column:
    """The objects of a list, as texts."""
    return F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)), lambda t: F.startswith(t, F.lit("{")))


def objects(piece: Column, data: bool = False) -> Column:
    """The objects that a JSON text holds, itself or in its list, as texts; null for a text that is no JSON.

    ``data``: the text is a whole file, so that an object with a list under ``data`` stands for that.
    """
    found = F.when(F.startswith(piece, F.lit("{")), F.array(piece)).when(F.startswith(piece, F.lit("[")), _members(variant_of(piece))).otherwise(F.array().cast("array<string>"))
    if data:
        under = F.try_variant_get(variant_of(piece), "$.data", "variant")
        found = F.when(F.startswith(piece, F.lit("{")) & F.contains(piece, F.lit('"data"')), F.coalesce(_members(under), found)).otherwise(found)
    return F.when(is_json(piece), found)


@contextmanager
def last_key_counts(spark: SparkSession) -> Iterator[None]:
    """Within, variants are made of objects with repeated keys, of which the last counts."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def record(text: Column, fields: list[str]) -> Column:
    """An object's text as a struct of variants, one for each field, parsed once. An object that repeats a key deeper down is written anew before."""
    schema = ", ".join(f"`{n}`: variant" for n in [*fields]) + ", `(not read)` string"
    how = {"columnNameOfCorruptRecord": "(not read)"}
    first = F.from_json(text, f"struct<{schema}>", how)
    return F.transform(F.array(first), lambda r: F.when(r["(not read)"].isNull(), r).otherwise(F.from_json(F.to_json(variant_of(text)), f"struct<{schema}>", how)))[0]


def _in_order(rows: DataFrame) -> DataFrame:
    """rows of (path, block, id, i, j, before) with ``ordinal`` in their file; ``before``: the rows of the blocks before theirs."""
    here = F.row_number().over(Window.partitionBy("path", "block").orderBy("id", "i", "j"))
    return rows.withColumn("ordinal", F.col("before") + here).drop("before")


def _about(blocks: DataFrame, files: DataFrame, fmt: str | None) -> DataFrame:
    """(path, block, before, place, file, fmt) of each block, written: its size is known, so that a small one is broadcast, and
    a large one met by blocks. By files, all rows of a large one would be in one task.
    """
    earlier = Window.partitionBy("key").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.groupBy("key").agg(F.min_by("head", F.when(F.col("head").isNotNull(), F.struct("path", "block"))).alias("head"))
    told = F.lit(fmt) if fmt else F.when(F.col("head").isNotNull(), sniffed(variant_of(F.col("head")))).otherwise("generic")
    of_file = heads.join(files, "key").select("key", "place", "file", F.when(F.col("flat"), "generic").otherwise(told).alias("fmt"))
    before = blocks.select("key", "path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return staged(before.join(of_file, "key").drop("key"))


def _json(spark: SparkSession, paths: list[str], files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, path, block, id, i, j, text) of each object, and (key, path, block, n, bad, head) of each part of a file: objects, lines that are no JSON, first object.

    One pass tells what parts have; the objects are read in another. Files that begin as a list are tried as one.
    """
    lines = text_rows(spark, paths).filter(F.col("line").rlike(r"(?U)\S")).withColumn("key", _key())
    found = lines.select("key", "path", "block", "id", "line", F.posexplode(pieces(F.col("line"))).alias("i", "piece")).withColumn("o", objects(F.col("piece")))
    at = F.struct("id", "i")
    odd = (F.col("i") == 0) & (F.contains("line", F.lit('"data"')) | F.col("line").rlike(LINES))  # may be read otherwise if it is the only one
    blocks = staged(
        found.groupBy("key", "path", "block").agg(
            F.sum(F.coalesce(F.size("o"), F.lit(0))).cast("bigint").alias("n"), F.count_if(F.col("o").isNull()).alias("bad"), F.count_if(F.col("i") == 0).alias("lines"), F.min_by(F.substring("piece", 1, 1), at).alias("begins"),
            F.min_by(F.get("o", F.lit(0)), F.when(F.size("o") > 0, at)).alias("head"), F.min_by(F.when(odd, F.col("line")), at).alias("first"),
        )
    )
    files_seen = blocks.groupBy("key").agg(F.sum("lines").alias("lines"), F.min_by("begins", F.struct("path", "block")).alias("begins"))
    single = files_seen.filter("lines = 1 and begins = '{'").select("key", F.lit(True).alias("single"))
    blocks = blocks.join(single, "key", "left").withColumn("u", F.when(F.col("single") & F.col("first").isNotNull(), objects(stripped(F.col("first")), data=True)))
    one = F.col("u").isNotNull()
    n, bad, head = (F.when(one, x).otherwise(F.col(c)).alias(c) for x, c in ((F.size("u").cast("bigint"), "n"), (F.lit(0).cast("bigint"), "bad"), (F.get("u", F.lit(0)), "head")))
    blocks = blocks.select("key", "path", "block", n, bad, head)
    rows = lines.join(single, "key", "left").withColumn("u", F.when(F.col("single"), objects(stripped(F.col("line")), data=True)))
    rows = rows.select("key", "path", "block", "id", "u", F.posexplode(F.when(one, F.array("line")).otherwise(pieces(F.col("line")))).alias("i", "piece"))
    rows = rows.select("key", "path", "block", "id", "i", F.posexplode(F.when(one, F.col("u")).otherwise(objects(F.col("piece")))).alias("j", "text"))
    listed = [r["path"] for r in blocks.select("path").join(files_seen.filter("begins = '['"), F.col("key") == F.col("path"), "left_semi").distinct().collect()]  # paths that a scan lists anyway
    if listed:
        elements = staged(list_elements(spark, listed).withColumn("o", F.when(F.col("ok"), objects(F.col("text")))))
        good = elements.groupBy("path").agg(F.bool_and(F.col("o").isNotNull()).alias("good")).filter("good").select(F.col("path").alias("key"))
        of_lists = elements.join(good, F.col("path") == F.col("key"))
        listed_rows = of_lists.select("key", "path", "block", "id", F.lit(0).alias("i"), F.posexplode("o").alias("j", "text"))
        size = F.size("o").cast("bigint")
        listed_blocks = of_lists.groupBy("key", "path", "block").agg(F.sum(size).alias("n"), F.lit(0).cast("bigint").alias("bad"), F.min_by(F.get("o", F.lit(0)), F.when(F.size("o") > 0, F.col("id"))).alias("head"))
        rows = rows.join(good, "key", "left_anti").unionByName(listed_rows)
        blocks = blocks.join(good, "key", "left_anti").unionByName(listed_blocks)
    return rows, blocks


def _flat(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same of rows of separated values: objects of strings, names stripped and in lower case, of equal names the last."""
    tabs = F.lower(_key()).endswith(".tsv")
    # written once: finding the row ends shuffles the lines, and rows are read for the names, for the counts and for the calls
    rows = staged(quoted_rows(spark, paths, F.when(tabs, "\t").otherwise(",")).withColumn("row", F.regexp_replace("row", "\r\\z", "")).filter("row != ''"))
    heads = staged(rows.groupBy("path").agg(F.min_by("row", F.struct("block", "id")).alias("head"), F.min(F.struct("block", "id")).alias("at")))  # of known size, so broadcast if small
    wide = heads.agg(F.max(F.length("head") - F.length(F.translate("head", ",\t", "")))).first()[0]  # one row for each file
    schema = ", ".join(f"c{i} string" for i in range((wide or 0) + 1))

    def values(row: Column) -> Column:
        how = {"escape": '"', "quote": '"', "maxCharsPerColumn": "-1", "maxColumns": str((wide or 0) + 100_000)}
        by = [F.from_csv(row, schema, how | {"sep": sep}) for sep in (",", "\t")]
        return F.transform(F.array(F.when(tabs, by[1]).otherwise(by[0])), lambda r: F.array(*(r[f"c{i}"] for i in range((wide or 0) + 1))))[0]

    names = F.transform(values(F.col("head")), lambda n: F.lower(stripped(F.coalesce(n, F.lit("")))))
    used = F.length("head") - F.length(F.translate("head", ",\t", "")) + 1
    heads = heads.withColumn("names", F.slice(names, 1, used))
    kept = F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda i: ~F.array_contains(F.slice("names", i + 2, F.size("names")), F.get("names", i)))
    heads = heads.withColumn("kept", kept).select("path", "at", "kept", F.transform("kept", lambda i: F.get("names", i)).alias("names"))
    joined = rows.join(heads, "path").filter(F.struct("block", "id") > F.col("at")).withColumn("values", values(F.col("row")))
    text = F.to_json(F.map_from_arrays("names", F.transform("kept", lambda i: F.get("values", i))))
    found = joined.select(_key().alias("key"), "path", "block", "id", F.lit(0).alias("i"), F.lit(0).alias("j"), text.alias("text"))
    return found, found.groupBy("key", "path", "block").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("bad"), F.lit(None).cast("string").alias("head"))


def first_of(*columns: Column) -> Column:
    """The first variant that is neither missing, null nor an empty string."""
    text = [F.try_variant_get(x, "$", "string") for x in columns]
    return F.coalesce(*(F.when(t.isNotNull() & (t != ""), x) for x, t in zip(columns, text, strict=True)))


def _aliases(r: Column) -> dict[str, dict[str, Column]]:
    """For each format, the variants that its columns are made of."""

    def first(*names: str) -> Column:
        return first_of(*(r[n] for n in names))

    def used(*names: str) -> Column:
        return first_of(*(F.try_variant_get(r["usage"], f"$.{n}", "variant") for n in names))

    return {
        "litellm": {"model": first("model", "model_name"), "input": used("prompt_tokens", "input_tokens"), "output": used("completion_tokens", "output_tokens"), "cost": first("response_cost", "cost", "cost_usd"), "time": first("timestamp", "created_at", "ts", "call_type_ts"), "asked": r["messages"], "answer": r["response"], "count": F.lit(None).cast("variant")},
        "langfuse": {"model": first("model", "model_name"), "input": used("input", "prompt_tokens", "input_tokens"), "output": used("output", "completion_tokens", "output_tokens"), "cost": first("totalCost", "calculatedTotalCost", "cost", "cost_usd"), "time": first("timestamp", "startTime", "created_at"), "asked": r["input"], "answer": r["output"], "count": F.lit(None).cast("variant")},
        "generic": {"model": first(*MODEL), "input": first(*INPUT_TOKENS), "output": first(*OUTPUT_TOKENS), "cost": first(*COST), "time": first(*TIME), "asked": first(*PROMPT), "answer": first(*OUTPUT), "count": first(*COUNT)},
    }


def normalised(rows: DataFrame) -> DataFrame:
    """(text, fmt and other columns) with the columns of a call, texts clipped."""
    of = rows.withColumn("r", record(F.col("text"), FIELDS))
    by = _aliases(F.col("r"))
    fmt = F.col("fmt")
    chosen = {c: F.when(fmt == "litellm", by["litellm"][c]).when(fmt == "langfuse", by["langfuse"][c]).otherwise(by["generic"][c]) for c in by["generic"]}
    used = {f"used_{side}": F.when(fmt == "generic", first_of(*(F.try_variant_get(F.col("r.usage"), f"$.{n}", "variant") for n in names))) for side, names in (("input", USAGE_INPUT), ("output", USAGE_OUTPUT))}
    body = {"body": F.when(fmt == "langfuse", F.try_variant_get(F.col("r.body"), "$.messages", "variant"))}
    name = {"name": first_of(*(F.col("r")[n] for n in ("id", "request_id", "row_id")))}
    of = of.select(*(c for c in rows.columns if c != "text"), *(x.alias(f"v_{n}") for n, x in (chosen | used | body | name).items()))
    # each text is made once, from the variant that its format chose
    v = {n: F.col(f"v_{n}") for n in (*chosen, *used, "body", "name")}
    is_list = lambda x: F.coalesce(F.size(F.try_variant_get(x, "$", "array<variant>")) >= 0, F.lit(False))
    choice = lambda x: F.try_variant_get(x, "$.choices[0].message.content", "variant")
    either = lambda x: F.when(is_list(x), messages_text(x)).otherwise(F.coalesce(as_text(x), F.lit("")))
    inputs = text_of(v["asked"])
    prompt = F.when(fmt == "litellm", messages_text(v["asked"])).when(fmt == "langfuse", F.when(inputs != "", inputs).otherwise(messages_text(v["body"]))).otherwise(either(v["asked"]))
    opened = F.when(fmt == "langfuse", v["answer"]).otherwise(F.coalesce(choice(v["answer"]), v["answer"]))
    of = of.withColumn("answer", opened)
    output = F.when(fmt == "generic", either(F.col("answer"))).otherwise(text_of(F.col("answer")))
    count = as_int(v["count"])
    return of.select(
        *(c for c in rows.columns if c != "text"), F.try_variant_get(v["name"], "$", "string").alias("call_id"), F.coalesce(F.try_variant_get(v["model"], "$", "string"), F.lit("unknown")).alias("model"),
        F.coalesce(as_int(v["input"]), as_int(v["used_input"])).alias("input_tokens"), F.coalesce(as_int(v["output"]), as_int(v["used_output"])).alias("output_tokens"),
        clipped(prompt).alias("prompt_excerpt"), clipped(output, limit=200).alias("output_excerpt"), as_float(v["cost"]).alias("logged_cost_usd"), as_text(v["time"]).alias("timestamp"), F.when(count != 0, count).otherwise(F.lit(1).cast("bigint")).alias("weight"),
    )


def read_files(spark: SparkSession, paths: list[str], fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls, one row of ``skipped``) of files in order, in one plan whatever their number. CSV and TSV are generic whatever ``fmt`` says.

    ``ordinal`` has a file's place in its upper bits and a record's place in the file, from 1, in the lower 40.
    """
    table, texts, flats = _files(spark, paths)
    with last_key_counts(spark):
        kinds = ([_json(spark, texts, table)] if texts else []) + ([_flat(spark, flats)] if flats else [])
        every = []
        for rows, blocks in kinds:
            every.append(_in_order(normalised(rows.drop("key").join(_about(blocks, table, fmt), ["path", "block"]))))
        skipped = reduce(DataFrame.unionByName, (b.select("bad") for _, b in kinds)).agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("skipped"))
    rows = reduce(DataFrame.unionByName, every)
    source = F.concat("file", F.lit("#L"), F.col("ordinal").cast("string"))
    names = [c.split()[0] for c in CALLS.split(", ")]
    rows = rows.withColumn("source", source).withColumn("call_id", F.coalesce("call_id", "source")).withColumnRenamed("fmt", "format")
    return rows.withColumn("ordinal", F.col("ordinal") + F.col("place") * F.lit(1 << 40)).select(*names), skipped


def read_calls(spark: SparkSession, path: str, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """read_files() of one file."""
    return read_files(spark, [path], fmt)


def read_all(spark: SparkSession, paths: list[str], fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """read_files() of files and of the files in folders, ordinals running on from file to file."""
    found = [f for p in paths for f in expand(p, spark)]
    if not found:
        raise ValueError("no readable files")
    return read_files(spark, found, fmt)


def united(frames: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """What read_calls() gave for several files as one."""
    if not frames:
        raise ValueError("no readable files")
    calls = reduce(DataFrame.unionByName, (c.withColumn("ordinal", F.col("ordinal") + F.lit(i) * F.lit(1 << 40)) for i, (c, _) in enumerate(frames)))
    return calls, reduce(DataFrame.union, (s for _, s in frames)).agg(F.sum("skipped").alias("skipped"))


def as_bool(v: Column) -> Column:
    """Booleans, numbers (not 0), and the words for hit and miss."""
    s = F.lower(F.trim(F.try_variant_get(v, "$", "string")))
    number = F.when(kind(v) != "STRING", F.try_variant_get(v, "$", "double"))
    words = F.when(s.isin("true", "yes", "y", "1", "hit", "correct"), True).when(s.isin("false", "no", "n", "0", "miss", "incorrect"), False)
    return F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind(v) == "STRING", words).when(number.isNotNull(), number != 0)


def read_decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, one row of ``skipped``) of a JSONL file; ``ordinal`` sorts by file, part of it and line.

    Each key is taken at its last place in the record; of the names for one thing the first that is there counts, even if it is null.
    """
    with last_key_counts(spark):
        lines = text_rows(spark, [path]).filter(F.col("line").rlike(r"(?U)\S")).select(F.struct("path", "block", "id").alias("at"), F.posexplode(pieces(F.col("line"))).alias("i", "piece"))
        ok = F.startswith("piece", F.lit("{")) & is_json(F.col("piece"))
        rows = lines.withColumn("r", F.when(ok, record(F.col("piece"), list(dict.fromkeys([*P, *CORRECT, "model", "question"])))))
    # a key that is there is a variant, be it that of null
    p, c = (F.coalesce(*(F.col("r")[n] for n in names)) for names in (P, CORRECT))
    rows = rows.select("at", "i", as_float(p).alias("p"), as_bool(c).alias("correct"), as_text(F.col("r")["model"]).alias("model"), as_text(F.col("r")["question"]).alias("question"))
    good = F.coalesce(F.col("p").between(0, 1) & ~F.isnan("p") & F.col("correct").isNotNull(), F.lit(False))
    kept = rows.filter(good).select("p", "correct", F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("question", F.lit("")).alias("question"), F.struct("at", "i").alias("ordinal"))
    return kept, rows.agg(F.count_if(~good).alias("skipped"))
