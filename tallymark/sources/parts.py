"""Text files read in parts of any size, where what a part means depends on the parts before it.

Spark splits a file into blocks and reads each by itself. Whether a block begins inside quotes, or how deep in brackets, is
known only from all before it. So every block is first summed up as a function of the state that it begins in; these functions,
one row for each block, are composed in order, which gives each block its first state; then blocks are read by
themselves again. No task holds more than a block and one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

def in_block(last: int | None = None) -> WindowSpec:
    """The lines of a block in order, up to ``last`` from the current one."""
    w = Window.partitionBy("path", "block").orderBy("id")
    return w if last is None else w.rowsBetween(Window.unboundedPreceding, last)


def earlier() -> WindowSpec:
    """The blocks of a file before one."""
    return Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def text_rows(spark: SparkSession, paths: list[str], separator: str = "\n") -> DataFrame:
    """(path, block, id, line) of all files in one scan: ``block`` is where a task's part begins in its file, ``id`` orders its lines.

    Paths are decoded, without an empty authority; a byte order mark at the start of a file is left out.
    """
    at = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    rows = spark.read.text(paths, lineSep=separator).select(at.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return rows.withColumn("line", F.when((F.col("block") == 0) & F.startswith("line", F.lit("\ufeff")), F.substring("line", 2, 1 << 30)).otherwise(F.col("line")))


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def list_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, block, id, text, ok): the elements of files that are one JSON list, some in each row and in order.

    ``text`` is a list of one object and what stands before it, or of what follows the last one; ``ok`` is false where a separator
    is wrong. Files are cut at closing braces. Quotes before a piece tell whether it begins in a string, and brackets outside strings
    how deep; a brace at depth 1 ends an element.
    """
    plain = F.regexp_replace("line", r"(?s)\\.", "")
    rows = text_rows(spark, paths, "}").withColumn("plain", plain).withColumn("quotes", _count(F.col("plain"), '"'))
    rows = rows.withColumn("before", F.coalesce(F.sum("quotes").over(in_block(-1)), F.lit(0)))
    states = {}
    for s in (0, 1):  # as if the block began outside a string, and in one
        inside = (F.col("before") + s) % 2
        bare = F.regexp_replace(F.concat(F.when(inside == 1, '"').otherwise(""), "plain"), '"[^"]*(?:"|\\z)', "")
        outside = (F.col("before") + F.col("quotes") + s) % 2 == 0
        states |= {f"out{s}": outside, f"delta{s}": _count(bare, "[{") - _count(bare, "]}") - outside.cast("int")}
    rows = rows.withColumns(states).withColumns({f"depth{s}": F.sum(f"delta{s}").over(in_block(0)) for s in (0, 1)}).drop("plain")
    blocks = rows.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"), F.max("id").alias("last"), *(x for s in (0, 1) for x in (F.sum(f"delta{s}").alias(f"delta{s}"), F.collect_set(F.when(F.col(f"out{s}"), F.col(f"depth{s}"))).alias(f"ends{s}"))))
    blocks = blocks.withColumn("in", (F.coalesce(F.sum("quotes").over(earlier()), F.lit(0)) % 2).cast("int"))
    pick = lambda name: F.when(F.col("in") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    blocks = blocks.withColumn("deep", F.coalesce(F.sum(pick("delta")).over(earlier()), F.lit(0)))
    blocks = blocks.withColumn("ends", F.array_contains(pick("ends"), 1 - F.col("deep")).cast("int"))
    blocks = blocks.withColumn("run", F.coalesce(F.sum("ends").over(earlier()), F.lit(0))).withColumn("final", F.col("block") == F.max("block").over(Window.partitionBy("path")))
    rows = rows.join(blocks.select("path", "block", "in", "deep", "run", "final", "last"), ["path", "block"])
    rows = rows.withColumn("end", pick("out") & (pick("depth") + F.col("deep") == 1) & ~(F.col("final") & (F.col("id") == F.col("last"))))
    # elements before the first end in a block go on from the blocks before it
    rows = rows.withColumn("k", F.coalesce(F.sum(F.col("end").cast("int")).over(in_block(-1)), F.lit(0)))
    ends = F.sum(F.col("end").cast("int")).over(Window.partitionBy("path", "block"))
    rows = rows.withColumn("n", ends).withColumn("run", F.when((F.col("k") == 0) | (F.col("k") == F.col("n")), F.col("run") + (F.col("k") > 0).cast("int")))
    inner = F.when(F.col("run").isNull(), F.struct("block", "k"))
    pieces = rows.groupBy("path", inner.alias("inner"), "run").agg(F.sort_array(F.collect_list(F.struct("block", "id", "line"))).alias("p"), F.max("end").alias("end"))
    # each piece but a file's last had its brace
    joined = F.concat(F.array_join("p.line", "}"), F.when(F.col("end"), "}").otherwise(""))
    texts = pieces.select("path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["id"].alias("id"), joined.alias("t"), "end")
    texts = texts.withColumn("first", (F.row_number().over(in_block()) == 1) & (F.col("block") == 0))
    body = F.regexp_replace("t", r"\A\s*[\[,]", "")
    body = F.when(F.col("end"), body).otherwise(F.regexp_replace(body, r"\]\s*\z", ""))
    blank = ~body.rlike(r"\S")
    starts = F.when(F.col("first"), F.col("t").rlike(r"\A\s*\[")).otherwise(F.col("t").rlike(r"\A\s*,") | (~F.col("end") & F.col("t").rlike(r"\A\s*\]\s*\z")))
    ok = starts & (F.col("end") | F.col("t").rlike(r"\]\s*\z")) & ~(F.col("t").rlike(r"\A\s*,") & blank)
    body = F.when(~F.col("first") & F.col("t").rlike(r"\A\s*\]\s*\z"), "").otherwise(body)
    return texts.select("path", "block", "id", F.concat(F.lit("["), body, F.lit("]")).alias("text"), ok.alias("ok"))


def quoted_rows(spark: SparkSession, paths: list[str], separator: Column) -> DataFrame:
    """(path, block, id, row): rows of files of separated values; a line end inside quotes is part of its row.

    ``separator`` is a column of ``path``. A quote opens a field only at its start, as in Python: elsewhere in an open
    field it is a character, and after the quote that closes one as well.
    """
    rows = text_rows(spark, paths).withColumn("fields", F.split("line", separator))

    def end(state: int) -> Column:
        """Whether a line that begins in a state (1: in quotes) ends in quotes."""

        def step(inside: Column, f: Column) -> Column:
            opens = F.startswith(f, F.lit('"'))
            inner = F.when(inside, f).otherwise(F.substring(f, 2, 1 << 30))
            return (inside | opens) & ~F.contains(F.replace(inner, F.lit('""'), F.lit("")), F.lit('"'))

        return F.when(F.contains("line", F.lit('"')), F.aggregate("fields", F.lit(bool(state)), step)).otherwise(bool(state))

    rows = rows.withColumns({"end0": end(0), "end1": end(1)}).drop("fields")
    rows = rows.withColumn("swaps", F.sum((F.col("end0") & ~F.col("end1")).cast("int")).over(in_block(0)))
    settled = F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").cast("int").alias("v"), F.col("swaps").alias("c")))
    rows = rows.withColumn("settled", settled)
    rows = rows.withColumns({"known": F.last("settled", True).over(in_block(-1)), "upto": F.coalesce(F.max("swaps").over(in_block(-1)), F.lit(0))})

    def begins(start: Column) -> Column:
        """1 where a line begins in quotes, from the state that its block begins in."""
        return F.when(F.col("known").isNull(), (start + F.col("upto")) % 2).otherwise((F.col("known.v") + F.col("upto") - F.col("known.c")) % 2)

    rows = rows.withColumns({f"in{s}": begins(F.lit(s)) for s in (0, 1)})
    blocks = rows.groupBy("path", "block").agg(F.max("swaps").alias("swaps"), F.max_by("settled", F.when(F.col("settled").isNotNull(), F.col("id"))).alias("settled"), *(F.max(F.when(F.col(f"in{s}") == 0, F.col("id"))).alias(f"row{s}") for s in (0, 1)))
    blocks = blocks.withColumn("total", F.sum("swaps").over(earlier())).withColumn("all", F.coalesce("total", F.lit(0)) + F.col("swaps"))
    known = F.last(F.when(F.col("settled").isNotNull(), F.struct(F.col("settled.v").alias("v"), (F.col("all") - F.col("swaps") + F.col("settled.c")).alias("c"))), True).over(earlier())
    blocks = blocks.withColumn("known", known).withColumn("start", F.when(F.col("known").isNull(), F.coalesce("total", F.lit(0)) % 2).otherwise((F.col("known.v") + F.col("total") - F.col("known.c")) % 2))
    row = F.when(F.col("start") == 1, F.col("row1")).otherwise(F.col("row0"))
    blocks = blocks.withColumn("earlier", F.last(F.when(row.isNotNull(), F.struct("block", row.alias("id"))), True).over(earlier()))
    rows = rows.join(blocks.select("path", "block", "start", "earlier"), ["path", "block"])
    inside = F.when(F.col("start") == 1, F.col("in1")).otherwise(F.col("in0")) == 1
    after = F.when(inside, F.col("end1")).otherwise(F.col("end0"))
    rows = rows.select("path", "block", "id", "line", "earlier", inside.alias("inside"), after.alias("after"))
    single = rows.filter("not inside and not after").select("path", "block", "id", F.col("line").alias("row"))
    owner = F.coalesce(F.last(F.when(~F.col("inside"), F.struct("block", "id")), True).over(in_block(0)), F.col("earlier"), F.struct("block", "id"))
    several = rows.withColumn("owner", owner).filter("inside or after").groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "id", "line"))).alias("p"))
    return single.unionByName(several.select("path", "owner.block", "owner.id", F.array_join("p.line", "\n").alias("row")))
