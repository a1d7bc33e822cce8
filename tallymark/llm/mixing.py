"""Mixing sources to target weights by hash thresholds, without a sort of the documents.

Every document has a hash. A source's threshold is found from histograms: words are summed by source and bucket
of the hash, the bucket in which the source's budget ends is the only one looked at more closely, and so on for
LEVELS nested levels, after which a bucket is one value of the hash. Documents below the threshold are taken; the one
on it is cut so that the source ends on its budget. Budgets above a source's size take whole rounds first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import dropped, written

#: Weights of sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word there is, and times that a source is used at most.
SHARE, MOST = 1.5, 2
#: Bits of the hash that each level of the histograms takes; four levels take all 64.
BITS, LEVELS = 16, 4
#: Keys that a source's rows are spread over where they meet its threshold.
SALTS = 64


def n_words(text: Column) -> Column:
    """How many runs of characters there are that are not ASCII space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with ``place``, from 0 in order of code points, null last. Ranges of names are written and each is numbered
    by itself, after the counts of those before it; the counts are one row for each range."""
    spark = sources.sparkSession
    ranged = written(sources.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return ranged.join(spark.createDataFrame(offsets, "part int, before bigint"), "part").withColumn("place", F.col("before") + within).drop("part", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size): the words that each source gives.

    ``share`` of all words is dealt out by weight; what a source would get beyond ``most`` times its size is dealt out
    again among the others. Each round is one aggregate over the sources and settles those that reach their most; a
    source that is settled stays so, as the level only rises.
    """
    if not weights or min(weights) <= 0 or not 0 <= share <= most:
        raise ValueError("weights have to be positive, and the share between 0 and the most")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights)).cast("int") + 1)
    rows = written(_numbered(sizes).select("source", "source_size", weight.alias("weight")), "sources")
    most_of = F.col("source_size") * most
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, settled = -1.0, -1
    while True:
        full = most_of <= F.col("weight") * level
        r = rows.agg(F.count_if(full).alias("full"), F.coalesce(F.sum(F.when(full, most_of)), F.lit(0)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            return rows.select("source", "source_size", most_of.cast("double").alias("target"))
        rest = total - r["given"]
        if r["full"] == settled:
            return rows.select("source", "source_size", F.when(full, most_of.cast("double")).otherwise(F.col("weight") * rest / r["open"]).alias("target"))
        level, settled = rest / r["open"], r["full"]


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, edge, part): documents whose hash is under ``edge`` give all words, those on it ``part`` of them.

    rows: (source, size, hash); budgets: (source, budget), each above 0 and under the sum of the source's sizes.
    """
    state = budgets.select("source", "budget", F.lit(0.0).alias("below"), F.lit(None).cast("bigint").alias("prefix"), F.lit(None).cast("bigint").alias("inside"))
    for level in range(LEVELS):
        bucket = F.shiftright("hash", 64 - BITS * (level + 1))
        if level:
            up = state.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            inside = rows.join(up, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", 64 - BITS * level) == F.col("p")), "left_semi")
        else:
            inside = rows
        counts = written(inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "histogram")
        edges = counts.join(state.select(F.col("source").alias("s"), "budget", "below"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        edges = edges.withColumn("upto", F.col("below") + running)
        found = edges.filter((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("words") < F.col("budget")))
        new = written(found.select("source", "budget", (F.col("upto") - F.col("words")).alias("below"), F.col("bucket").alias("prefix"), F.col("words").alias("inside")), "edges")
        dropped(counts)
        if level:
            dropped(state)
        state = new
    return state.select("source", F.col("prefix").alias("edge"), ((F.col("budget") - F.col("below")) / F.col("inside")).alias("part"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: the words it has, those of its source, what the source gives, what the mix takes of it.

    A null or empty text has no words and gives none; sources that hold only such rows have a target of 0. A null source is
    a source. Rows of one id and one text are alike: they are taken alike, and on a threshold each gives the same part.
    Rows with a null id are told apart by their texts. Other columns do not matter; an empty table gives no row. Of one
    document at most ``most`` times its words are taken, and each source's words add up to its target but for less than
    one word for each row on the threshold. The same rows give the same mix, however they are dealt out.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(F.col(id_col), text).alias("hash"))
    rows = written(rows, "sizes")  # texts are read once
    goals = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    rounds = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint")
    goals = goals.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    edges = _thresholds(rows, goals.filter("budget > 0").select("source", "budget"))
    every = goals.join(edges.select(F.col("source").alias("s"), "edge", "part"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "budget")
    salted = written(every, "thresholds").withColumnRenamed("source", "s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.pmod(F.shiftright("hash", 7), F.lit(SALTS)) == F.col("salt")))
    extra = F.when(F.col("hash") < F.col("edge"), F.col("size")).when(F.col("hash") == F.col("edge"), F.floor(F.col("size") * F.col("part") + 1e-9)).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + extra).cast("bigint").alias("taken"))
