"""Connected components of a graph of ids, by alternating stars; no step gathers ids or links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import dropped, written


def _signature(edges: DataFrame) -> tuple:
    """Two sets of edges with one signature are the same, but for a chance in 2**64."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id with an edge: the smallest id that it reaches. Loops and nulls are left out.

    Large-star and small-star steps (Kiveris et al., 2014) until no edge changes: each step links the larger
    (or smaller) neighbours of a node to its smallest one. That one is found by a partial aggregate and
    written, so that the join back is one of two shuffled tables: adaptive execution can split a hub's edges.
    Every state is written to the shared folder.
    """
    x, y = F.col(a), F.col(b)
    state = written(edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    now = _signature(state)
    if not now[0]:
        return state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "edges")
        down = written(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "least")
        small = large.join(down, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = written(small.filter("u != v").distinct(), "edges")
        seen, now = now, _signature(new)
        for done in (least, large, down, state):
            dropped(done)
        state = new
        if seen == now:
            return state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
