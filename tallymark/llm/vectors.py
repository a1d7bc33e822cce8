"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors collapse first. Vectors are dealt to shards by hash; in a shard, greedy searches from the
centre propose neighbours for each vector, pruning keeps those that no kept one makes redundant by a factor
ALPHA (Subramanya et al., 2019), and edges are added both ways. Each graph is built once and written with its
vectors. Queries, in blocks, are searched in every shard with a beam; scores are inner products in double precision on the original vectors. Inner products
become distances by one more component that brings all vectors of a shard to one norm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import written

#: Vectors in a shard, about; queries in a block, about.
SHARD, QUERIES = 8192, 4096
#: Edges of a node, beam of the build and of the search, and slack of the pruning.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 48, 96, 1.2
#: Neighbours returned for each query.
K = 20


class Graph:
    """A searchable graph over the rows of a matrix; with ``edges``, one that was built before."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3, edges: np.ndarray | None = None):
        self.vectors = np.asarray(vectors, np.float64)
        x = self.vectors / max(np.abs(self.vectors).max(initial=0.0), 1e-300)
        norms = (x * x).sum(1)
        self.x = np.hstack([x, np.sqrt(np.maximum(0, norms.max(initial=0.0) - norms))[:, None]]).astype(np.float32)
        self.degree, self.alpha = degree, alpha
        n = len(self.x)
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, degree), -1, np.int32) if edges is None else edges
        if n > 1 and edges is None:
            start = min(degree // 2, n - 1)
            self.edges[:, :start] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, start))) % n
        centre = self.x.mean(0) if n else 0
        self.entry = int(((self.x - centre) ** 2).sum(1).argmin()) if n else -1
        order = rng.permutation(n)
        at, step = 0, 256
        while at < n and edges is None:
            self._insert(order[at : at + step], beam)
            at, step = at + step, min(2 * step, 1024)

    def _insert(self, nodes: np.ndarray, beam: int) -> None:
        near, _ = self.search(self.x[nodes], beam)
        back: dict[int, list[int]] = {}
        for i, found in zip(nodes.tolist(), near, strict=True):
            kept = self._prune(i, np.concatenate([found, self.edges[i]]))
            self.edges[i] = -1
            self.edges[i, : len(kept)] = kept
            for j in kept.tolist():
                back.setdefault(j, []).append(i)
        for j, new in back.items():
            row = self.edges[j]
            own = row[row >= 0]
            new = [i for i in new if i not in own]
            if len(own) + len(new) > self.degree:
                own, new = self._prune(j, np.concatenate([own, new])), []
            merged = np.concatenate([own, np.array(new, np.int32)]).astype(np.int32)
            self.edges[j] = -1
            self.edges[j, : len(merged)] = merged

    def _prune(self, i: int, candidates: np.ndarray) -> np.ndarray:
        """Nearest first; a kept neighbour removes those that it is nearer to, by the factor alpha, than i is."""
        c = np.unique(candidates)
        c = c[(c >= 0) & (c != i)]
        v = self.x[c]
        d = ((v - self.x[i]) ** 2).sum(1)
        order = np.argsort(d, kind="stable")
        c, v, d = c[order], v[order], d[order]
        norms = (v * v).sum(1)
        between = np.maximum(0, norms[:, None] + norms[None] - 2 * v @ v.T) * self.alpha**2
        alive = np.ones(len(c), bool)
        kept = []
        for k in range(len(c)):
            if alive[k]:
                kept.append(k)
                if len(kept) == self.degree:
                    break
                alive &= between[k] > d
        return c[kept].astype(np.int32)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for all queries side by side: (nodes, distances), nearest first, -1 where none."""
        b, n = len(queries), len(self.x)
        beam = min(beam, n)
        nodes = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        nodes[:, 0], dist[:, 0], done[:, 0], seen[:, self.entry] = self.entry, ((queries - self.x[self.entry]) ** 2).sum(1), False, True
        norms, own = (self.x * self.x).sum(1), (queries * queries).sum(1)
        while True:
            live = np.flatnonzero(~done.all(1))
            if not len(live):
                return nodes, dist
            first = done[live].argmin(1)
            done[live, first] = True
            reach = self.edges[nodes[live, first]]
            fresh = ~seen[live[:, None], reach] & (reach >= 0)
            seen[live[:, None], np.where(fresh, reach, n)] = True
            some = fresh.any(1)
            live, reach, fresh = live[some], reach[some], fresh[some]
            if not len(live):
                continue
            far = norms[reach] + own[live, None] - 2 * np.matmul(self.x[reach], queries[live, :, None])[:, :, 0]
            far = np.where(fresh, far, np.inf).astype(np.float32)
            all_nodes = np.concatenate([nodes[live], np.where(fresh, reach, -1)], 1)
            all_dist = np.concatenate([dist[live], far], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            order = np.argsort(all_dist, 1, kind="stable")[:, :beam]
            nodes[live], dist[live] = np.take_along_axis(all_nodes, order, 1), np.take_along_axis(all_dist, order, 1)
            done[live] = np.take_along_axis(all_done, order, 1) | ~np.isfinite(dist[live])

    def nearest(self, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of largest inner product found for each query, and the products in double precision; -1 where none."""
        q = np.asarray(queries, np.float64)
        unit = q / np.maximum(np.sqrt((q * q).sum(1)), 1e-300)[:, None]
        out_nodes, out_scores = [], []
        for at in range(0, len(q), 512):
            nodes, _ = self.search(np.hstack([unit[at : at + 512], np.zeros((len(unit[at : at + 512]), 1))]).astype(np.float32), max(beam, k))
            scores = np.where(nodes >= 0, (self.vectors[nodes] * q[at : at + 512, None, :]).sum(2), -np.inf)
            order = np.argsort(-scores, 1, kind="stable")[:, :k]
            out_nodes.append(np.take_along_axis(nodes, order, 1))
            out_scores.append(np.take_along_axis(scores, order, 1))
        return np.concatenate(out_nodes), np.concatenate(out_scores)


def nearest_neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard: int = SHARD, query_block: int = QUERIES, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the k nearest other rows found.

    Nearest first by inner product, ties to the smaller id; all candidates if there are fewer than k. Rows with
    a null id, and vectors that are null, empty, zero, of another length than most, or hold null or non-finite
    components take no part. Repeated ids count once, with the first of their vectors in order, and are asked for if any of their rows is. Of equal vectors only the
    k + 1 smallest ids can be among any k nearest, so a class of equal vectors keeps those; other columns are
    left out. An empty table gives no row.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), is_query.alias("asked")).filter("id is not null and v is not null").filter(sound)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = written(rows.filter(F.size("v") == sizes[0]["d"]).groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")), "vectors")
    ranked = rows.select("id", "v", F.row_number().over(Window.partitionBy("v").orderBy("id")).alias("r")).filter(F.col("r") <= k + 1)
    classes = written(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    shards = max(1, -(-classes.count() // shard))
    asked = rows.filter("asked").select("id", "v")
    blocks = max(1, -(-asked.count() // query_block))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda c: c.map(lambda x: x[0])).reset_index(drop=True)
        return rows.assign(at=np.arange(len(rows), dtype=np.int32), edges=list(Graph(np.stack(rows["v"].to_numpy())).edges))

    dealt = classes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")
    graphs = written(dealt.groupBy("shard").applyInPandas(build, "shard int, v array<double>, ids array<bigint>, at int, edges array<int>"), "graphs")
    base = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    probe = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("to"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("part"), F.col("id").alias("query_id"), F.col("v").alias("q"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "ids": [], "score": []})
        left = left.sort_values("at").reset_index(drop=True)
        graph = Graph(np.stack(left["v"].to_numpy()), edges=np.stack(left["edges"].to_numpy()).astype(np.int32))
        # one more than k, as a query may find itself
        nodes, scores = graph.nearest(np.stack(right["q"].to_numpy()), k + 1, beam)
        at = nodes >= 0
        return pd.DataFrame({"query_id": np.repeat(right["query_id"].to_numpy(), at.sum(1)), "ids": left["ids"].to_numpy()[nodes[at]], "score": scores[at]})

    found = base.groupBy("shard", "block").cogroup(probe.groupBy("to", "part")).applyInPandas(search, "query_id bigint, ids array<bigint>, score double")
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("query_id != vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
