"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velaspan.llm.workspace import documents, stored

#: Vectors of a shard: SPREAD for each root of the table's rows, so that shards grow in number and in size, within these bounds.
LEAST_SHARD, SPREAD, MOST_SHARD = 4_096, 64, 262_144
#: Queries of a block, about.
BLOCK = 512
#: Neighbours of a node (twice as many on the lowest level), and beam widths of building and searching.
M, EF_BUILD, EF_SEARCH = 16, 64, 160


def shard_size(rows: int) -> int:
    """Vectors that a shard of a table takes: queries meet a number of shards that grows with the root of the table only."""
    return min(MOST_SHARD, max(LEAST_SHARD, math.ceil(SPREAD * math.sqrt(rows))))


def levels(n: int, m: int, seed: int = 7) -> np.ndarray:
    """How many nodes each level has, the lowest first. Nodes are numbered so that a level holds the first of them."""
    draw = np.random.default_rng(seed).random(n)
    own = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(m)).astype(np.int64), 12)
    return np.array([int((own >= k).sum()) for k in range(int(own.max(initial=0)) + 1)], np.int64)


class Graph:
    """Flat neighbour arrays: ``links[level]`` has a row of node numbers (-1: none) for each of the level's nodes.

    A node's candidates on a level are its ``ef`` nearest there, found by
    blocked matrix products; it keeps up to ``m`` that are nearer to it than to
    each other, then takes in nodes that chose it, nearest choices first.
    """

    def __init__(self, unit: np.ndarray, m: int = M, ef: int = EF_BUILD):
        self.unit, self.m = unit, m
        self.links = [self._level(n, m, 2 * m if k == 0 else m, ef) for k, n in enumerate(levels(len(unit), m).tolist())]

    def _level(self, n: int, m: int, width: int, ef: int) -> np.ndarray:
        unit = self.unit[:n]
        ef = min(ef, n - 1)
        out = np.full((n, width), -1, np.int32)
        if ef < 1:
            return out
        chosen = np.full((n, m), -1, np.int32)
        step = max(1, min(512, 4_000_000 // n))
        for a in range(0, n, step):
            sims = unit[a : a + step] @ unit.T
            rows = np.arange(len(sims))
            sims[rows, a + rows] = -np.inf
            near = np.argpartition(sims, n - ef, axis=1)[:, n - ef :] if ef < n else np.tile(np.arange(n), (len(sims), 1))
            at = np.take_along_axis(sims, near, axis=1)
            order = np.lexsort((near, -at), axis=1)
            near, at = np.take_along_axis(near, order, axis=1), np.take_along_axis(at, order, axis=1)
            chosen[a : a + step] = _spread(near, at, unit, m)
        out[:, :m] = chosen
        # nodes that chose a node: those in whose list it stands first come first
        place = np.repeat(np.arange(m), n)
        source, target = np.tile(np.arange(n), m), chosen.T.reshape(-1)
        back = target >= 0
        source, target = source[back], target[back]
        order = np.lexsort((place[back], target))
        source, target = source[order], target[order]
        mutual = (chosen[target] == source[:, None]).any(axis=1)
        source, target = source[~mutual], target[~mutual]
        spot = np.arange(len(target)) - np.searchsorted(target, target)
        spot += (chosen >= 0).sum(axis=1)[target]
        fits = spot < width
        out[target[fits], spot[fits]] = source[fits]
        return out

    def _beam(self, q: np.ndarray, entry: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest found from the entry points, as (similarity, node), best first."""
        links, unit = self.links[level], self.unit
        seen = {i for _, i in entry}
        todo = [(-s, i) for s, i in entry]
        best = list(entry)
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            near = [j for j in links[i].tolist() if j >= 0 and j not in seen]
            if not near:
                continue
            seen.update(near)
            for sim, j in zip((unit[near] @ q).tolist(), near, strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (sim, j))
                    heapq.heappush(todo, (-sim, j))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, j))
                    heapq.heappush(todo, (-sim, j))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> list[int]:
        at = [(float(self.unit[0] @ q), 0)]
        for level in range(len(self.links) - 1, 0, -1):
            at = self._beam(q, at, 1, level)[:1]
        return [i for _, i in self._beam(q, at, ef, 0)]

    @classmethod
    def of(cls, unit: np.ndarray, links: list[bytes], m: int) -> Graph:
        self = cls.__new__(cls)
        self.unit, self.m = unit, m
        self.links = [np.frombuffer(x, np.int32).reshape(-1, m * (2 if k == 0 else 1)) for k, x in enumerate(links)]
        return self


def _spread(near: np.ndarray, at: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
    """For each row, up to ``most`` of its candidates (nearest first): those nearer to it than to one kept before; the nearest of the rest fill up."""
    own = unit[near]
    between = own @ own.transpose(0, 2, 1)
    kept = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        kept[:, j] = ~((between[:, j] >= at[:, j, None]) & kept).any(axis=1) & (kept.sum(axis=1) < most)
    order = np.argsort(~kept, axis=1, kind="stable")[:, :most]
    out = np.full((len(near), most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, axis=1)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _built(m: int, ef: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # which nodes the upper levels hold depends on their ids only
        group = group.sort_values("rep").sample(frac=1, random_state=7)
        vectors = np.array(group["vector"].tolist(), np.float64)
        members = group["members"].tolist()
        links = [x.tobytes() for x in Graph(_unit(vectors), m, ef).links]
        return pd.DataFrame([{"dim": vectors.shape[1], "shard": group["shard"].iloc[0], "vectors": vectors.tobytes(), "counts": np.array([len(x) for x in members], np.int32).tobytes(), "members": np.concatenate(members).astype(np.int64).tobytes(), "links": links}])

    return run


def _block(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"dim": group["dim"].iloc[0], "query_ids": group["query_id"].to_numpy(np.int64).tobytes(), "query_vectors": np.array(group["vector"].tolist(), np.float64).tobytes()}])


def _searched(k: int, m: int, ef: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                vectors = np.frombuffer(row.vectors, np.float64).reshape(-1, row.dim)
                graph = Graph.of(_unit(vectors), list(row.links), m)
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(row.counts, np.int32).astype(np.int64))])
                members = np.frombuffer(row.members, np.int64)
                norms = np.sqrt((vectors * vectors).sum(axis=1))
                out = []
                for key, q in zip(np.frombuffer(row.query_ids, np.int64).tolist(), np.frombuffer(row.query_vectors, np.float64).reshape(-1, row.dim), strict=True):
                    near = graph.search((q / np.linalg.norm(q)).astype(np.float32), max(ef, 2 * k + 2))
                    scores = (vectors[near] @ q) / (norms[near] * math.sqrt(q @ q))
                    found = [(-s, i) for s, n in zip(scores.tolist(), near, strict=True) for i in members[ends[n] : ends[n + 1]].tolist() if i != key]
                    out += [(key, i, -s) for s, i in heapq.nsmallest(k, found)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, m: int = M, ef_build: int = EF_BUILD, ef_search: int = EF_SEARCH, shard: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by cosine, itself left out.

    ``queries`` has the columns of ``vectors``. Vectors that are null, empty,
    all zero, or hold a null or non-finite component take no part; a query is
    compared with vectors of its own dimension. Score is the cosine of the
    original vectors in double precision; equal scores go to the smaller id.

    Equal vectors are one node with their k + 1 smallest ids (kept by a group
    limit before the shuffle), so a vector that a third of the rows share
    neither breaks the graph nor fills a task. Nodes are dealt by hash into
    shards of about ``shard`` (by default :func:`shard_size`); each shard's
    graph is stored as flat arrays. Blocks of queries are joined to every shard by its number, and shard
    results are merged. Repeated rows count once.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & fine).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))

    ranked = clean(vectors).distinct().withColumn("_n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("_n") <= k + 1)
    nodes = stored(ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.size("vector").alias("dim"), F.col("members")[0].alias("rep"), "vector", "members"), "vectors")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, max(1, -(-n // (shard or shard_size(n)))))]), F.col("dim"))
    parts = 2 * sum(max(1, -(-n // (shard or shard_size(n)))) for n in sizes.values())
    kind = "dim int, shard int, vectors binary, counts binary, members binary, links array<binary>"
    graphs = stored(nodes.withColumn("shard", F.pmod(F.xxhash64("rep"), shards).cast("int")).repartition(parts, "dim", "shard").groupBy("dim", "shard").applyInPandas(_built(m, ef_build), kind), "graphs")
    asked = clean(queries).distinct().withColumn("dim", F.size("vector")).where(F.col("dim").isin(list(sizes)))
    blocks = max(1, -(-asked.count() // BLOCK))
    blocked = asked.withColumnRenamed("id", "query_id").groupBy("dim", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).applyInPandas(_block, "dim int, query_ids binary, query_vectors binary")
    dealt = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    found = dealt.join(graphs, ["dim", "shard"]).repartition(parts * blocks).mapInPandas(_searched(k, m, ef_search), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``embeddings`` whose vec_id divides by 50, each against every other row."""
    vectors = documents(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)
