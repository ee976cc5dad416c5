"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velaspan.llm.workspace import discard, stored

#: Links that one task writes in a round; each task makes a file, and rounds are many.
LINKS = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each linked node reaches.

    Union-find as alternating star operations: a large star hangs a node's
    greater neighbours on its least one, a small star does so with its lesser
    neighbours. Both are an aggregate by minimum and one equi-join, so a node
    with very many links is pre-aggregated before the shuffle and its join
    partition can be split. The rounds end when the link set stays the same;
    it is then a forest of stars around the least nodes. A round is written by
    as many tasks as the last one's count asks for. Self links are ignored; an
    empty table gives no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    mark, tasks = None, None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lesser, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, edges = edges, stored(small.coalesce(tasks) if tasks else small, "stars")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, tasks = now, 1 + now[0] // LINKS
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
