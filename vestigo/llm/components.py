"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigo.sources.tables import written

#: A node's neighbours are spread over this many join keys, so that a node with very many does not fill one task.
SALTS = 8


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least neighbour of its u, u itself included."""
    least = edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    spread = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                             F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
    return _least_neighbour(down).select(ends).select("e.u", "e.v").filter("u <> v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link to another.

    Nodes are of any type that has an order. Links are undirected; loops, repeats and rows with a null end count for nothing, and no links give an empty
    result. Each round is written to the working folder, so that a lost executor costs one round at most; the driver
    sees two numbers a round.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .filter(f"u <> v and {a} is not null and {b} is not null").distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(_large_star(edges)), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
