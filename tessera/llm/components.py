"""Connected components by alternating stars, entirely in DataFrames.

Each round halves chains roughly and costs two key-aggregations; nothing is
collected. Every round is checkpointed to the shared folder, so the plan stays
short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def _star(edges: DataFrame) -> DataFrame:
    """Link every node's larger neighbours, and the node itself, to its smallest neighbour.

    ``edges`` has u > v. A minimum by key and a join on that key replace gathering
    a neighbourhood, so a node with very many neighbours costs no memory.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.filter("u > m").select("u", F.col("m").alias("v"))
    return larger.union(own).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node's smaller neighbours, and the node itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of sortable ids to ``(node, root)``, root the smallest id reachable.

    Nodes without an edge do not appear. Self-links, repeated and reversed edges
    are allowed; null ends are ignored. An empty input gives an empty result.
    """
    work = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    work = checkpointed(work.filter("u > v").distinct())
    before = None
    for _ in range(max_rounds):
        work = checkpointed(_small_star(_star(work)))
        now = work.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = work.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(work.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
