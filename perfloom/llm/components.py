"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfloom.llm.tables import checkpoints


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of `edges` (u, v), both long.

    Each step moves every edge nearer to the smallest node; edges never outnumber the input's. Rows with a null and
    loops are left out. Every step is checkpointed, so that no lineage grows.
    """
    checkpoints(edges.sparkSession)
    e = edges.selectExpr("greatest(u, v) u", "least(u, v) v").where("u is not null and v is not null and u <> v").distinct().checkpoint()
    before = _signature(e)
    while before[0]:
        both = e.unionAll(e.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        # Large star: every neighbour above a node hangs on the node's smallest neighbour.
        e = both.where("v > u").join(least, "u").selectExpr("v u", "m v").where("u <> v")
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").selectExpr("case when v = m then u else v end u", "m v").distinct().checkpoint()
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.selectExpr("u node", "v component").unionAll(e.selectExpr("v node", "v component").distinct())
