"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are grouped minima and equi-joins; a hub's edges are pre-aggregated for the
minimum and split by adaptive execution in the join.  Every round is written to the shared
folder, so the plan stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import written


def _trace(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of ids, either order);
    component is the smallest node reachable.  Loops and repeated edges do no harm."""
    a, b = edges.columns
    known = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges"
    )
    before = _trace(known)
    while True:
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        known = written(small.where("u > v").distinct(), "edges")
        now = _trace(known)
        if now == before:
            break
        before = now
    nodes = known.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = known.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
