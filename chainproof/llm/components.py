"""Connected components of a link table, by alternating large-star and small-star steps.

Each step makes one row of each row it reads, joined to the smallest neighbour of a node, so a node
with very many links costs no more than its links; no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainproof.llm.common import written


def _smallest(edges: DataFrame) -> DataFrame:
    """Written, so that the join to it can split a node that has very many links."""
    return written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "smallest")


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that can be reached.
    Null ends are left out; an empty table gives no rows."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct() if now[0] else edges.toDF("id", "component")
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_smallest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        small = large.join(_smallest(large), "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
