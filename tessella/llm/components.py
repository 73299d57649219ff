"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges ``u > v``. Large: every larger neighbour of a node moves to the
    node's smallest; small: so do the node and its smaller neighbours."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return _joined(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _joined(edges, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    # Both sides are read from files, so adaptive execution can split a hub's rows.
    return edges.join(materialise(least, "least"), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node it reaches) of all nodes in links ``u, v``.

    Links go either way, may repeat and may be loops; links with a null end are ignored;
    no links give an empty result. Each step is written to the shared folder.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "links")
    before = None
    while True:
        edges = materialise(_star(edges, large=True).distinct(), "large")
        edges = materialise(_star(edges, large=False).distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
