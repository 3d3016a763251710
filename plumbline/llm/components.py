"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum and a join; no neighbourhood is collected, and lineage is cut after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of one comparable type -> (node, component): the least node of each component, for nodes with an edge."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        stars = materialize(_star(_star(edges, True), False))
        # done when every edge points to a node that points nowhere, and no node points to two
        bad = stars.select(F.col("v").alias("u")).join(stars.select("u"), "u", "left_semi").limit(1).count() or stars.groupBy("u").count().where("count > 1").limit(1).count()
        edges = stars
        if not bad:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
