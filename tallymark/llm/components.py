"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import gathered, stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``; a component is named by its smallest node.

    Each round hangs every node's larger neighbours under the smallest one
    (large-star) and then its smaller neighbours (small-star).  Rounds end when
    all edges form stars.  Nodes are not null; repeated links and links of a node
    with itself change nothing, and no links give no rows.  Each round is written to the shared folder.
    """
    edges = stored(gathered(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    while not _stars(edges):
        # Stored between the stars, because the second reads the first twice.
        edges = stored(gathered(_small_star(stored(gathered(_large_star(edges))))))
    below = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return below.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after further links, stored: the rounds run over the components that the links touch, not over all nodes."""
    known = found.select(F.col("node").alias("at"), "component")
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(known, F.col(end) == F.col("at"), "left").withColumn(end, F.coalesce("component", end)).drop("at", "component")
    touched = stored(gathered(connected_components(ends)))
    moved = touched.select(F.col("node").alias("at"), F.col("component").alias("to"))
    kept = found.join(moved, F.col("component") == F.col("at"), "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(gathered(kept.union(touched.join(found, "node", "left_anti").select("node", "component"))))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Stored, so that the join below is one of two plain exchanges, whose hot nodes Spark can split.
    least = stored(gathered(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
    hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(gathered(edges.groupBy("u").agg(F.min("v").alias("m"))))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one node that hangs under none: then all components are done."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    held = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return held.where("below > 1 or (below = 1 and above = 1)").isEmpty()
