"""Graphs of claims and sources: components, roles, distances, leverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an undirected edge; root is the least node of its component.

    Alternates two steps that hang nodes below the least node they know: the number of rounds grows with the
    logarithm of the longest path, and every round's lineage ends in a checkpoint.
    """
    now = cut(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u <> v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        now = cut(small.where("u <> v").distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, n_in, n_out, role: thesis, premise, sub or aside."""
    n_in, n_out = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in")), edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    rows = nodes.join(n_in, "node", "left").join(n_out, "node", "left").na.fill(0, ["n_in", "n_out"])
    i, o = F.col("n_in") > 0, F.col("n_out") > 0
    return rows.withColumn("role", F.when(i & ~o, "thesis").when(o & ~i, "premise").when(i & o, "sub").otherwise("aside"))


def theses(classified: DataFrame) -> DataFrame:
    """Nodes that are a thesis, or else those with the most incoming edges."""
    best = classified.agg(F.max("n_in").alias("most"), F.max(F.col("role") == "thesis").alias("found"))
    return classified.join(F.broadcast(best)).where(F.when(F.col("found"), F.col("role") == "thesis").otherwise((F.col("n_in") == F.col("most")) & (F.col("most") > 0))).select("node")


def distances(edges: DataFrame, targets: DataFrame, most: int = 10) -> DataFrame:
    """node, dist: the fewest directed steps to a target, up to ``most``."""
    known = cut(targets.select("node", F.lit(0).alias("dist")))
    frontier = known
    for step in range(1, most + 1):
        reached = edges.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        frontier = cut(reached.join(known, "node", "left_anti").select("node", F.lit(step).alias("dist")))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def leverage(dist: Column, contested: Column, degree: Column) -> Column:
    """Structural leverage of a node on the thesis, before it is divided by the largest."""
    near = F.when(dist > 0, 1.0 / dist).otherwise(0.0)
    return near + F.when(contested, 0.5).otherwise(0.0) + 0.1 * F.least(degree, F.lit(5)) / 5.0
