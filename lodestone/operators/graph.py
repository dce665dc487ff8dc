"""Connected components and walks over edge tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut through the shared checkpoint folder; without one, in one JVM alone, through a folder of our own."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of (a, b) edges: each node's least reachable node, by label passing with pointer jumping."""
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp")).withColumnRenamed("x", "node")
    while True:
        labels = cut(labels)
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("comp").alias("m"))
        stepped = labels.join(near, labels.node == near.x).select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        stepped = cut(stepped)
        top = stepped.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        labels = stepped.join(top, "comp").select("node", F.least("comp", "further").alias("comp"))
        if stepped.where("comp < old").isEmpty():
            return stepped.select("node", "comp")


def reachable(edges: DataFrame, start: DataFrame, most: int = 1_000) -> DataFrame:
    """(origin, node): all nodes that directed (src, dst) edges lead to from (origin, node) rows, those included."""
    edges = cut(edges.select("src", "dst").distinct())
    # one table with the round in which a row was found, so that partitions and files don't add up over rounds
    seen = cut(start.select("origin", "node", F.lit(0).alias("_round")).distinct())
    for k in range(most):
        step = seen.where(F.col("_round") == k).join(edges, F.col("node") == edges.src).select("origin", F.col("dst").alias("node"), F.lit(k + 1).alias("_round"))
        seen = cut(seen.unionByName(step).groupBy("origin", "node").agg(F.min("_round").alias("_round")))
        if seen.where(F.col("_round") == k + 1).isEmpty():
            return seen.drop("_round")
    raise ValueError("the walk did not end")
