"""Depths in trees of any shape by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def depths(nodes: DataFrame, groups: list[str], node: str, parent: str, step: Column) -> DataFrame:
    """(groups, node, depth, above): the sum of ``step`` over a node and all its ancestors, and the parent of the first of them.

    A node whose parent is null or not there is a root, so ``above`` is null or no node; nodes are unique within their group.  In each round every node jumps to
    the node that its pointer points to and adds what that one has summed, so a chain of n takes log(n) rounds of one join; nodes
    that have arrived are joined no more.  A cycle, in which no node arrives, stops the job.
    """
    spark = nodes.sparkSession
    kind = dict(nodes.dtypes)[node]
    name = lambda i: f"{base}/{i}"
    base = scratch(spark, "tree")
    rows = nodes.select(*groups, F.col(node).alias("_node"), F.col(parent).cast(kind).alias("_up"), step.cast("long").alias("_sum"))
    known = rows.select(*groups, F.col("_node").alias("_up"), F.lit(True).alias("_known"))
    rows = rows.join(known, [*groups, "_up"], "left")
    rows = rows.withColumns({"_up": F.when(F.col("_known"), F.col("_up")), "_above": F.when(F.col("_known").isNull(), F.col("_up"))}).drop("_known")
    rows.write.parquet(name(0))
    n, rounds = spark.read.parquet(name(0)), 0
    most = max(1, n.count()).bit_length() + 1
    while not n.where("_up IS NOT NULL").isEmpty():
        rounds += 1
        if rounds > most:
            raise ValueError("the nodes' parents form a cycle")
        held = n.select(*groups, F.col("_node").alias("_up"), F.col("_up").alias("_next"), F.col("_sum").alias("_more"), F.col("_above").alias("_far"))
        moved = n.where("_up IS NOT NULL").join(held, [*groups, "_up"]).select(*groups, "_node", F.col("_next").alias("_up"), (F.col("_sum") + F.col("_more")).alias("_sum"), F.col("_far").alias("_above"))
        moved.unionByName(n.where("_up IS NULL").select(*groups, "_node", "_up", "_sum", "_above")).write.parquet(name(rounds))
        n = spark.read.parquet(name(rounds))
    return n.select(*groups, F.col("_node").alias(node), F.col("_sum").alias("depth"), F.col("_above").alias("above"))
