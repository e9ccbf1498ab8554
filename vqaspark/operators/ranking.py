"""Positions, running sums, samples and shards without a single-task window.

Ranks come from two levels: the rows of each coarse key are counted, the counts are summed in order (a row for each key, not
for each row of data), and a window numbers the rows within a coarse key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str = "pos", value: Column | None = None) -> DataFrame:
    """df with the 0-based rank (or the sum of ``value`` before the row) within its groups by ``order``, and the group's total.

    Rows are dealt into ranges of (groups, order, place in the input), so neither a great group nor an often repeated key is one
    task's; the counts of the ranges, a row for each range and group, are summed in order.  Rows that are alike come in any order;
    null groups are groups, null keys come first.  df is evaluated twice, the first time to find the ranges: what is costly is better staged.
    """
    value = F.lit(1) if value is None else value
    keys = [*groups, *order, "_tie"]
    rows = df.withColumns({"_value": value.cast("long"), "_tie": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    path = scratch(df.sparkSession, "numbered")
    rows.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    sums = rows.groupBy(*groups, "_part").agg(F.sum("_value").alias("_n"))
    ordered = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_before")
    sums = sums.select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.col("_part").alias("_p"), before, F.sum("_n").over(Window.partitionBy(*groups)).alias(f"{name}_total"))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    within = Window.partitionBy(*groups, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, same).withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return joined.select(*df.columns, name, f"{name}_total")


def ranked(df: DataFrame, groups: list[str], coarse: Column, fine: list, name: str = "pos", value: Column | None = None) -> DataFrame:
    """df with the 0-based rank (or the sum of ``value`` before the row) within its groups, by (coarse, fine), and the group's total."""
    value = F.lit(1) if value is None else value
    rows = df.withColumn("_coarse", coarse).withColumn("_value", value.cast("long"))
    sums = rows.groupBy(*groups, "_coarse").agg(F.sum("_value").alias("_n"))
    ordered = Window.partitionBy(*groups).orderBy("_coarse")
    whole = Window.partitionBy(*groups)
    sums = sums.select(*groups, "_coarse", F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(f"{name}_total"))
    within = Window.partitionBy(*groups, "_coarse").orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, [*groups, "_coarse"])
    return joined.withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(within), F.lit(0))).drop("_coarse", "_value", "_before")


def by_number(key: str, width: int = 4096) -> Column:
    """Coarse key of an integer key."""
    return F.floor(F.col(key) / width)


def shuffled(key: Column, seed: object) -> Column:
    """A fixed random order: the MD5 of seed:key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def exact_sample(df: DataFrame, groups: list[str], key: str, ratio: float, seed: object = 0) -> DataFrame:
    """floor(n * ratio) rows of each group without replacement, the first in the shuffled order."""
    order = df.withColumn("_order", shuffled(F.col(key), seed))
    picked = ranked(order, groups, F.substring("_order", 1, 3), ["_order", key], "_pos")
    return picked.where(F.col("_pos") < F.floor(F.col("_pos_total") * ratio)).drop("_order", "_pos", "_pos_total")


def even_shard(pos: Column, n: Column, shards: int) -> Column:
    """Contiguous shards whose sizes differ by one at most, the first ones larger."""
    q, r = F.floor(n / shards), n % shards
    return F.when(pos < (q + 1) * r, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - (q + 1) * r) / F.greatest(q, F.lit(1)))).cast("int")
