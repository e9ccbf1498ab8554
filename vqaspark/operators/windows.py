"""Moving windows over groups of any size: a group is cut into buckets of consecutive rows, none of which is one task's alone.

A bucket takes the last rows of the one before it along, as many as a window reaches back, and gives no results for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ranking import numbered

#: Rows of a bucket; more than a window's.
BUCKET = 1 << 15


def rolling(df: DataFrame, groups: list[str], order: list[str], width: int, results: dict[str, Callable[[WindowSpec], Column]], bucket: int = BUCKET) -> DataFrame:
    """df with ``results``, each a function of the window of a row and the width - 1 rows before it in its group."""
    bucket = max(bucket, width)
    rows = numbered(df, groups, order, "_pos").drop("_pos_total")
    own, place = F.floor(F.col("_pos") / bucket), F.col("_pos") % bucket
    dealt = rows.withColumn("_own", own).withColumn("_bucket", F.explode(F.when(place > bucket - width, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    window = Window.partitionBy(*groups, "_bucket").orderBy("_pos").rowsBetween(1 - width, 0)
    found = dealt.select("*", *(f(window).alias(n) for n, f in results.items()))
    return found.where("_bucket = _own").select(*df.columns, *results)


def carried(df: DataFrame, groups: list[str], order: list[str], column: str, name: str, ring: bool = False, bucket: int = BUCKET) -> DataFrame:
    """df with ``name``: the column's value, or where it is null the last value before it in its group; where there is none, with ``ring`` the group's last value.

    The last value of each bucket is found first; the windows over those have a row for each bucket.
    """
    rows = numbered(df, groups, order, "_pos").withColumn("_bucket", F.floor(F.col("_pos") / bucket))
    lasts = rows.groupBy(*groups, "_bucket").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("_pos"))).alias("_last"))
    across = Window.partitionBy(*groups).orderBy("_bucket")
    earlier = F.last("_last", True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    final = F.last("_last", True).over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lasts = lasts.select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.col("_bucket").alias("_b"), earlier.alias("_earlier"), final.alias("_final"))
    same = F.col("_bucket") == F.col("_b")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    within = Window.partitionBy(*groups, "_bucket").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(lasts, same)
    return joined.select(*df.columns, F.coalesce(F.last(column, True).over(within), "_earlier", *(["_final"] if ring else [])).alias(name))
