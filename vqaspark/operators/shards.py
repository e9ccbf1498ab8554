"""Tables of arrays that were cut into shards, put together again by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_of(key: Column, rules: list[tuple[str, int]]) -> Column:
    """The dimension of the first rule whose pattern fits from the key's beginning; null if none does."""
    found = F.lit(None).cast("int")
    for pattern, dim in reversed(rules):
        found = F.when(key.rlike(f"^(?:{pattern})"), F.lit(dim)).otherwise(found)
    return found


def merge_shards(df: DataFrame, rules: list[tuple[str, int]], shards: int, ignore_unknown: bool = False) -> DataFrame:
    """(key, row, values) of whole tables from (key, shard, row, values), rows numbered from 0 in each shard.

    Dimension 0: rows of one shard follow those of the one before; 1: each row's values follow each other by shard; -1: all shards
    hold the same, and the first one's is taken.  A key that no rule fits stops the job, unless unknown ones are to be left out; so
    does a key without all its shards, or rows that are not in all of them for dimension 1.  No task holds more than a row of a table.
    """
    ruled = df.withColumn("_dim", rule_of(F.col("key"), rules))
    if ignore_unknown:
        ruled = ruled.where("_dim IS NOT NULL")
    else:
        unknown = F.raise_error(F.concat(F.lit("unknown key: "), "key")).cast("int")
        ruled = ruled.withColumn("_dim", F.coalesce("_dim", unknown))
    # a line for each key and shard: its rows, and those of the shards before it
    sizes = ruled.groupBy("key", "shard", "_dim").agg(F.count("*").alias("_n"))
    every = sizes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shard", "_n"))).alias("_all"))
    whole = F.size("_all") == shards
    every = every.withColumn("_all", F.when(whole, F.col("_all")).otherwise(F.raise_error(F.concat(F.lit("not all shards of key: "), "key")).cast("array<struct<shard:int,_n:bigint>>")))
    before = lambda shard: F.aggregate(F.filter("_all", lambda x: x["shard"] < shard), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    placed = ruled.withColumn("shard", F.col("shard").cast("int")).join(every, "key")
    longer = placed.where("_dim = 0").select("key", (F.col("row") + before(F.col("shard"))).alias("row"), "values")
    first = placed.where("_dim = -1 AND shard = element_at(_all, 1).shard").select("key", "row", "values")
    wider = placed.where("_dim = 1").groupBy("key", "row").agg(F.array_sort(F.collect_list(F.struct("shard", "values"))).alias("_v"))
    wider = wider.withColumn("_v", F.when(F.size("_v") == shards, F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("a row is not in all shards of key: "), "key")).cast(dict(wider.dtypes)["_v"])))
    return longer.unionByName(first).unionByName(wider.select("key", "row", F.flatten(F.transform("_v", lambda v: v["values"])).alias("values")))


def add_tables(base: DataFrame, delta: DataFrame) -> DataFrame:
    """(key, row, values) of base, with the values of delta added by place; a key or row that base lacks stops the job."""
    d = delta.select("key", "row", F.col("values").alias("_delta"), F.lit(True).alias("_there"))
    both = base.withColumn("_base", F.lit(True)).join(d, ["key", "row"], "full")
    lacking = F.when(F.col("_base").isNull(), F.raise_error(F.concat(F.lit("a row of the delta is not in the base: "), "key")).cast("boolean"))
    uneven = F.when(F.col("_there") & (F.size("values") != F.size("_delta")), F.raise_error(F.concat(F.lit("rows of other lengths: "), "key")).cast("boolean"))
    added = F.zip_with("values", "_delta", lambda a, b: a + b)
    return both.where(lacking.isNull() & uneven.isNull()).select("key", "row", F.when(F.col("_there"), added).otherwise(F.col("values")).alias("values"))
