"""Joins that need more than an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left join with a table in which the last duplicate wins."""
    return left.join(last_wins(right, keys, order), keys, "left")


#: Rules that are sent to every task; more are an error, for each row is compared with each rule.
RULES = 10_000


def rule_join(left: DataFrame, rules: DataFrame, on: Column, key: list[str], best: Column) -> DataFrame:
    """Left join with the best of the matching rules, a small dimension: more than RULES of them stop the job before it begins.

    Where a rule is a prefix, prefix_join() does without the nested loop and takes any number.
    """
    if rules.limit(RULES + 1).count() > RULES:
        raise ValueError(f"more than {RULES} rules")
    rest = rules.columns
    met = left.join(F.broadcast(rules), on, "left")
    mine = [c for c in left.columns if c not in key]
    return met.groupBy(*key).agg(*(F.first(c).alias(c) for c in mine), F.max_by(F.struct(*rest), best).alias("_r")).select(*key, *mine, *(F.col("_r")[c].alias(c) for c in rest))


def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two listings that must match one to one: a row without a partner, or with two, stops the job."""
    one = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"_n_{name}"), *(F.first(c).alias(c) for c in df.columns if c not in keys))
    both = one(left, "l").join(one(right, "r"), keys, "full")
    fits = (F.coalesce("_n_l", F.lit(0)) == 1) & (F.coalesce("_n_r", F.lit(0)) == 1)
    odd = F.raise_error(F.concat(F.lit("the listings differ at "), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)))).cast("boolean")
    return both.where(F.when(fits, True).otherwise(odd)).drop("_n_l", "_n_r")


def prefix_join(left: DataFrame, right: DataFrame, key: str, prefix: str) -> DataFrame:
    """Inner join where ``prefix`` begins ``key``, as an equality of prefixes of the lengths that occur (both sides may be large)."""
    lengths = right.select(F.length(prefix).alias("_length")).distinct()
    cut = left.join(F.broadcast(lengths), F.length(key) >= F.col("_length")).withColumn(prefix, F.substring(F.col(key), F.lit(1), F.col("_length"))).drop("_length")
    return cut.join(right, prefix)


def outer_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join in which the new side's values win."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in rest))
    return o.join(new, keys, "full").select(*keys, *(F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in rest))
