"""Batches of rows: collation, and models that run on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collated(df: DataFrame, pos: str, size: int, columns: list[str]) -> DataFrame:
    """(batch, n, one list for each column): rows of ``size`` positions each, in order; a batch's rows are one group of bounded size."""
    rows = df.select(F.floor(F.col(pos) / size).alias("batch"), F.struct(pos, *columns).alias("row"))
    lists = [F.col(f"rows.{c}").alias(c) for c in columns]
    return rows.groupBy("batch").agg(F.array_sort(F.collect_list("row")).alias("rows")).select("batch", F.size("rows").alias("n"), *lists)


def padded(df: DataFrame, batch: str, tokens: str, fill: int = 0) -> DataFrame:
    """df with each row's tokens filled up at the end to the longest of its batch; only the lengths are grouped."""
    longest = df.groupBy(batch).agg(F.max(F.size(tokens)).alias("_longest"))
    filled = F.concat(F.col(tokens), F.array_repeat(F.lit(fill), F.col("_longest") - F.size(tokens)))
    return df.join(longest, batch).withColumn(tokens, filled).drop("_longest")


def inferred(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], output: str, kind: str) -> DataFrame:
    """df with the model's answer for each row.  load() gives the model, once in each task; it answers a batch of rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for rows in batches:
            yield rows.assign(**{output: model(rows)})

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{output}` {kind}")
