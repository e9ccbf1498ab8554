"""Streams of tokens cut into rows of one length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import pad, strip_begin
from ..sources.scratch import scratch
from .ranking import by_number, ranked


def cut_stream(df: DataFrame, key: str, tokens: str, length: int, bos: int | None = None) -> DataFrame:
    """(chunk, pos, part): the stream of all rows' tokens by key (a long), each row cut at the chunks' bounds; begin ids go.

    The tokens are written once, and only their numbers are ranked.
    """
    spark = df.sparkSession
    found = F.col(tokens) if bos is None else strip_begin(F.col(tokens), bos)
    path = scratch(spark, "tokens")
    df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), found.alias("_t")).where("size(_t) > 0").write.parquet(path)
    rows = spark.read.parquet(path)
    starts = ranked(rows.select("_row", "_key", F.size("_t").alias("_n")), [], by_number("_key"), ["_key", "_row"], "_start", F.col("_n"))
    placed = rows.select("_row", "_t").join(starts.select("_row", "_start", (F.col("_start") + F.col("_n")).alias("_stop")), "_row")
    chunks = F.explode(F.sequence(F.floor(F.col("_start") / length), F.floor((F.col("_stop") - 1) / length))).alias("chunk")
    cut = placed.select("_start", "_stop", "_t", chunks).withColumn("pos", F.greatest("_start", F.col("chunk") * length))
    n = F.least("_stop", (F.col("chunk") + 1) * length) - F.col("pos")
    return cut.select("chunk", "pos", F.slice("_t", (F.col("pos") - F.col("_start") + 1).cast("int"), n.cast("int")).alias("part"))


def packed_rows(df: DataFrame, key: str, tokens: str, length: int, bos: int | None = 1, fill: int = 0) -> DataFrame:
    """(chunk, tokens): rows of exactly ``length`` tokens, the last one filled up; where there are no tokens at all, one row of the fill."""
    parts = cut_stream(df, key, tokens, length, bos)
    rows = parts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("x"))
    rows = rows.select("chunk", pad(F.flatten(F.transform("x", lambda x: x["part"])), length, fill).cast("array<int>").alias("tokens"))
    if not parts.isEmpty():
        return rows
    return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("chunk"), F.array_repeat(F.lit(fill), length).cast("array<int>").alias("tokens"))
