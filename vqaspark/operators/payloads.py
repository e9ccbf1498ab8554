"""Records with what their paths point to: images, depth images, clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Records that ask for one payload in one task; a payload that more ask for is sent to as many tasks as they need.
ASKS = 10_000


def with_payloads(records: DataFrame, payloads: DataFrame, paths: list[str], path: str = "path", content: str = "content", missing: str = "error", asks: int = ASKS) -> DataFrame:
    """records with a column ``<name>_content`` for each path column: the content of the payload that it names, null where it is null.

    payloads: one row for each path.  What is to be done once with each payload (decoding, resizing, sampling) is done on that table
    before.  missing: what a path without a payload does, stop the job ("error"), give null ("null") or drop its record ("drop").

    Only (row, place, path) meets the payloads, so each is shuffled once by its path, and its copies once to their records; the
    records' own columns are joined at the end.  A payload that very many records name is dealt out by parts.
    """
    if missing not in ("error", "null", "drop"):
        raise ValueError(f"unknown way of missing payloads {missing!r}")
    spark = records.sparkSession
    folder = scratch(spark, "records")
    records.withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    asked = rows.select("_row", F.posexplode(F.array(*paths)).alias("_place", "_path")).where("_path IS NOT NULL")
    # the number of a path's parts, a line for each path that more than one part asks for: at most asked / asks lines
    hot = asked.groupBy("_path").agg(F.ceil(F.count("*") / asks).cast("int").alias("_parts")).where("_parts > 1")
    hot_folder = scratch(spark, "hot")
    hot.write.parquet(hot_folder)
    hot = spark.read.schema("_path string, _parts int").parquet(hot_folder)
    part = F.coalesce(F.pmod(F.xxhash64("_row", "_place"), F.col("_parts")).cast("int"), F.lit(0))
    asked = asked.join(hot, "_path", "left").select("_row", "_place", "_path", part.alias("_part"))
    held = payloads.select(F.col(path).alias("_path"), F.col(content).alias("_content"), F.lit(True).alias("_there")).join(hot, "_path", "left")
    held = held.select("_path", "_content", "_there", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
    # contents are never broadcast: what a table that Python makes will hold is not known beforehand
    met = asked.join(held.hint("merge"), ["_path", "_part"], "left")
    if missing == "error":
        lost = F.raise_error(F.concat(F.lit("no payload at "), "_path")).cast("boolean")
        met = met.where(F.coalesce(F.col("_there"), lost))
    found = met.groupBy("_row").agg(F.max(F.col("_there").isNull()).alias("_lost"), *(F.first(F.when(F.col("_place") == i, F.col("_content")), True).alias(f"{n}_content") for i, n in enumerate(paths)))
    out = rows.join(found.hint("merge"), "_row", "left")
    if missing == "drop":
        out = out.where(~F.coalesce("_lost", F.lit(False)))
    return out.select(*records.columns, *(f"{n}_content" for n in paths))
