"""A data set from its configuration: sources, preprocessors, sampling, union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import exact_sample
from . import readers


@dataclass(frozen=True)
class Source:
    """One entry of a configuration; type names the group its rows are batched with."""

    path: str
    type: str = "text"
    format: str = "jsonl"
    ratio: float = 1.0
    root: str | None = None
    preprocess: str = "conversation"


def as_text(c: Column) -> Column:
    """Turn values as text; a missing one becomes the word None, as str() would say it."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def conversation(df: DataFrame) -> DataFrame:
    turns = F.transform("conversations", lambda t: F.struct(t["from"].alias("from"), as_text(t["value"]).alias("value")))
    return df.select("image", turns.alias("conversations"))


def instruction(df: DataFrame) -> DataFrame:
    """Question and answer of the first two turns as instruction and output."""
    said = lambda i: F.get("conversations", F.lit(i))["value"]
    return df.select("image", said(0).alias("instruction"), F.lit(None).cast("string").alias("input"), said(1).alias("output"))


#: Preprocessors by name; more can be put in.
PREPROCESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {"conversation": conversation, "instruction": instruction}


def rooted(image: Column, root: str | None) -> Column:
    """An image's path below its root; absolute paths and stores stay, and so does a record without an image."""
    if root is None:
        return image
    return F.when(image.isNull() | image.rlike("^(/|[a-z0-9]+://)"), image).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), image))


def read(spark: SparkSession, s: Source) -> DataFrame:
    by_format = {"json": readers.json_records, "jsonl": readers.jsonl_records, "parquet": lambda spark, path: spark.read.parquet(path)}
    if s.format not in by_format:
        raise ValueError(f"unknown format {s.format!r}")
    df = PREPROCESSORS[s.preprocess](by_format[s.format](spark, s.path))
    df = df.withColumns({"image": rooted(F.col("image"), s.root), "type": F.lit(s.type), "source": F.lit(s.path)})
    if s.ratio < 1.0:
        key = F.sha2(F.to_json(F.struct("*")), 256)
        df = exact_sample(df.withColumn("_key", key), ["source"], "_key", s.ratio).drop("_key")
    return df


def load(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """All sources as one table; what a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(spark, s) for s in sources])


def conversations_only(df: DataFrame) -> DataFrame:
    """Records of which only those without an image count."""
    return df.where("image IS NULL")


def pictured(df: DataFrame) -> DataFrame:
    return df.where("image IS NOT NULL")


#: Kinds of data sets by name: what each takes of the records.
DATA_SETS: dict[str, Callable[[DataFrame], DataFrame]] = {"all": lambda df: df, "text": conversations_only, "image_text": pictured}


def load_config(spark: SparkSession, path: str, kind: str = "all") -> DataFrame:
    """The data set of a YAML file: under META a list of sources, each with the fields of Source; an unknown field or kind is an error."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("a YAML configuration needs PyYAML; load() takes Source objects") from e
    if kind not in DATA_SETS:
        raise ValueError(f"unknown data set {kind!r}")
    text = spark.read.option("wholetext", True).text(path).collect()  # one small file
    meta = (yaml.safe_load("\n".join(r.value for r in text)) or {}).get("META")
    if not meta:
        raise ValueError(f"{path} has no sources under META")
    known = set(Source.__dataclass_fields__)
    for entry in meta:
        if unknown := set(entry) - known:
            raise ValueError(f"unknown fields {sorted(unknown)} of a source")
    return DATA_SETS[kind](load(spark, [Source(**entry) for entry in meta]))
