"""Sources.  Schemas are explicit; rows that do not fit are kept apart or stop the read, as each function says."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import numbered

CONVERSATION = "image string, conversations array<struct<from:string,value:string>>"
INSTRUCTION = "instruction string, input string, output string, image string"
INDEX = "dataset_id string, img_index int, img_name string, img_path string, mask_img_path string, depth_img_path string, texture_description string, category string"
TASKS = "map<string,map<string,map<string,struct<description:string,actions:array<string>,required_status:string>>>>"


def json_records(spark: SparkSession, path: str, schema: str | StructType = CONVERSATION) -> DataFrame:
    """Files that each hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def jsonl_records(spark: SparkSession, path: str, schema: str | StructType = CONVERSATION) -> DataFrame:
    """A record for each line; a bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a JSONL file; no line is lost."""
    # lines are parsed here, not by the JSON source, whose corrupt records cannot be queried by themselves
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = spark.read.text(path).where("trim(value) != ''").select(F.from_json("value", f"{schema}, _corrupt_record string", options).alias("row")).select("row.*")
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record"), rows.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def csv(spark: SparkSession, path: str, schema: str = INDEX) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def corpus(spark: SparkSession, path: str, column: str = "content") -> DataFrame:
    """One column of Parquet files; the others are not read."""
    return spark.read.parquet(path).select(column)


def manifest(spark: SparkSession, files: list[str], validation: bool = False, column: str = "content") -> DataFrame:
    """The files of a list, whose last is the validation set."""
    return spark.read.parquet(*(files[-1:] if validation else files[:-1])).select(column)


def manifest_file(spark: SparkSession, path: str, validation: bool = False, column: str = "content") -> DataFrame:
    """manifest() of the paths in a file that holds one JSON list."""
    files = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "array<string>").alias("f")).collect()  # one small file
    if len(files) != 1 or not files[0].f:
        raise ValueError(f"{path} holds no list of files")
    return manifest(spark, files[0].f, validation, column)


def metadata(spark: SparkSession, path: str, schema: str, pattern: str = "meta.json") -> DataFrame:
    """(path, folder, schema's columns) of the JSON files of such a name in all folders below a path; a file that does not parse stops the read."""
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    at = F.col("_metadata.file_path")
    return found.select(at.alias("path"), F.element_at(F.split(at, "/"), -2).alias("folder"), *[F.col(c) for c in found.columns])


def semantics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, line, link, joint, semantic), bad lines) of text with three words on a line; line numbers are within a file."""
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text")).where("text != ''")
    words = F.split("text", " ")
    good = whole.where(F.size(words) == 3)
    return good.select("file", "line", words[0].alias("link"), words[1].alias("joint"), words[2].alias("semantic")), whole.where(F.size(words) != 3).select("file", "line", "text")


def joint_types(spark: SparkSession, path: str) -> DataFrame:
    """(name, type) of the joint elements of robot descriptions in XML, one document a file."""
    return spark.read.format("xml").option("rowTag", "joint").schema("_name string, _type string").load(path).select(F.col("_name").alias("name"), F.col("_type").alias("type"))


def task_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, category, link, task, description, actions, required_status), files that do not parse)."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value", F.from_json("value", TASKS).alias("tree"))
    rows = raw.where("tree IS NOT NULL").select("file", F.explode("tree").alias("category", "links"))
    rows = rows.select("file", "category", F.explode("links").alias("link", "tasks")).select("file", "category", "link", F.explode("tasks").alias("task", "t"))
    return rows.select("file", "category", "link", "task", "t.description", "t.actions", "t.required_status"), raw.where("tree IS NULL").select("file")


def images(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(path, length, content) of files in any store Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def listing(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(path, name) of the files whose name fits a pattern, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return found.where(F.col("name").rlike(f"^(?:{pattern})$"))


def ply(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, x, y, z, nx, ny, nz, r, g, b) of ASCII PLY files; what a file lacks is null."""
    names = ["x", "y", "z", "nx", "ny", "nz", "red", "green", "blue"]

    def rows(batches):
        for batch in batches:
            for p, text in zip(batch["path"], batch["content"], strict=True):
                head, _, body = text.decode("ascii").partition("end_header\n")
                columns, n, inside = [], 0, False
                for line in head.splitlines():
                    word = line.split()
                    if word[:1] == ["element"]:
                        inside = word[1] == "vertex"
                        n = int(word[2]) if inside else n
                    elif word[:1] == ["property"] and inside:
                        columns.append(word[-1])
                data = np.array([x.split()[: len(columns)] for x in body.splitlines()[:n]], float).reshape(n, len(columns))
                out = {"path": [p] * n, "idx": np.arange(n, dtype=np.int64)}
                out |= {k: data[:, columns.index(c)] if c in columns else [None] * n for k, c in zip(("x", "y", "z", "nx", "ny", "nz", "r", "g", "b"), names, strict=True)}
                yield pd.DataFrame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, idx long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double")


def npy(spark: SparkSession, path: str, points: int = 8192, colour: bool = True) -> DataFrame:
    """(path, cloud): exactly ``points`` rows of xyz and rgb (0..1) from NumPy files of six or nine columns; short clouds repeat."""

    def rows(batches):
        for batch in batches:
            out = []
            for text in batch["content"]:
                x = np.load(io.BytesIO(text)).astype(float)
                x = x[:, [0, 1, 2, 6, 7, 8]] if x.shape[1] == 9 else x
                if x.shape[1] > 3:
                    x[:, 3:] = x[:, 3:] / 255 if x[:, 3:].max(initial=0) > 1 else x[:, 3:]
                x = x if colour else x[:, :3]
                n = len(x)
                take = np.arange(points) % n if n < points else (np.arange(points) * n) // points
                out.append(x[take].tolist())
            yield pd.DataFrame({"path": batch["path"], "cloud": out})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, cloud array<array<double>>")


def packed(spark: SparkSession, path: str) -> DataFrame:
    """(file, chunk, tokens): packed token rows as write_new() leaves them, a folder for each file."""
    return spark.read.schema("chunk long, tokens array<int>, file long").parquet(path)


def sorted_files(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(path, name, pos): the files that fit the pattern, numbered from 0 in the order of their paths."""
    found = listing(spark, path, pattern)
    return numbered(found, [], ["path"]).select("path", "name", "pos")
