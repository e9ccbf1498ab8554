"""Queries of sources, sinks, streams, tokenizers and point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.tokenizer import encoded, word_numbers
from ..operators import clouds
from ..operators.neighbours import normals
from ..sources import cloud_files, readers, sinks
from ..sources.ingest import Source, load
from ..sources.scratch import scratch
from ..streaming import files
from ..streaming.resume import RowReader
from .aggregate_queries import POINTS, points
from .loader_queries import TOKENS, _digest, digest
from .registry import query, table


@query(TOKENS + f" SELECT doc_id, {_digest('list_concat([1], t, [2])')} AS ids, CAST(len(t) + 2 AS INTEGER) AS n FROM d")
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", encoded(F.coalesce("text", F.lit("")), word_numbers, 1, 2).alias("t"))
    return d.select("doc_id", digest(F.col("t")).alias("ids"), F.size("t").alias("n"))


@query()
def fps_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("key", F.col("vec_id") * 100 + F.col("i"))
    return clouds.farthest_points(p, "vec_id", "key", ["x", "y", "z"], 8)


@query()
def min_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.oriented_boxes(points(spark, sf_dir), "vec_id", "x", "y", "z")


@query()
def knn_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a cloud of its own."""
    return normals(points(spark, sf_dir), "vec_id", "i", ["x", "y", "z"])


@query()
def jitter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.camera_poses(clouds.jittered(points(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in "xyz"}), ["x", "y", "z"], 0.5), 2.0)


@query("""WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), t AS (SELECT *, sqrt(a * a + b * b + c * c) AS w FROM v)
SELECT vec_id, CAST(floor((1 + 2 * cos(w)) * 1000000 + 0.5) AS BIGINT) AS trace, CAST(floor(a * 1000000 + 0.5) AS BIGINT) AS a, CAST(floor(b * 1000000 + 0.5) AS BIGINT) AS b, CAST(floor(c * 1000000 + 0.5) AS BIGINT) AS c FROM t""")
def rotvec_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation vectors to matrices and back."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate("abc")))
    r = G.rotation_matrix([F.col(c) for c in "abc"])
    m = e.select("vec_id", *(r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)))
    back = G.rotation_vector([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)])
    whole = lambda x: F.floor(x * 1000000 + 0.5).cast("long")
    return m.select("vec_id", whole(F.col("r00") + F.col("r11") + F.col("r22")).alias("trace"), *(whole(v).alias(n) for v, n in zip(back, "abc", strict=True)))


RECORDS = "SELECT 'img/' || conv_id || '.png' AS image, CAST(count(*) AS INTEGER) AS turns, CAST(sum(length(coalesce(text, 'None'))) AS BIGINT) AS chars FROM conversations GROUP BY conv_id"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value")))
    return c.groupBy("conv_id").agg(turns.alias("conversations")).select(F.concat(F.lit("img/"), "conv_id", F.lit(".png")).alias("image"), "conversations")


def _told(df: DataFrame) -> DataFrame:
    chars = F.aggregate("conversations", F.lit(0).cast("long"), lambda a, t: a + F.length(F.coalesce(t["value"], F.lit("None"))))
    return df.select("image", F.size("conversations").alias("turns"), chars.alias("chars"))


@query(RECORDS)
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    _records(spark, sf_dir).write.json(path)
    return _told(readers.jsonl_records(spark, path))


@query(RECORDS)
def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "json")
    sinks.write_json_arrays(_records(spark, sf_dir), path, ["image"], 64)
    return _told(readers.json_records(spark, path))


@query("SELECT doc_id, lang, n_chars, CAST(length(text) AS INTEGER) AS chars FROM documents")
def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tsv")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.to_json(F.struct("text")).alias("body"))
    d.write.option("sep", "\t").option("header", True).csv(path)
    back = readers.tsv(spark, path, "doc_id long, lang string, n_chars long, body string")
    return back.select("doc_id", "lang", "n_chars", F.length(F.coalesce(F.get_json_object("body", "$.text"), F.lit(""))).alias("chars"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS dataset_id, CAST(p_size AS INTEGER) AS img_index, p_name AS img_name, p_type AS category FROM part")
def index_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "index")
    none = lambda n: F.lit(None).cast("string").alias(n)
    p = table(spark, sf_dir, "part")
    sinks.write_index(p.select(F.col("p_partkey").cast("string").alias("dataset_id"), F.col("p_size").alias("img_index"), F.col("p_name").alias("img_name"), *map(none, ("img_path", "mask_img_path", "depth_img_path", "texture_description")), F.col("p_type").alias("category")), path)
    return readers.csv(spark, f"{path}/csv").select("dataset_id", "img_index", "img_name", "category")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def corpus_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.corpus(spark, f"{sf_dir}/documents.parquet", "text").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT 'link' || s_suppkey AS link, CASE WHEN s_suppkey % 2 = 0 THEN 'hinge' ELSE 'slider' END AS joint, 'door' || s_nationkey AS semantic FROM supplier WHERE s_suppkey % 10 <> 3")
def semantics_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "semantics")
    s = table(spark, sf_dir, "supplier")
    line = F.concat_ws(" ", F.concat(F.lit("link"), "s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, "hinge").otherwise("slider"), F.concat(F.lit("door"), "s_nationkey"), F.when(F.col("s_suppkey") % 10 == 3, "odd"))
    sinks.rewrite_lines(s.select(line.alias("line")), path)
    return readers.semantics(spark, path)[0].select("link", "joint", "semantic")


@query("SELECT 'j' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'revolute' ELSE 'prismatic' END AS type FROM supplier")
def joint_xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "urdf")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "revolute").otherwise("prismatic")
    joint = F.concat(F.lit('<joint name="j'), "s_suppkey", F.lit('" type="'), kind, F.lit('"><limit lower="0"/></joint>'))
    robots = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("<robot>"), F.array_join(F.collect_list(joint), ""), F.lit("</robot>")).alias("value"))
    robots.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.joint_types(spark, path)


@query("SELECT task, split, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'joint' ELSE 'link' END AS task, CASE WHEN p_size > 40 THEN 'val' ELSE 'train' END AS split FROM part) GROUP BY 1, 2")
def task_sink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return sinks.write_tasks(p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "joint").otherwise("link").alias("task"), F.when(F.col("p_size") > 40, "val").otherwise("train").alias("split")), scratch(spark, "tasks"), ["joint", "link"], ["train", "val"])


@query("SELECT c_custkey, c_name FROM customer")
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "existing")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for part in (c.where("c_custkey % 2 = 0"), c, c):  # what is there already is not written again
        sinks.write_new(part, path, "c_custkey")
    return spark.read.parquet(path)


@query(POINTS + " SELECT vec_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y, CAST(sum(z) AS BIGINT) AS z FROM p GROUP BY vec_id")
def ply_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a PLY file; the points are read back from the files, those of greater clouds from several."""
    path = scratch(spark, "ply")
    cloud_files.write_clouds(points(spark, sf_dir), path, "vec_id", "i", "ply", file_points=16)
    back = cloud_files.read_clouds(spark, path, "ply", file_points=16)
    return back.groupBy(F.col("cloud").cast("long").alias("vec_id")).agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in "xyz"))


@query(POINTS + " SELECT vec_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(i * x) AS BIGINT) AS ix, CAST(sum(i * z) AS BIGINT) AS iz, CAST(sum(abs(y) % 256) AS BIGINT) AS red FROM p GROUP BY vec_id")
def npy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is an NPY file of places and colours; points keep their order."""
    path = scratch(spark, "npy")
    p = points(spark, sf_dir)
    cloud_files.write_clouds(p.withColumns({"r": F.abs("y") % 256, "g": F.lit(0), "b": F.lit(255)}), path, "vec_id", "i", "npy")
    back = cloud_files.read_clouds(spark, path, "npy")
    whole = lambda c: F.sum((F.col("idx") * F.col(c)).cast("long"))
    return back.groupBy(F.col("cloud").cast("long").alias("vec_id")).agg(F.count("*").alias("n"), whole("x").alias("ix"), whole("z").alias("iz"), F.sum(F.col("r").cast("long")).alias("red"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a stream, one a batch; a second run finds nothing new."""
    base = scratch(spark, "stream")
    table(spark, sf_dir, "events").select("event_id", "event_type").repartition(4, "event_id").write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    for _ in range(2):
        files.ingest(files.file_stream(spark, f"{base}/in", schema), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY event_type")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read row by row; a reader stops within a file, and the next one goes on at the row after it."""
    base = scratch(spark, "resume")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    e.repartition(3, "event_id").write.parquet(f"{base}/in")
    rows = max(1, -(-2 * e.count() // 5))  # three batches, whose ends are within files
    for _ in range(3):
        RowReader(spark, f"{base}/in", f"{base}/state", rows).run(batches=1)
    return RowReader(spark, f"{base}/in", f"{base}/state", rows).output().groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("SELECT event_type AS metric, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY event_type")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "metrics")
    table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("value")).repartition(2, "value").write.parquet(f"{base}/in")
    files.running_metrics(files.file_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema), f"{base}/out", f"{base}/checkpoint")
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("metric").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS total, 5 AS batches, 3 AS lines FROM events")
def stream_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches of a stream, metered while they are written: a line for every two, and one for the last."""
    base, lines = scratch(spark, "meter"), []
    table(spark, sf_dir, "events").select("event_id").repartition(5).write.parquet(f"{base}/in")
    stream = files.file_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
    files.metered(stream, f"{base}/out", f"{base}/checkpoint", {"n": F.count("*"), "total": F.sum("event_id")}, 2, lines.append)
    log = spark.createDataFrame([(x["batches"], x["n"], x["total"]) for x in lines], "batches int, n long, total long")
    return log.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("batches").cast("int").alias("batches"), F.count("*").cast("int").alias("lines"))


@query("WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT type, CAST(count(*) AS BIGINT) AS n, min(root) AS root FROM (SELECT 'full' AS type, 'data/img' AS root FROM c UNION ALL SELECT 'part', 'img' FROM (SELECT conv_id, row_number() OVER () AS r, count(*) OVER () AS n FROM c) WHERE r <= floor(n * 0.2)) GROUP BY type")
def config_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "config")
    _records(spark, sf_dir).write.json(base)
    rows = load(spark, [Source(base, "full", root="data"), Source(base, "part", ratio=0.2)])
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.min(F.regexp_extract("image", "^(.*)/", 1)).alias("root"))
