"""Clouds as files: round trips, failures, foreign files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqaspark.sources import cloud_files as C


def cloud(spark, n=50):
    rows = [(k, i, float(i), i / 3, -float(len(k)), 0.0, 0.6, 0.8, i % 256, 7, 255) for k in ("a b", "ö/1", "c") for i in range(n if k != "c" else 3)]
    return spark.createDataFrame(rows, "name string, i long, x double, y double, z double, nx double, ny double, nz double, r int, g int, b int")


@pytest.mark.parametrize("kind", ["ply", "npy"])
def test_round_trip(spark, tmp_path, kind):
    df, path = cloud(spark), str(tmp_path / "out")
    C.write_clouds(df.repartition(3), path, "name", "i", kind, file_points=20)
    assert len([f for f in os.listdir(path) if f.endswith(kind)]) == 7 and "_temporary" not in os.listdir(path)
    back = C.read_clouds(spark, path, kind, partition_bytes=2000, file_points=20)
    want = df.select("name", "i", *(F.round(F.col(c).cast("double"), 6) for c in C.COLUMNS)).collect()
    got = back.select("cloud", "idx", *(F.round(c, 6) for c in C.COLUMNS)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert back.rdd.getNumPartitions() > 1
    with pytest.raises(Exception, match="there already"):
        C.write_clouds(df, path, "name", "i", kind, file_points=20)
    assert back.count() == df.count() and "_temporary" not in os.listdir(path)  # nothing of the failed job
    C.write_clouds(df.where("name = 'c'"), path, "name", "i", kind, mode="overwrite")
    assert {r.cloud for r in C.read_clouds(spark, path, kind).select("cloud").collect()} == {"c"}


def test_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = cloud(spark).withColumn("x", F.when((F.col("name") == "c") & (F.col("i") == 2), F.raise_error(F.lit("broken row"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken row"):
        C.write_clouds(bad, path, "name", "i")
    assert not os.path.exists(path) or [f for f in os.listdir(path)] == []


def test_other_files(spark, tmp_path):
    np.save(tmp_path / "six.npy", np.arange(12.0).reshape(2, 6))
    np.save(tmp_path / "nine.npy", np.arange(18, dtype=np.float32).reshape(2, 9))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "p.ply").write_text("ply\nformat ascii 1.0\ncomment by hand\nelement vertex 2\nproperty float z\nproperty float x\nproperty float y\nelement face 1\nproperty list uchar int v\nend_header\n3 1 2\n6 4 5\n3 0 1 1\n")
    (tmp_path / "notes.txt").write_text("no cloud")
    got = {(r.cloud, r.idx): r for r in C.read_clouds(spark, str(tmp_path), "npy").collect()}
    assert (got["six", 1].x, got["six", 1].nx, got["six", 1].b) == (6.0, None, 11.0) and (got["nine", 0].nx, got["nine", 1].r) == (3.0, 15.0) and len(got) == 4
    assert [(r.cloud, r.x, r.y, r.z, r.r) for r in C.read_clouds(spark, str(tmp_path), "ply").orderBy("idx").collect()] == [("p", 1.0, 2.0, 3.0, None), ("p", 4.0, 5.0, 6.0, None)]
    (tmp_path / "bad.ply").write_text("ply\nformat binary_little_endian 1.0\nend_header\n")
    with pytest.raises(Exception, match="binary_little_endian"):
        C.read_clouds(spark, str(tmp_path), "ply").collect()


def test_rows_of_a_great_array_are_dealt_out(spark, tmp_path):
    np.save(tmp_path / "great.npy", np.arange(30_000.0).reshape(10_000, 3))
    df = C.read_clouds(spark, str(tmp_path), "npy", partition_bytes=24_000)
    assert df.rdd.getNumPartitions() == 10
    assert df.agg(F.count("*"), F.count_distinct("idx"), F.sum(F.col("x") - 3 * F.col("idx"))).first() == (10_000, 10_000, 0.0)


def test_empty(spark, tmp_path):
    C.write_clouds(cloud(spark).limit(0), str(tmp_path / "none"), "name", "i")
    assert C.read_clouds(spark, str(tmp_path / "none")).count() == 0
