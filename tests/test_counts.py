"""Counts that are taken while rows are written."""

import pytest
from pyspark.sql import functions as F

from vqaspark.sources import sinks
from vqaspark.streaming import files


def test_tasks_are_counted_while_written(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("joint", "train", 1)] * 3 + [("link", "val", 2)], "task string, split string, x int")
    monkeypatch.setattr(type(spark.read), "json", lambda *a, **k: pytest.fail("read again"))
    got = sinks.write_tasks(df, str(tmp_path / "a"), ["joint", "link", "status"], ["train", "val"])
    assert sorted(map(tuple, got.collect())) == [("joint", "train", 3), ("link", "val", 1)]
    monkeypatch.undo()
    assert spark.read.json(str(tmp_path / "a")).count() == 4
    assert sinks.write_tasks(df.limit(0), str(tmp_path / "b"), ["joint"], ["train"]).count() == 0
    for wrong in (("odd", "train", 1), ("joint", None, 1)):
        with pytest.raises(Exception, match="unknown task or split"):
            sinks.write_tasks(df.unionByName(spark.createDataFrame([wrong], df.schema)), str(tmp_path / f"c{wrong[0]}"), ["joint", "link"], ["train", "val"])


@pytest.mark.parametrize("every, told", [(1, [1, 1, 1]), (2, [2, 1]), (9, [3])])
def test_meter(spark, tmp_path, every, told):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10, numPartitions=1).write.mode("append").parquet(str(tmp_path / "in"))
    lines = []
    run = lambda: files.metered(files.file_stream(spark, str(tmp_path / "in"), spark.range(1).schema), str(tmp_path / "out"), str(tmp_path / "check"), {"n": F.count("*"), "total": F.sum("id")}, every, lines.append)
    run()
    assert [x["batches"] for x in lines] == told and sum(x["n"] for x in lines) == 30 and sum(x["total"] for x in lines) == 435
    run()  # nothing new, nothing told
    assert [x["batches"] for x in lines] == told
    spark.range(100, 101).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert lines[-1]["total"] == 100 and spark.read.parquet(str(tmp_path / "out")).count() == 31


def test_of_two_builders_one_wins(spark, tmp_path):
    path = str(tmp_path / "cache")

    def slow():  # while this one builds, another begins and ends
        sinks.cached(spark, path, lambda: spark.range(5))
        return spark.range(9)

    assert sinks.cached(spark, path, slow).count() == 5 and sinks.cached(spark, path).count() == 5
    assert sinks.cached(spark, path, lambda: pytest.fail("built twice")).count() == 5
    assert len([p for p in (tmp_path / "cache").iterdir() if p.name.startswith("data-")]) == 1
    with pytest.raises(TimeoutError):
        sinks.cached(spark, str(tmp_path / "none"))
    with pytest.raises(ZeroDivisionError):
        sinks.cached(spark, str(tmp_path / "broken"), lambda: spark.range(1 // 0))
    assert not sinks.is_ready(spark, str(tmp_path / "broken"))
