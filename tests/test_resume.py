"""Reading on from any row after any death."""

import pytest
from pyspark.sql import functions as F

from vqaspark.streaming.resume import RowReader


def source(spark, path, sizes=(70, 0, 5, 120, 1)):
    """Files of such sizes whose rows are numbered in the order of reading."""
    at = 0
    for k, n in enumerate(sizes):
        spark.range(at, at + n, numPartitions=1).write.option("parquet.block.size", 1024).parquet(f"{path}/part={k}")
        at += n
    return at


def seen(reader):
    return sorted(r.id for r in reader.output().select("id").collect())


def test_resumes_at_the_row_after_the_last_batch(spark, tmp_path):
    n = source(spark, str(tmp_path / "in"))
    state = str(tmp_path / "state")
    reader = lambda: RowReader(spark, str(tmp_path / "in"), state, 32)
    assert reader().run(batches=1) == 1 and reader().position() == (1, 32)
    assert seen(reader()) == list(range(32))
    last = reader().ledger().first()
    assert last.file.rsplit("/", 2)[1] == "part=0" and last.row == 31
    assert reader().run(batches=2) == 2 and seen(reader()) == list(range(96))  # over the borders of files
    row = reader().ledger().orderBy(F.desc("batch")).first()
    assert row.file.rsplit("/", 2)[1] == "part=3" and row.row == 96 - 75 - 1
    assert reader().run() == 4 and seen(reader()) == list(range(n)) and reader().run() == 0
    assert reader().position() == (7, n)


@pytest.mark.parametrize("place", ["work", "ledger"])
def test_death_within_a_batch(spark, tmp_path, place, monkeypatch):
    """A batch that dies while it writes, or after it wrote and before its ledger line, is done again, once."""
    n = source(spark, str(tmp_path / "in"), (40, 60))
    reader = RowReader(spark, str(tmp_path / "in"), str(tmp_path / "state"), 30)
    assert reader.run(batches=1) == 1
    if place == "work":
        broken = lambda rows: rows.withColumn("id", F.when(F.col("id") == 44, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))
        with pytest.raises(Exception, match="killed"):
            reader.run(broken)
    else:
        batch, first = reader.position()
        reader.between(first, first + 30).write.parquet(f"{reader.state}/out/batch={batch}")  # written, then killed
    assert seen(reader) == list(range(30))
    assert reader.run() == 3 and seen(reader) == list(range(n))
    assert reader.ledger().count() == 4


def test_only_the_files_of_a_batch_are_opened(spark, tmp_path):
    source(spark, str(tmp_path / "in"), (10, 10, 10, 10))
    reader = RowReader(spark, str(tmp_path / "in"), str(tmp_path / "state"), 15)
    files = {f.rsplit("/", 2)[1] for f in reader.between(12, 27).inputFiles()}
    assert files == {"part=1", "part=2"} and sorted(r.id for r in reader.between(12, 27).collect()) == list(range(12, 27))


def test_empty_and_wrong(spark, tmp_path):
    source(spark, str(tmp_path / "in"), (0,))
    assert RowReader(spark, str(tmp_path / "in"), str(tmp_path / "state"), 5).run() == 0
    with pytest.raises(ValueError):
        RowReader(spark, "x", "y", 0)
