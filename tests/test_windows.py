"""Positions, moving windows and carried values against plain loops, with hot groups, ties and nulls."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from vqaspark.operators.ranking import numbered
from vqaspark.operators.windows import carried, rolling


def rows(n=400):
    rnd = random.Random(n)
    return [(rnd.choice(["a"] * 8 + ["b", None]), rnd.randrange(30) if rnd.random() < 0.9 else None, i, rnd.choice([None, rnd.randrange(100)])) for i in range(n)]


def sorted_groups(data):
    data = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    return [list(g) for _, g in groupby(data, key=lambda r: r[0])]


def frame(spark, data):
    return spark.createDataFrame(data, "g string, t int, i int, v int").repartition(3)


def test_numbered(spark):
    data = rows()
    got = {r.i: (r.pos, r.pos_total) for r in numbered(frame(spark, data), ["g"], ["t", "i"]).collect()}
    assert got == {r[2]: (k, len(g)) for g in sorted_groups(data) for k, r in enumerate(g)}
    sums = {r.i: (r.s, r.s_total) for r in numbered(frame(spark, data), [], ["i"], "s", F.col("i") * 2).collect()}
    assert sums == {i: (i * (i - 1), 400 * 399) for i in range(400)}
    same = numbered(spark.range(300).select(F.lit(1).alias("k")), [], ["k"])  # one key for all rows
    assert sorted(r.pos for r in same.collect()) == list(range(300)) and numbered(same.drop("pos", "pos_total").limit(0), [], ["k"]).count() == 0
    parts = spark.range(300, numPartitions=4).select(F.lit(1).alias("k"), "id").repartitionByRange(4, "k", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4  # the tie deals out one key


@pytest.mark.parametrize("width, bucket", [(1, 7), (4, 4), (20, 32), (20, 1000)])
def test_rolling(spark, width, bucket):
    data = rows()
    of = {"n": lambda w: F.count("*").over(w), "high": lambda w: F.max("v").over(w), "ids": lambda w: F.collect_list("i").over(w)}
    got = {r.i: (r.n, r.high, r.ids) for r in rolling(frame(spark, data), ["g"], ["t", "i"], width, of, bucket).collect()}
    assert len(got) == len(data)
    for g in sorted_groups(data):
        for k, r in enumerate(g):
            window = g[max(0, k - width + 1) : k + 1]
            assert got[r[2]] == (len(window), max((x[3] for x in window if x[3] is not None), default=None), [x[2] for x in window])


@pytest.mark.parametrize("bucket", [1, 5, 1000])
def test_carried(spark, bucket):
    data = rows() + [("none", i, 1000 + i, None) for i in range(12)] + [("late", i, 2000 + i, 7 if i == 9 else None) for i in range(12)]
    for ring in (False, True):
        got = {r.i: r.w for r in carried(frame(spark, data), ["g"], ["t", "i"], "v", "w", ring, bucket).collect()}
        for g in sorted_groups(data):
            final = next((r[3] for r in reversed(g) if r[3] is not None), None)
            held = final if ring else None
            for r in g:
                held = r[3] if r[3] is not None else held
                assert got[r[2]] == held
