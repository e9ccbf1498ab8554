"""Nearest neighbours and normals against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqaspark.operators import neighbours as N


def plain(rows, k):
    out = []
    for g, i, *p in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for h, j, *q in rows if h == g and j != i)
        out += [(g, i, j, r) for r, (_, j) in enumerate(near[:k], 1)]
    return sorted(out)


def clustered(seed):
    """Clouds: even, a dense corner with a few far points, all on a line, one place, one point, ties on a lattice."""
    rnd = random.Random(seed)
    rows = [("even", *(rnd.randrange(1000) for _ in range(3))) for _ in range(150)]
    rows += [("dense", *(rnd.randrange(20) for _ in range(3))) for _ in range(200)] + [("dense", 10**6, 5, 5), ("dense", 0, -(10**5), 0), ("dense", 40, 40, 40)]
    rows += [("line", 3, rnd.randrange(500), 3) for _ in range(60)] + [("place", 1, 1, 1)] * 40 + [("one", 0, 0, 0)]
    rows += [("lattice", x, y, z) for x in range(4) for y in range(4) for z in range(4)] + [("two", 0, 0, 0), ("two", 9, 9, 9)]
    return [(g, i, *p) for i, (g, *p) in enumerate(rows)]


@pytest.mark.parametrize("k, crowd", [(1, 1), (5, 1), (5, 24), (70, 24)])
def test_nearest(spark, monkeypatch, k, crowd):
    monkeypatch.setattr(N, "CROWD", crowd)
    rows = clustered(k)
    df = spark.createDataFrame([(*r, 1) for r in rows] + [("even", 9999, None, 0, 0, 1), (None, 9998, 1, 1, 1, 1)], "g string, i long, x long, y long, z long, rank int")
    assert sorted(map(tuple, N.nearest(df, "g", "i", ["x", "y", "z"], k).collect())) == plain(rows, k)
    assert N.nearest(df.limit(0), "g", "i", ["x", "y", "z"], k).count() == 0


def test_nearest_in_the_plane_of_doubles(spark):
    rnd = random.Random(3)
    rows = [(1, i, rnd.gauss(0, 1), rnd.gauss(0, 1e-3)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i int, u double, v double")
    assert sorted(map(tuple, N.nearest(df, "g", "i", ["u", "v"], 4).collect())) == plain(rows, 4)


@pytest.mark.parametrize("k, looking, seen, pairs", [(5, 3, 4, 8), (1, 512, 2, 1), (40, 7, 4096, 64)])
def test_pieces_of_cells(spark, monkeypatch, k, looking, seen, pairs):
    """Cells of many places are cut, and distances taken bit by bit; ties on a lattice are settled by keys in texts."""
    monkeypatch.setattr(N, "LOOKING", looking), monkeypatch.setattr(N, "SEEN", seen), monkeypatch.setattr(N, "PAIRS", pairs)
    rnd = random.Random(k)
    rows = [("lattice", x, y) for x in range(6) for y in range(6)] + [("even", rnd.randrange(99), rnd.randrange(99)) for _ in range(60)] + [("place", 2, 2)] * 9
    rows = [(g, f"{(i * 37) % 101}", *p) for i, (g, *p) in enumerate(rows)] + [("one", "x", 10**9, -(10**9))]
    df = spark.createDataFrame(rows, "g string, i string, x int, y long")
    assert sorted(map(tuple, N.nearest(df, "g", "i", ["x", "y"], k).collect())) == plain(rows, k)
    with pytest.raises(Exception, match="too far apart"):
        N.nearest(spark.createDataFrame([("a", "b", 0, 0), ("a", "c", 0, 2**32)], df.schema), "g", "i", ["x", "y"], 1).collect()


def test_places_look_in_many_tasks(spark, monkeypatch):
    """Few bytes of one cloud are not left to one task."""
    staged, shares = N._staged, []

    def counted(df, name):
        found = staged(df, name)
        if name == "near":
            shares.append([r[0] for r in found.groupBy(F.input_file_name()).count().select("count").collect()])
        return found

    monkeypatch.setattr(N, "_staged", counted)
    rnd = random.Random(5)
    df = spark.createDataFrame([(1, i, *(rnd.randrange(1000) for _ in "xyz")) for i in range(1000)], "g int, i long, x long, y long, z long")
    assert N.nearest(df, "g", "i", ["x", "y", "z"], 10).count() == 10_000
    assert sum(shares[0]) >= 990 and max(shares[0]) < 500


def test_a_hot_cloud_is_compared_in_cells(spark):
    """Pairs that meet grow with the points, not with their square."""
    met = []
    for n in (2_000, 8_000):
        df = spark.range(n).select(F.lit(1).alias("g"), "id", *(F.rand(s).alias(c) for s, c in enumerate("xyz")))
        laid = df.withColumn("_keys", F.array("id")).join(N._sides(df, "g", ["x", "y", "z"], 5), "g")
        cells = laid.groupBy(*N._cells(["x", "y", "z"], F.col("_side"))).count()
        met.append(cells.agg(F.sum(F.col("count") * F.col("count"))).first()[0])
    assert met[1] < 6 * met[0]


def test_normals(spark):
    rnd = np.random.default_rng(4)
    rows = [(g, i, *map(float, p)) for g in (1, 2) for i, p in enumerate(rnd.normal(size=(60, 3)))] + [(3, i, float(i), 0.5, 2.0) for i in range(2)]
    df = spark.createDataFrame(rows, "g int, i int, x double, y double, z double")
    got = {(r.g, r.i): np.array([r.nx, r.ny, r.nz]) for r in N.normals(df, "g", "i", ["x", "y", "z"], 6, (0.0, 0.0, 9.0)).collect()}
    assert len(got) == len(rows)
    for g in (1, 2):
        x = np.array([r[2:] for r in rows if r[0] == g])
        for i in range(60):
            near = x[np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:7]]
            values, vectors = np.linalg.eigh(np.cov(near.T))
            want = vectors[:, 0] * (1 if vectors[:, 0] @ (np.array([0, 0, 9.0]) - x[i]) >= 0 else -1)
            assert np.allclose(got[g, i], want, atol=1e-6)
    assert got[3, 0].tolist() == [0, 0, 1]
