"""Polygons, trees and shards against plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vqaspark.functions import polygons as P
from vqaspark.operators.shards import add_tables, merge_shards
from vqaspark.operators.trees import depths


def plain_clip(a, b):
    """Sutherland and Hodgman."""
    out = a
    for (x1, y1), (x2, y2) in zip(b, b[1:] + b[:1], strict=True):
        side = lambda p: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)  # noqa: E731, B023
        held, out = out, []
        for p, q in zip(held, held[1:] + held[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if (s >= 0) != (t >= 0):
                k = s / (s - t)
                out.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
    return out


def plain_area(p):
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def corners(cx, cy, w, h, d):
    c, s = math.cos(math.radians(d)), math.sin(math.radians(d))
    return [(cx + a * w / 2 * c - b * h / 2 * s, cy + a * w / 2 * s + b * h / 2 * c) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def test_rotated_iou(spark):
    rnd = random.Random(7)
    box = lambda: [rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0.1, 9), rnd.uniform(0.1, 9), rnd.uniform(-180, 180)]
    rows = [(*box(), *box()) for _ in range(200)]
    same, apart, inside, flat = (0.0, 0.0, 2.0, 2.0, 30.0) * 2, (0.0, 0.0, 1.0, 1.0, 45.0, 9.0, 9.0, 1.0, 1.0, 0.0), (5.0, 5.0, 8.0, 8.0, 0.0, 5.0, 5.0, 1.0, 1.0, 20.0), (1.0, 1.0, 0.0, 3.0, 0.0) * 2
    rows += [same, apart, inside, flat, (0.0, 0.0, 2.0, 2.0, 0.0, 1.0, 0.0, 2.0, 2.0, 0.0), (0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0)]
    names = [f"{k}{i}" for i in "ab" for k in ("x", "y", "w", "h", "d")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names))
    mine, other = (P.rotated_rectangle(*(F.col(n) for n in names if n[1] == k)) for k in "ab")
    got = {r.i: r.iou for r in df.select("i", P.polygon_iou(mine, other).alias("iou")).collect()}
    for i, r in enumerate(rows[:200]):
        a, b = corners(*r[:5]), corners(*r[5:])
        common = plain_area(plain_clip(a, b)) if len(plain_clip(a, b)) > 2 else 0
        assert math.isclose(got[i], common / (plain_area(a) + plain_area(b) - common), abs_tol=1e-9)
    assert [round(got[i], 9) for i in range(200, 206)] == [1, 0, round(1 / 64, 9), 0, round(1 / 3, 9), 0]


def test_depths_of_any_tree(spark):
    rnd = random.Random(2)
    up = {("chain", i): i - 1 if i else None for i in range(200)} | {("bush", i): rnd.randrange(i) if i else -5 for i in range(100)} | {("twigs", i): i + 1000 for i in range(5)}
    df = spark.createDataFrame([(g, i, p) for (g, i), p in up.items()], "g string, i long, p int").repartition(4)
    step = F.when(F.col("i") % 3 == 0, 0).otherwise(1)
    got = {(r.g, r.i): (r.depth, r.above) for r in depths(df, ["g"], "i", "p", step).collect()}

    def plain(g, i):
        depth = 0
        while i is not None and (g, i) in up:
            depth, i = depth + (i % 3 != 0), up[g, i]
        return depth, i

    assert got == {k: plain(*k) for k in up}
    assert depths(df.limit(0), ["g"], "i", "p", step).count() == 0
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "i int, p int")
    with pytest.raises(ValueError, match="cycle"):
        depths(ring, [], "i", "p", F.lit(1))


RULES = [(r"emb", 1), (r"layers\.\d+\.wq$", 0), (r"layers\.\d+\.norm", -1)]


def test_shards(spark):
    rows = [("emb", s, r, [10 * s + r, 1 + s][: 2 - s]) for s in (0, 1) for r in (0, 1)]  # ragged: two values of shard 0, one of shard 1
    rows += [("layers.3.wq", 1, 0, [7]), ("layers.3.wq", 0, 0, [1, 2]), ("layers.3.wq", 0, 1, [3]), ("layers.0.norm", 0, 0, [5]), ("layers.0.norm", 1, 0, [5])]
    kind = "key string, shard int, row long, values array<int>"
    df = spark.createDataFrame(rows, kind)
    got = sorted(tuple(r) for r in merge_shards(df, RULES, 2).collect())
    assert got == [("emb", 0, [0, 1, 10]), ("emb", 1, [1, 1, 11]), ("layers.0.norm", 0, [5]), ("layers.3.wq", 0, [1, 2]), ("layers.3.wq", 1, [3]), ("layers.3.wq", 2, [7])]
    more = spark.createDataFrame([*rows, ("head.bias", 0, 0, [1]), ("head.bias", 1, 0, [1])], kind)
    with pytest.raises(Exception, match="unknown key: head.bias"):
        merge_shards(more, RULES, 2).collect()
    assert sorted(tuple(r) for r in merge_shards(more, RULES, 2, ignore_unknown=True).collect()) == got
    with pytest.raises(Exception, match="not all shards of key: layers.3.wq"):
        merge_shards(df.where("NOT (key LIKE '%wq' AND shard = 1)"), RULES, 2).collect()
    with pytest.raises(Exception, match="not in all shards of key: emb"):
        merge_shards(df.where("NOT (key = 'emb' AND shard = 1 AND row = 1)"), RULES, 2).collect()
    whole = merge_shards(df, RULES, 2)
    delta = spark.createDataFrame([("emb", 1, [1, 1, 1])], "key string, row long, values array<int>")
    assert dict(((r.key, r.row), r["values"]) for r in add_tables(whole, delta).collect())["emb", 1] == [2, 2, 12] and add_tables(whole, delta).count() == 6
    for bad, message in ((("emb", 9, [1]), "not in the base: emb"), (("emb", 0, [1]), "other lengths: emb")):
        with pytest.raises(Exception, match=message):
            add_tables(whole, spark.createDataFrame([bad], "key string, row long, values array<int>")).collect()


def test_overlap_terms_and_halves_as_the_sql_sums_them(spark, tmp_path):
    """The rows lie within the other box with shares of an exact half of a ten-thousandth, or are cut by it, apart from it, or repeated."""
    import duckdb

    from vqaspark.plans import catalog

    inside = [(10618, 6, 1854, 32), (20189, 3, 5417, 920), (26586, 5, 5411, 993), (37434, 6, 17209, 769), (39538, 5, 8297, 405), (41055, 6, 10761, 105), (43402, 3, 5417, 31), (55817, 5, 2947, 992)]
    rows = [(*r, q) for r in inside for q in (10.0, 13.0, 15.0, 18.0, 26.0, 30.0)] + [(7, 1 + i % 7, i * 37, i * 11, float(1 + i % 50)) for i in range(200)] + [(8, 1, 60, 40, 20.0)] * 2
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"
    df = spark.createDataFrame(rows, names)
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert sorted(map(tuple, catalog.QUERIES["rotated_iou"](spark, str(tmp_path)).collect())) == sorted(con.execute(catalog.ORACLES["rotated_iou"]).fetchall())

    rnd = random.Random(11)
    pairs = [tuple(rnd.uniform(0, 10) if k < 2 else rnd.uniform(0.1, 9) if k < 4 else rnd.uniform(-180, 180) for _ in "ab" for k in range(5)) for _ in range(100)]
    pairs += [(0.0, 0.0, 2.0, 2.0, 0.0, 1.0, 0.5, 2.0, 2.0, 0.0), (0.0, 0.0, 2.0, 2.0, 90.0, 5.0, 0.0, 2.0, 2.0, 0.0), (5.0, 5.0, 8.0, 8.0, 0.0, 5.0, 5.0, 1.0, 1.0, 0.0)]  # sides along each other's
    names = [f"{k}{i}" for i in "ab" for k in ("x", "y", "w", "h", "d")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(pairs)], "i int, " + ", ".join(f"{n} double" for n in names))
    a, b = ([F.col(n) for n in names if n[1] == k] for k in "ab")
    got = {r.i: r.s for r in P.overlap_terms(df, a, b, "t").groupBy("i").agg(F.sum("t").alias("s")).collect()}
    for i, r in enumerate(pairs[:100]):
        both = plain_clip(corners(*r[:5]), corners(*r[5:]))
        assert math.isclose(got[i], plain_area(both) if len(both) > 2 else 0, abs_tol=1e-9)
    assert [round(got[i], 9) for i in range(100, 103)] == [1.5, 0, 1]
