"""Small parts against plain code: images, texts, grids, packing, samples of points, listings, configurations."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqaspark.functions import arrays as A
from vqaspark.functions import geometry as G
from vqaspark.functions import images as I
from vqaspark.functions import text as T
from vqaspark.functions.tokenizer import encoded
from vqaspark.operators import batches, clouds, joins
from vqaspark.operators.packing import packed_rows
from vqaspark.sources import ingest, readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# images ----------------------------------------------------------------------------------------------------------------
def test_decoders():
    x = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert np.allclose(I.decoded(b"P6 # by hand\n4 2\n255\n" + x.tobytes()), x / 255)
    out = io.BytesIO()
    np.save(out, x)
    assert np.allclose(I.decoded(out.getvalue()), x / 255)
    with pytest.raises(ValueError, match="no decoder"):
        I.decoded(b"\x89PNG")


def test_resizing():
    rnd = np.random.default_rng(1)
    x = rnd.random((12, 8, 3))
    assert np.array_equal(I.resized(x, 12, 8), x)
    flat = np.full((9, 7, 3), 0.3)
    assert np.allclose(I.resized(flat, 4, 5), 0.3) and I.resized(flat, 4, 5).shape == (4, 5, 3)
    ramp = np.linspace(0.2, 0.8, 64)[None, :, None] * np.ones((3, 1, 3))
    assert np.allclose(np.diff(I.resized(ramp, 3, 16)[1, 2:-2, 0]), 0.6 / 63 * 4, atol=1e-9)  # a slope stays a slope
    up = I.resized(x, 24, 16)
    for i, j in ((5, 7), (10, 9), (13, 6)):  # four by four neighbours, cubic weights by the distance of the centres
        y, z = (i + 0.5) / 2 - 0.5, (j + 0.5) / 2 - 0.5
        kernel = lambda t: (1.5 * t - 2.5) * t * t + 1 if t < 1 else ((-0.5 * t + 2.5) * t - 4) * t + 2 if t < 2 else 0
        rows, cols = range(math.floor(y) - 1, math.floor(y) + 3), range(math.floor(z) - 1, math.floor(z) + 3)
        want = sum(kernel(abs(r - y)) * kernel(abs(c - z)) * x[r, c] for r in rows for c in cols)
        assert np.allclose(up[i, j], np.clip(want, 0, 1))


def test_transforms(spark):
    x = np.zeros((6, 10, 3))
    x[:, 4:6] = 1
    middle = I.resized_center_crop(x, 6)
    assert middle.shape == (6, 6, 3) and np.array_equal(middle, x[:, 2:8])
    pad = I.padded_resize(x, 10)
    assert np.allclose(pad[:2], I.MEAN) and np.allclose(pad[8:], I.MEAN) and np.array_equal(pad[2:8], x)
    crops = [I.random_resized_crop(np.random.default_rng(2).random((40, 40, 3)), 8, f"k{i}") for i in range(4)]
    assert all(c.shape == (8, 8, 3) for c in crops) and not np.allclose(crops[0], crops[1])
    assert np.array_equal(I.random_resized_crop(x, 4, "same"), I.random_resized_crop(x, 4, "same"))
    df = spark.createDataFrame([("a", b"P6\n1 1\n255\n\xff\x00\x80"), ("n", None)], "path string, content binary")
    got = {r.path: r.pixels for r in I.transformed(df, "resized_center_crop", 1).collect()}
    assert np.allclose(got["a"], (np.array([1, 0, 128 / 255]) - I.MEAN) / np.array(I.DEVIATION), atol=1e-6) and got["n"] is None
    with pytest.raises(ValueError, match="unknown transform"):
        I.transformed(df, "odd")


# texts -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("said, want", [
    ("['a', \"it's\"]", ["a", "it's"]), ("[]", []), ("[ 'x' , ]", ["x"]), ("['a\\'b', \"c\\\"d\"]", ["a'b", 'c"d']), ("['say \"hi\"', '[1, 2]']", ['say "hi"', "[1, 2]"]),
    ("['a' 'b']", []), ("['a'", []), ("no list", []), ("[1]", []), ("['it's']", []), (" \n['a',\n 'b'] ", ["a", "b"]), ("['']", [""]),
])
def test_literal_list(spark, said, want):
    assert one(spark, T.literal_list(F.lit(said))) == want


def test_markers_and_templates(spark):
    before, after = T.after_marker(F.lit("a.b###Output: c###Output: d"), "###Output: ")
    assert (one(spark, before), one(spark, after)) == ("a.b", "c###Output: d")
    assert one(spark, T.after_marker(F.lit("axb"), ".")[0]) is None and one(spark, T.after_marker(F.lit("a."), ".")[1]) == ""
    filled = T.fill_template("A {X} and {Y} and {X}.", {"X": F.lit("{Y}"), "Y": F.lit(3)})
    assert one(spark, filled) == "A {Y} and 3 and {Y}."
    with pytest.raises(ValueError, match="no value"):
        T.fill_template("{Z}", {})
    assert one(spark, T.rewritten(F.lit("a/pointclouds/x.ply"), {"pointclouds": "npy_8192", ".ply": ".npy"})) == "a/npy_8192/x.npy"


def test_encoder_is_made_once_a_task(spark, tmp_path):
    made = str(tmp_path / "made")

    def factory():
        with open(made, "a") as f:
            f.write("x")
        return lambda t: [len(t)]

    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(100, numPartitions=2).select(F.col("id").cast("string").alias("t")).withColumn("e", encoded(F.col("t"), factory, 1, 2))
        assert sorted(r.e for r in df.collect()) == sorted([1, len(str(i)), 2] for i in range(100))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert open(made).read() == "xx"


# arrays, batches -------------------------------------------------------------------------------------------------------
def test_grids(spark):
    m = F.array(*[F.array(*[F.lit(float(10 * r + c)) for c in range(6)]) for r in range(4)])
    parts = one(spark, A.split_grid(m, 2))
    assert parts[1] == [[3, 4, 5], [13, 14, 15]] and parts[2] == [[20, 21, 22], [30, 31, 32]]
    assert one(spark, A.merge_grid(A.split_grid(m, 2), 2)) == [[10.0 * r + c for c in range(6)] for r in range(4)]
    with pytest.raises(Exception, match="does not divide"):
        one(spark, A.split_grid(m, 4))


def test_packing(spark):
    rows = [(3, [1, 7, 8, 2]), (1, [1, 5, 2]), (2, [9, 9, 9, 9, 2]), (4, []), (5, [1])]
    df = spark.createDataFrame(rows, "k long, t array<int>")
    got = {r.chunk: r.tokens for r in packed_rows(df, "k", "t", 4).collect()}
    assert got == {0: [5, 2, 9, 9], 1: [9, 9, 2, 7], 2: [8, 2, 0, 0]}
    assert [tuple(r) for r in packed_rows(df.limit(0), "k", "t", 4).collect()] == [(0, [0, 0, 0, 0])]
    assert [tuple(r) for r in packed_rows(df.where("k > 3"), "k", "t", 3).collect()] == [(0, [0, 0, 0])]
    whole = packed_rows(df, "k", "t", 6, bos=None)
    assert {r.chunk: r.tokens for r in whole.collect()} == {0: [1, 5, 2, 9, 9, 9], 1: [9, 2, 1, 7, 8, 2], 2: [1, 0, 0, 0, 0, 0]}


def test_padding(spark):
    df = spark.createDataFrame([(1, [5]), (1, [6, 7, 8]), (2, []), (2, [9])], "b int, t array<int>")
    assert sorted((r.b, r.t) for r in batches.padded(df, "b", "t").collect()) == [(1, [5, 0, 0]), (1, [6, 7, 8]), (2, [0]), (2, [9])]


# geometry, clouds ------------------------------------------------------------------------------------------------------
def test_projection(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    got = [one(spark, c) for c in G.project_share(lit(1, 2, -4), 100, 200, 320, 240, 640, 480, F.lit(2.0), F.lit(6.0))]
    assert np.allclose(got, [(0.25 * 100 + 320) / 640, (-0.5 * 200 + 240) / 480, 2 / (4 + 1e-6)])
    assert [one(spark, c) for c in G.project_share(lit(-99, 99, 1), 100, 100, 0, 0, 10, 10, F.lit(0.0), F.lit(0.1))] == [1, 1, 1]
    assert [one(spark, c) for c in G.axis_depths(*lit(-3, 5, 1, 5), F.lit(True))] == [1.0, 0.5] and one(spark, G.axis_depths(*lit(3, 5, 2, 2), F.lit(False))[0]) is None
    c, s = math.cos(0.3), math.sin(0.3)
    turned = [0.2 * c - 0.1 * s + 5, 0.2 * s + 0.1 * c + 6]  # the place (0.2, 0.1) of a box turned by 0.3 around (5, 6)
    got = [one(spark, x) for x in G.place_in_box(lit(*turned, 0), [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]], [5.0, 6.0, 0.0], lit(1, 0.5))]
    assert np.allclose(got, [0.7, 0.7])


def test_farthest_points(spark):
    rnd = np.random.default_rng(8)
    rows = [(g, i, *map(float, p)) for g in (1, 2) for i, p in enumerate(rnd.random((60, 3)))] + [(3, 0, 0.0, 0.0, 0.0)]
    got = clouds.farthest_points(spark.createDataFrame(rows, "g int, i int, x double, y double, z double"), "g", "i", ["x", "y", "z"], 9).collect()
    for g in (1, 2, 3):
        x = np.array([r[2:] for r in rows if r[0] == g])
        want = [0]
        while len(want) < min(9, len(x)):
            want.append(int(np.argmax([min(((p - x[j]) ** 2).sum() for j in want) if i not in want else -1 for i, p in enumerate(x)])))
        assert [r.i for r in sorted(got, key=lambda r: r.rank) if r.g == g] == want


def test_noise_and_poses(spark):
    df = spark.range(20_000).select("id", F.lit(3.0).alias("x"), F.lit(-1.0).alias("y"), F.lit(0.0).alias("z"))
    got = clouds.camera_poses(clouds.jittered(df, ["x", "y", "z"], 0.5, seed=4), 2.0, seed=9)
    p = np.array([tuple(r) for r in got.select("x", "y", "z", "camera_x", "camera_y", "camera_z").collect()])
    assert np.allclose(p[:, :3].mean(0), [3, -1, 0], atol=0.02) and np.allclose(p[:, :3].std(0), 0.5, atol=0.02) and abs(np.corrcoef(p[:, :3].T)[0, 1]) < 0.03
    assert np.allclose((p[:, 3:] ** 2).sum(1), 4) and np.allclose(p[:, 3:].mean(0), 0, atol=0.05) and np.allclose((p[:, 3:] ** 2).mean(0), 4 / 3, atol=0.05)
    assert got.exceptAll(clouds.camera_poses(clouds.jittered(df, ["x", "y", "z"], 0.5, seed=4), 2.0, seed=9)).count() == 0


def test_colours(spark):
    df = spark.createDataFrame([(1, 255.0, -4.0, 0.0), (1, 51.0, 0.5, 300.0), (2, 0.5, 1.0, -0.2)], "g int, r double, g2 double, b double")
    got = sorted(tuple(r) for r in clouds.unit_colour(df, "g", ["r", "g2", "b"]).collect())
    assert np.allclose(got, [(1, 0.2, 0.5 / 255, 1), (1, 1, 0, 0), (2, 0.5, 1, 0)])


# joins, sources --------------------------------------------------------------------------------------------------------
def test_listings_must_match(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "i int, image string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "i int, depth string")
    assert sorted(map(tuple, joins.paired(a, b, ["i"]).collect())) == [(1, "a", "x"), (2, "b", "y")]
    for more in ([(3, "z")], [(2, "again")]):
        with pytest.raises(Exception, match="listings differ"):
            joins.paired(a, b.unionByName(spark.createDataFrame(more, b.schema)), ["i"]).collect()
    with pytest.raises(Exception, match="listings differ"):
        joins.paired(a, b.limit(1), ["i"]).collect()


def test_rules_are_few(spark, monkeypatch):
    monkeypatch.setattr(joins, "RULES", 3)
    left, rules = spark.createDataFrame([("abc",)], "k string"), spark.createDataFrame([(x,) for x in ("a", "ab", "b", "c")], "p string")
    with pytest.raises(ValueError, match="more than 3 rules"):
        joins.rule_join(left, rules, F.startswith("k", "p"), ["k"], F.length("p"))
    assert joins.rule_join(left, rules.limit(3), F.startswith("k", "p"), ["k"], F.length("p")).first().p == "ab"


def test_json_arrays(spark, tmp_path):
    rows = [(f"i{k:02}", [("human", "q"), ("gpt", None)]) for k in range(23)]
    df = spark.createDataFrame(rows, readers.CONVERSATION).repartition(4)
    sinks.write_json_arrays(df, str(tmp_path / "a"), ["image"], 10)
    assert len([f for f in (tmp_path / "a").iterdir() if f.name.endswith(".txt")]) == 3
    assert readers.json_records(spark, str(tmp_path / "a")).exceptAll(df).count() == 0 and readers.json_records(spark, str(tmp_path / "a")).count() == 23
    (tmp_path / "bad.json").write_text('[{"image": "x", "conversations": []}, {"image": ')
    with pytest.raises(Exception):
        readers.json_records(spark, str(tmp_path / "bad.json")).collect()


def test_config_files(spark, tmp_path):
    spark.createDataFrame([("a.png", [("human", "hi")]), (None, [("human", "yo")])], readers.CONVERSATION).write.json(str(tmp_path / "x"))
    config = tmp_path / "c.yaml"
    config.write_text(f"META:\n- path: {tmp_path}/x\n  type: t\n  root: r\n")
    assert sorted((r.image or "") for r in ingest.load_config(spark, str(config)).collect()) == ["", "r/a.png"]
    assert ingest.load_config(spark, str(config), "text").count() == ingest.load_config(spark, str(config), "image_text").count() == 1
    with pytest.raises(ValueError, match="unknown data set"):
        ingest.load_config(spark, str(config), "odd")
    config.write_text("META:\n- path: x\n  kind: y\n")
    with pytest.raises(ValueError, match="unknown fields"):
        ingest.load_config(spark, str(config))
    config.write_text("other: 1\n")
    with pytest.raises(ValueError, match="no sources"):
        ingest.load_config(spark, str(config))
    with pytest.raises(ValueError, match="no list"):
        readers.manifest_file(spark, str(config))


def test_corpora_merge_two_levels(spark, tmp_path):
    kind = "category string, link string, task string, description string, actions array<string>, required_status string"
    old = [("Box", "lid", "open", "old", ["a"], None), ("Box", "lid", "close", "old", ["b"], "open"), ("Box", "knob", "turn", "old", [], None)]
    new = [("Box", "lid", "open", "new", ["c"], None), ("Box", "door", "push", "new", ["d"], None), ("Door", "lid", "open", "new", [], None)]
    for name, rows in (("old", old), ("new", new)):
        sinks.write_corpus(spark.createDataFrame(rows, kind), str(tmp_path / name), links=1)
    sinks.merge_corpus(spark, *(str(tmp_path / n) for n in ("old", "new", "merged")))
    got = sorted(tuple(r)[1:] for r in readers.task_corpus(spark, str(tmp_path / "merged"))[0].collect())
    assert got == sorted([new[0], old[1], old[2], new[1], new[2]])
    (tmp_path / "old" / "part-bad.txt").write_text('["no", "tree"]')
    with pytest.raises(ValueError, match="do not parse"):
        sinks.merge_corpus(spark, *(str(tmp_path / n) for n in ("old", "new", "again")))
