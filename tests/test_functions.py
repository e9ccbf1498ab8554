"""Hand-computed cases of the functions and operators."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vqaspark.functions import arrays as A
from vqaspark.functions import geometry as G
from vqaspark.functions import text as T
from vqaspark.operators import clouds, joins
from vqaspark.operators.ranking import even_shard, exact_sample, ranked
from vqaspark.sources import readers, sinks


def one(spark, column, schema="a string", row=("",)):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


def test_answers(spark):
    assert one(spark, T.normalise_answer(F.lit("[012,034,100,005]"))) == [0.12, 0.34, 1.0, 0.5]
    assert one(spark, T.corner_boxes(F.lit("<box>lid</box>[[012,034,100]]"))) == [[[0.12, 0.34, 1.0]]]
    found = one(spark, T.tagged_boxes(F.lit("<rb>lid</rb>[12,0.5,3,4,-10000]")))
    assert found[0]["name"] == "lid" and found[0]["values"] == [0.12, 0.5, 0.03, 0.04, None]
    assert one(spark, T.trim_answer(F.lit(" the answer is b3. ### x"))) == "b3"
    assert one(spark, T.number_lists(F.lit("no numbers"))) == []


def test_conversation_without_last_answer(spark):
    turns = F.array(F.struct(F.lit(0).alias("role"), F.lit("Q").alias("text")), F.struct(F.lit(1).alias("role"), F.lit(None).cast("string").alias("text")))
    assert one(spark, T.render_single(F.lit("S"), turns)) == "S\n\n### Human: Q\n### Assistant:"


def test_unknown_role_is_an_error(spark):
    with pytest.raises(Exception, match="unknown role"):
        one(spark, T.role(F.lit("tool")))


def test_prompt_kinds(spark):
    assert one(spark, T.prompt("alpaca", F.lit("do"), F.lit(" \n"))).endswith("### Instruction:\ndo\n\n### Response:")
    with pytest.raises(ValueError):
        T.prompt("odd", F.lit("a"))


def test_numbers(spark):
    assert [one(spark, T.centi(F.lit(x))) for x in (0.125, 0.145, 2.675, -0.001)] == [13, 14, 268, 0]
    assert [one(spark, G.wrapped_angle(F.lit(x))) for x in (178, 180, -10)] == [0, 0, 170]
    assert [one(spark, G.quantise(F.lit(x), -1, 1)) for x in (-1.0, 0.0, 1.0)] == [0, 50, 100]


def test_arrays(spark):
    a = F.array(*map(F.lit, (5, 6, 7, 8)))
    assert one(spark, A.find_sublist(a, F.array(F.lit(7), F.lit(8)))) == 2
    assert one(spark, A.find_sublist(a, F.array(*map(F.lit, range(9))))) == -1
    assert one(spark, A.pad(a, 6)) == [5, 6, 7, 8, -1, -1] and one(spark, A.pad(a, 2)) == [5, 6]
    assert one(spark, A.keep_last(a, 2)) == [7, 8] and one(spark, A.keep_last(a, 9)) == [5, 6, 7, 8]
    assert one(spark, A.tile(a, 6)) == [5, 6, 7, 8, 5, 6]


@settings(max_examples=15, deadline=None)
@given(n=st.integers(0, 40), k=st.integers(1, 9))
def test_even_shards_differ_by_one(spark, n, k):
    got = [r.s for r in spark.range(n).select(even_shard(F.col("id"), F.lit(n), k).alias("s")).orderBy("id").collect()]
    sizes = [got.count(i) for i in range(k)]
    assert got == sorted(got) and sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_ranked_and_sampled(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    rows = ranked(df, ["g"], F.floor(F.col("id") / 64), ["id"]).orderBy("id").collect()
    assert all(r.pos == r.id // 3 and r.pos_total == (334 if r.g == 0 else 333) for r in rows)
    assert exact_sample(df, ["g"], "id", 0.1).groupBy("g").count().orderBy("g").toPandas()["count"].tolist() == [33, 33, 33]


def test_joins(spark):
    left = spark.createDataFrame([("link_10",), ("x",)], "k string")
    right = spark.createDataFrame([("link_1", 1), ("link_10", 2)], "p string, v int")
    assert sorted(r.v for r in joins.prefix_join(left, right, "k", "p").collect()) == [1, 2]
    twice = spark.createDataFrame([("link_1", 1, 7), ("link_1", 2, 9)], "p string, o int, v int")
    assert [r.v for r in joins.last_wins(twice, ["p"], "o").collect()] == [9]


def test_prefixes_of_any_length(spark):
    left = spark.createDataFrame([("x" * 100 + "y",), ("ab",), (None,)], "k string")
    right = spark.createDataFrame([("x" * 65, 1), ("x" * 101, 2), ("x" * 100 + "y", 3), ("abc", 4), ("a", 5), (None, 6)], "p string, v int")
    assert sorted(r.v for r in joins.prefix_join(left, right, "k", "p").collect()) == [1, 3, 5]


def test_rectangle():
    turn = np.array([[np.cos(0.4), -np.sin(0.4)], [np.sin(0.4), np.cos(0.4)]])
    p = np.array([[x, y] for x in range(9) for y in range(4)]) @ turn.T
    *_, w, h, angle = clouds.min_rectangle(p)
    assert np.allclose(sorted((w, h)), (3, 8)) and np.isclose(np.radians(angle) % (np.pi / 2), 0.4)


def test_files(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    rows = readers.ply(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.x, r.z, r.nx) for r in rows] == [(1.0, 3.0, None), (4.0, 6.0, None)]
    np.save(tmp_path / "c.npy", np.array([[0, 0, 0, 255, 0, 0], [1, 1, 1, 0, 255, 0]], float))
    cloud = readers.npy(spark, str(tmp_path), 5).first().cloud
    assert len(cloud) == 5 and cloud[0][3] == 1.0 and cloud[2] == cloud[0]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nnot json\n')
    good, bad = readers.quarantined(spark, str(tmp_path / "j.jsonl"), "a int")
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.json").write_text('{"Oven": {"door": {"open": {"description": "d", "actions": ["pull"]}}}}')
    rows, odd = readers.task_corpus(spark, str(tmp_path / "t"))
    assert rows.first().actions == ["pull"] and odd.count() == 0
    sinks.write_new(spark.range(3), str(tmp_path / "n"), "id")
    sinks.write_new(spark.range(5), str(tmp_path / "n"), "id")
    assert spark.read.parquet(str(tmp_path / "n")).count() == 5


def test_nearly_square_boxes(spark):
    """A turned square keeps its own box, a circle takes the one along the axes."""
    side = np.linspace(-10, 10, 21)
    square = [(x, y) for v in side for x, y in ((v, -10), (v, 10), (-10, v), (10, v))]
    c = np.cos(np.pi / 4)
    turned = [("square", c * (x - y), c * (x + y), 0.0) for x, y in square]
    circle = [("circle", 10 * np.cos(a), 10 * np.sin(a), 0.0) for a in np.linspace(0.1, 0.1 + 2 * np.pi, 97)]
    df = spark.createDataFrame([(g, float(x), float(y), z) for g, x, y, z in turned + circle], "g string, x double, y double, z double")
    got = {r.g: r for r in clouds.oriented_boxes(df, "g", "x", "y", "z").collect()}
    assert abs(got["square"].w - 20) < 1e-6 and abs(got["square"].h - 20) < 1e-6
    assert got["circle"].angle == 0.0 and abs(got["circle"].w - 20) < 0.1


def test_unit_sphere(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 4.0, 0.0), ("b", 7.0, 7.0)], "g string, x double, y double")
    got = sorted((r.g, r.x, r.y) for r in clouds.unit_sphere(df, "g", ["x", "y"]).collect())
    assert got == [("a", -1.0, 0.0), ("a", 1.0, 0.0), ("b", 0.0, 0.0)]


def test_thousandths_are_those_of_floats(spark, tmp_path):
    """Floats whose product with a thousand is half a whole number as a float, but less as a double: every query on vectors agrees with its SQL."""
    import duckdb

    from vqaspark.plans import catalog
    from vqaspark.plans.registry import table, thousandths

    near = np.arange(0.3185, 0.4485, 0.001).astype(np.float32)
    near = np.unique(np.concatenate([np.nextafter(near, np.float32(s)) for s in (0, 1)] + [near]))
    split = [float(v) for v in near if float(v * np.float32(1000)) % 1 == 0.5 and float(v) * 1000 % 1 < 0.5]
    assert len(split) > 20
    rnd = np.random.default_rng(3)
    vectors = [[float(v) for v in np.where(rnd.random(64) < 0.5, rnd.choice(split, 64) * rnd.choice([-1, 1], 64), rnd.normal(0, 0.2, 64)).astype(np.float32)] for _ in range(48)]
    spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    table(spark, "/root/testdata/sf0.001", "conversations").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.v for r in spark.createDataFrame([(float(v),) for v in split], "x float").select(thousandths(F.col("x")).alias("v")).collect()] == [int(np.floor(np.float64(np.float32(v) * np.float32(1000)) + 0.5)) for v in split]
    duck = duckdb.connect()
    for t in ("embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("cloud_colour", "cloud_normalize", "cloud_records", "column_pick", "delta_apply", "delta_extract", "grid_values", "joint_ends", "joint_frame", "knn_small", "ply_roundtrip", "npy_roundtrip", "topp_filter", "softmax_temp", "shard_merge"):
        df, found = catalog.QUERIES[name](spark, str(tmp_path)), duck.execute(catalog.ORACLES[name])
        at = [df.columns.index(c[0]) for c in found.description]
        assert sorted(tuple(r[i] for i in at) for r in df.collect()) == sorted(found.fetchall()), name


def test_ids_of_a_batch_are_four_bytes_each(spark):
    from vqaspark.functions import tokenizer

    held = tokenizer.numbers(tokenizer.word_numbers()("a b a"), [1], [2])
    assert held.dtype == np.int32 and held.nbytes == 20 and held[0] == 1 and held[-1] == 2 and held[1] == held[3]
    df = spark.createDataFrame([(0, "a b a"), (1, ""), (2, None)], "i int, text string")
    got = {r.i: r.t for r in df.select("i", tokenizer.encoded(F.col("text"), tokenizer.word_numbers, 1, 2).alias("t")).collect()}
    assert got == {0: held.tolist(), 1: [1, 2], 2: None}


def test_parents_without_a_join(spark, tmp_path):
    """Repeated, lacking and null numbers and orders, against the SQL."""
    import duckdb

    from vqaspark.plans import catalog

    rows = [(k % 7, k * k % 23) for k in range(90)] + [(1, None), (None, 1), (None, 2), (None, None), (8, 5), (8, 0), (9, 3), (9, 1), (9, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalog.QUERIES["parent_self_join"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(duck.execute(catalog.ORACLES["parent_self_join"]).fetchall(), key=repr)
    assert df.schema["parent"].dataType.typeName() == "integer" and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_shown_box(spark):
    """Against plain code, ragged boxes too."""
    import random

    from vqaspark.plans.task_queries import shown_box

    def plain(text):
        corners = [[int(x) if x and int(x) < 1 << 31 else None for x in p.split(",")] for p in re.findall(r"\[([\d,]+)\]", text)]
        show = lambda p: "[" + ",".join(f"{n // 100}.{n % 100:02d}" for n in p[:3] if n is not None) + "]"
        return "[" + ",".join(show(p) for p in (corners + [[]] * 8)[:8]) + "]"

    rnd = random.Random(3)
    number = lambda: rnd.choice(["0", "5", "00", "07", "012", "100", "0005", "00100", "123456789", "000000001", "99"])
    box = lambda n=8, k=3: ",".join("[" + ",".join(number() for _ in range(k)) + "]" for _ in range(n))
    texts = [box() for _ in range(50)] + [box(7), box(9), box(8, 2), box(8, 4), box(1, 1), box(7) + ",[1,,2]", box(7) + ",[1,2,99999999999]", box(7) + ",[2147483647,2147483648,0000000012]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", shown_box(F.col("t")).alias("s")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_second_questions_write_no_column_for_each_number(spark):
    """The plan named the parsed box at each of its 24 numbers."""
    from vqaspark.plans.task_queries import second_questions

    df = spark.createDataFrame([(1, "<box>lid</box>[[012,034,100]]")], "image int, answer string")
    plan = second_questions(df, "answer", ["image"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast") <= 2 and plan.count("corners") < 10
