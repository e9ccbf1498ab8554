"""Records joined with payloads, and grounded in a corpus."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqaspark.operators import grounding
from vqaspark.operators.grounding import drawn, grounded_actions, grounded_tasks
from vqaspark.operators.payloads import with_payloads


@pytest.mark.parametrize("asks", [1, 3, 1000])
def test_payloads(spark, asks):
    files = spark.createDataFrame([(f"p{i}", bytes([i]) * (i + 1), "x") for i in range(6)] + [("none", None, "x")], "path string, content binary, image string")
    rows = [(i, "p0", f"p{i % 6}") for i in range(20)] + [(20, None, "p1"), (21, "p2", None), (22, None, None), (23, "none", "p5"), (1, "p0", "p1")]
    df = spark.createDataFrame(rows, "id long, image string, path string").repartition(3)
    got = sorted(map(tuple, with_payloads(df, files, ["image", "path"], asks=asks).collect()), key=repr)
    told = lambda p: None if p in (None, "none") else bytes([int(p[1])]) * (int(p[1]) + 1)
    assert got == sorted([(i, a, b, told(a), told(b)) for i, a, b in rows], key=repr)
    lost = df.unionByName(spark.createDataFrame([(99, "p1", "gone")], df.schema))
    with pytest.raises(Exception, match="no payload at gone"):
        with_payloads(lost, files, ["image", "path"], asks=asks).collect()
    assert with_payloads(lost, files, ["image", "path"], missing="null", asks=asks).where("id = 99").first()[-2:] == (b"\1\1", None)
    kept = with_payloads(lost, files, ["image", "path"], missing="drop", asks=asks)
    assert kept.count() == len(rows) and kept.where("id = 99").count() == 0
    assert with_payloads(df.limit(0), files, ["image"], asks=asks).count() == 0


def test_actions(spark):
    links = [("closed_lid", "[1]"), ("lid", "[2]"), ("drawer", "[3]")]
    cases = [
        (["open['lid']", "pull['drawer']"], links, "<rb>open</rb>[2],<rb>pull</rb>[3]"),
        (["open['closed_lid']"], links, "<rb>open</rb>[1]"),  # the first in order that the text holds
        (["push['knob']", "pull['drawer']", "turn['knob']"], links, "<rb>pull</rb>[3],"),
        (["pull['drawer']", "StatusComplete"], links, "<rb>pull</rb>[3],StatusComplete"),
        (["StatusComplete['lid']", "pull['drawer']"], links, "StatusComplete<rb>pull</rb>[3]"),
        (["StatusComplete"], [], ""), ([], links, ""), (["StatusComplete"], links, "StatusComplete"),
    ]
    df = spark.createDataFrame([(i, a, p) for i, (a, p, _) in enumerate(cases)], "i int, a array<string>, l array<struct<name:string,box:string>>")
    got = {r.i: r.x for r in df.select("i", grounded_actions(F.col("a"), F.col("l"), "rb").alias("x")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_drawn_tasks_with_one_retry(spark):
    corpus = [("Box", "lid", f"t{i}", f"do {i}", ["open['lid']"] if i % 2 else ["push['knob']"]) for i in range(6)] + [("Box", "drawer", "d", "pull it", ["pull['drawer']"]), ("Door", "lid", "x", "no box", ["x['lid']"])]
    tasks = spark.createDataFrame(corpus, "category string, link string, task string, description string, actions array<string>")
    rows = [(i, "Box", "lid", f"[{i}]", 1) for i in range(40)] + [(7, "Box", "drawer", "[d]", 2), (8, "Box", "drawer", "[d]", 0), (41, "Box", "knob", "[k]", 1), (9, "Box", "lid", "[later]", 5)]
    links = spark.createDataFrame(rows, "image long, class string, name string, box string, place int")
    got = {r.image: (r.description, r.actions) for r in grounded_tasks(links, tasks, "rb", order=["place"]).collect()}
    order = {(r.image, r.task): (r.a, r.b) for r in links.select("image").distinct().crossJoin(tasks.where("category = 'Box' AND link = 'lid'").select("task")).select("image", "task", drawn("task", "image", 1).alias("a"), drawn("task", "image", 2).alias("b")).collect()}
    for i in range(40):
        if i == 7:  # its last part is the drawer
            assert got[7] == ("pull it", "<rb>pull</rb>[d]")
            continue
        draws = [min((f"t{k}" for k in range(6)), key=lambda t: (order[i, t][d], t)) for d in (0, 1)]  # noqa: B023
        good = next((t for t in draws if int(t[1]) % 2), None)
        box = "[later]" if i == 9 else f"[{i}]"
        assert got.get(i) == (good and (f"do {good[1]}", f"<rb>open</rb>{box}"))
    assert 41 not in got and 20 < len(got) < 40


@pytest.mark.parametrize("block", [4, 1024])
def test_draws_by_blocks(spark, block, monkeypatch):
    """Draws of blocks of images among blocks of tasks, texts of every length among them, against hashlib; no row for a pair."""
    import hashlib

    monkeypatch.setattr(grounding, "BLOCK", block)
    images = [f"{'i' * (k % 45)}{k}" for k in range(90)] + ["é", ""]
    tasks = [f"{'t' * (k % 50)}{k}" for k in range(60)] + ["ß:x", ""]
    told = lambda seed, i, t: hashlib.md5(f"{seed}:{i}:{t}".encode()).hexdigest() + t
    want = {(i, *(min(told(seed, i, t) for t in tasks) for seed in (1, 2))) for i in images}
    assert [(i, a, b) for i, a, b in zip(images, grounding.least_draws(1, images, tasks), grounding.least_draws(2, images, tasks), strict=True) if (i, a, b) not in want] == []
    own = spark.createDataFrame([(i, "k") for i in images] + [("alone", "none")], "image string, class string")
    found = grounding.least_tasks(own, spark.createDataFrame([("k", t) for t in tasks], "class string, task string"), ["class"], "image")
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [image") < plan.index("MapInArrow") < plan.index("Join Inner, (class")


def test_second_draws_only_where_the_first_says_too_little(spark, monkeypatch):
    made, least = [], grounding.least_tasks

    def counted(images, *rest):
        found = least(images, *rest)
        made.append((found.columns[1:], images.count()))
        assert "Repartition " in found._jdf.queryExecution().optimizedPlan().toString()  # by number: few bytes are not left to one task
        return found

    monkeypatch.setattr(grounding, "least_tasks", counted)
    tasks = spark.createDataFrame([("Box", "lid", f"t{i}", f"do {i}", ["open['lid']"] if i % 4 else ["push['knob']"]) for i in range(8)], "category string, link string, task string, description string, actions array<string>")
    links = spark.createDataFrame([(i, "Box", "lid", f"[{i}]") for i in range(60)] + [(60, "Box", "knob", "[k]"), (None, "Box", "lid", "[n]")], "image long, class string, name string, box string")
    found = grounded_tasks(links, tasks, "rb")
    said = {i: [int(min((hashlib.md5(f"{seed}:{i}:t{k}".encode()).hexdigest(), f"t{k}") for k in range(8))[1][1:]) for seed in (1, 2)] for i in range(60)}
    want = {(i, f"do {k}", f"<rb>open</rb>[{i}]") for i, both in said.items() for k in [next((k for k in both if k % 4), None)] if k}
    assert set(map(tuple, found.collect())) == want
    assert made == [(["draw1"], 60), (["draw2"], sum(both[0] % 4 == 0 for both in said.values()))] and 0 < made[1][1] < 30


@pytest.mark.parametrize("alike", [True, False])
def test_first_bytes_of_digests(alike):
    """Blocks of words that are one number for all, or differ, against hashlib."""
    texts = [f"1:{k if not alike else 'x'}:{'t' * (5 if alike else k % 45)}{k}".encode() for k in range(300)]
    words = np.stack([grounding._words([t], 0, True)[0] for t in texts])
    given = [int(w[0]) if (w == w[0]).all() else w.copy() for w in words.T]
    assert any(isinstance(w, int) for w in given) and any(not isinstance(w, int) for w in given)
    assert [hashlib.md5(t).hexdigest()[:8] for t in texts] == [f"{v:08x}" for v in grounding.md5_firsts(given, len(texts)).tolist()]


@pytest.mark.parametrize("name", ["metadata_walk", "two_image_records"])
def test_files_of_rows_are_written_by_many_tasks(spark, name, tmp_path, monkeypatch):
    """Few bytes in many files are not left to one task."""
    import glob

    from vqaspark.plans import catalog, store_queries

    monkeypatch.setattr(store_queries, "scratch", lambda spark, folder: f"{tmp_path}/{folder}")
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    tasks = {f.rsplit("/part-", 1)[1][:5] for f in glob.glob(f"{tmp_path}/**/part-*.txt", recursive=True)}
    assert len(tasks) > 4


def test_files_that_the_driver_does_not_list(spark, tmp_path):
    from vqaspark.sources import many_files

    rows = [(f"page={i}", bytes([i, 255, 10])) for i in range(200)] + [("a/b #1%", b"x"), ("é", b""), ("two", b"1\n"), ("two", b"2\n"), ("page=7.txt", b"7")]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    base = f"file:{tmp_path}/x y"
    (tmp_path / "x y" / "_temporary").mkdir(parents=True)
    (tmp_path / "x y" / "_temporary" / "part-00000-lost.txt").write_bytes(b"of a lost task")
    many_files.write_files(df.where("name != 'é'"), base, "name", "content", ".txt", 8)
    (tmp_path / "x y" / "note.md").write_bytes(b"another file")
    got = many_files.read_files(spark, base, ".txt", 5).collect()
    assert all(len(r.content) == r.length for r in got) and len({r.path for r in got}) == len(got) == 203
    two = [r.content for r in got if r.path.endswith("-two.txt")]
    assert two in ([b"1\n2\n"], [b"2\n1\n"])
    assert sorted(bytes(r.content) for r in got if not r.path.endswith("-two.txt")) == sorted(c for n, c in rows if n not in ("é", "two"))
    many_files.write_files(df, base, "name", "content", ".txt", 8)  # a task that is through is not written over
    assert sorted(r.path for r in many_files.read_files(spark, base, ".txt", 5).collect()) == sorted(r.path for r in got)
    many_files.write_files(df.limit(0), f"{base}/none", "name", "content", ".txt", 2)
    assert many_files.read_files(spark, f"{base}/none", ".txt", 5).count() == 0


def test_two_images_keep_their_files_off_the_driver(spark):
    from vqaspark.plans import catalog

    found = catalog.QUERIES["two_image_records"](spark, "/root/testdata/sf0.001")
    assert found.count() and not any(f.endswith(".txt") for f in found.inputFiles())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 2  # contents are never broadcast
