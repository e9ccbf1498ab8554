"""Runs, manifests and top-k search against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqaspark.llm import merkle_manifest, periodic_runs, queries, top_k_search

DATA = "/root/testdata/sf0.001"


# 11 --------------------------------------------------------------------------------------------------------------------
def plain_runs(t, least=12):
    """Every stretch with t[i] == t[i + q] that cannot grow, kept where q is its smallest period."""
    n, out = len(t), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, 2 * q) and not any(all(t[x] == t[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def kept_words(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_are_all_runs():
    rnd = random.Random(5)
    for _ in range(1500):
        n, letters = rnd.randrange(60), rnd.choice([1, 2, 2, 3, 5])
        t = [rnd.randrange(letters) for _ in range(n)]
        if n and rnd.random() < 0.5:
            p = rnd.randrange(1, n + 1)
            t = [t[i % p] for i in range(n)]
            if rnd.random() < 0.5:
                t[rnd.randrange(n)] = 0
        assert periodic_runs.runs(t, 2) == plain_runs(t, 2) and periodic_runs.runs(t) == plain_runs(t)
        words = [f"w{x}" for x in t]
        found = list(periodic_runs.runs_of_texts([" ".join(words), "a b c " + "\t".join(words), ""]))
        assert found[0] == (n, plain_runs(t), kept_words(words, plain_runs(t))) and found[2] == (0, [], "")
        assert found[1][1] == [(s + 3, m, q) for s, m, q in plain_runs(t)]


def test_lyndon_edges_are_next_smaller_suffixes():
    rnd = random.Random(6)
    for _ in range(500):
        t = [rnd.randrange(2) for _ in range(rnd.randrange(1, 40))]
        after, shared = periodic_runs.lyndon_edges(t)
        for i in range(len(t)):
            j = next(j for j in range(i + 1, len(t) + 1) if t[j:] < t[i:])
            assert after[i] == j and shared[i] == next(k for k in range(len(t)) if t[i + k : i + k + 1] != t[j + k : j + k + 1])


@pytest.mark.parametrize("kind", ["same", "fibonacci", "periods", "random"])
def test_runs_take_linear_time(kind):
    """Words are compared at most a few times each: counted on a list that counts its reads."""

    class Counted(int):
        reads = 0

        def __eq__(self, other):
            Counted.reads += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    t = {"same": [0] * 20_000, "fibonacci": b, "periods": [i % 777 for i in range(20_000)], "random": [random.Random(1).randrange(2) for _ in range(20_000)]}[kind]
    periodic_runs.lyndon_edges([Counted(x) for x in t])
    assert Counted.reads <= 4 * len(t)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_periodic_runs_query(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, DATA).collect()}
    source = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(source) and sum(r.n_runs for r in got.values()) > 10
    for d in source:
        words, r = planted(d.doc_id, d.text), got[d.doc_id]
        runs = plain_runs(words) if len(words) < 400 else sorted(periodic_runs.runs(list(map(sorted(set(words)).index, words))))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept_words(words, runs).encode()).hexdigest()


def test_periodic_runs_of_odd_rows(spark):
    texts = [None, "", " \n\t", "a", "a " * 11, "a " * 12, "a\x1cb\x85c " * 12, "é ü " * 400_000, "x y z " * 4 + "q", "x y z " * 4 + "q"]
    rows = [(i, t, 1, "n") for i, t in enumerate(texts)] + [(None, "b " * 30, 1, "n"), (3, "a", 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    got = {}
    for r in periodic_runs.periodic_runs(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[0] == got[1] == got[2] == [(0, [], "")] and got[3] == [(1, [], "a")] * 2
    assert got[4] == [(11, [], " ".join("a" * 11))] and got[5] == [(12, [(0, 12, 1)], "a")] and got[6] == [(12, [(0, 12, 1)], "a\x1cb\x85c")]
    assert got[7] == [(800_000, [(0, 800_000, 2)], "é ü")] and got[8] == got[9] == [(13, [(0, 12, 3)], "x y z q")] and got[None] == [(30, [(0, 30, 1)], "b")]
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    wrong = spark.sql("SELECT 1L AS doc_id, CAST(repeat(X'FF20', 12) AS STRING) AS text")
    assert periodic_runs.periodic_runs(wrong).first().runs[0].asDict() == {"start": 0, "length": 12, "period": 1}


# 12 --------------------------------------------------------------------------------------------------------------------
def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes, fanout):
    """The root, and the siblings on the left and right of every leaf's way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            first = at[i] - at[i] % fanout
            path.append(("".join(nodes[first : at[i]]), "".join(nodes[at[i] + 1 : first + fanout])))
            at[i] //= fanout
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    """rows: (doc_id, lang, leaf).  Sorted (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(r[1], []).append(r)
    trees = {g: tree([r[2] for r in rs], fanout) for g, rs in groups.items()}
    root, above = tree([trees[g][0] for g in groups], fanout)
    return sorted([(r[0], r[2], trees[g][0], root, [*path, *up]) for (g, rs), up in zip(groups.items(), above, strict=True) for r, path in zip(rs, trees[g][1], strict=True)], key=repr)


@pytest.mark.parametrize("fanout, merged", [(2, 64), (2, 2), (3, 2), (5, 64)])
def test_manifest(spark, monkeypatch, fanout, merged):
    monkeypatch.setattr(merkle_manifest, "MERGED", merged)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rnd = random.Random(fanout)
        langs = ["en"] * 6 + ["de", "", None, "ä", "zh-x"]
        rows = [(rnd.choice([None, 7, rnd.randrange(-50, 500)]), rnd.choice(langs), rnd.choice([None, "t", "é" * 3, "long " * 50]), 5, "x") for _ in range(300)]
        df = spark.createDataFrame([*rows, (1, "alone", "t", 5, "x")], "doc_id long, lang string, text string, level int, grp string").repartition(5)
        got = merkle_manifest.manifest(df, ["doc_id", "lang", "text"], "lang", "doc_id", fanout, {"chars": F.length("text")})
        leaves = [(r[0], r[1], h(field(r[0]) + field(r[1]) + field(r[2]))) for r in [*rows, (1, "alone", "t")]]
        assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in got.collect()], key=repr) == plain_manifest(leaves, fanout)
        assert got.where(merkle_manifest.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
        assert sorted(got.columns) == sorted(["doc_id", "leaf", "subroot", "root", "proof", "chars"])
        assert merkle_manifest.manifest(df.limit(0), ["doc_id"], "lang", "doc_id").count() == 0
        one = merkle_manifest.manifest(df.where("lang = 'alone'"), ["doc_id"], "lang", "doc_id").first()
        assert one.leaf == one.subroot == one.root == h("1:1") and one.proof == []
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_manifest_of_wrong_bytes(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'x' AS lang, CAST(X'61FF' AS STRING) AS text UNION ALL SELECT 2L, CAST(X'FF' AS STRING), 'y'")
    got = {r.doc_id: r for r in merkle_manifest.manifest(df, ["text"], "lang", "doc_id").collect()}
    assert got[1].leaf == hashlib.sha256(b"2:a\xff").hexdigest() and got[2].root == h(got[1].leaf + got[2].leaf)


def test_manifest_query_tells_tampered_rows(spark):
    rows = queries.op12_merkle_manifest(spark, DATA).collect()
    chars = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id for r in rows if not r.verified} == {i for i, n in chars.items() if zlib.crc32(str(i).encode()) % 7 == 0 and n is not None}


# 13 --------------------------------------------------------------------------------------------------------------------
def plain_top(rows, asked, k):
    """rows, asked: (id, vector).  One list for each asked row, which is a row itself."""
    out = []
    for qi, q in asked:
        others = list(rows)
        others.remove((qi, q))
        scored = sorted(((sum(x * y for x, y in zip(q, v, strict=False)), i) for i, v in others), key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        out += [(qi, n, i, s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [16, 200, 1 << 20])
def test_top_k(spark, block):
    rnd = random.Random(block)
    rows = [(i, [rnd.randrange(-300, 300) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(500, [0] * 8), (501, []), (502, [1, 2]), (None, rows[5][1]), (100, rows[100][1]), (100, rows[101][1]), (600, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(900, None, 1), (1000, [1, None], 1)], "vec_id long, vector array<long>, score int")
    asked = df.where("vec_id % 100 = 0")
    got = top_k_search.top_inner_products(df, asked, 10, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert top_k_search.top_inner_products(df.limit(0), asked.limit(0), 10).count() == 0
    one = df.where("vec_id = 500")
    assert top_k_search.top_inner_products(one, one, 10).count() == 0


def test_search_stops_only_on_proof():
    rnd = np.random.default_rng(3)
    for vectors, stops in ((rnd.standard_normal((4000, 32)) ** 3 * 40, True), (rnd.standard_normal((4000, 32)) * 100, False)):
        vectors = vectors.astype(np.int64)
        index, early = top_k_search.ImpactIndex(np.arange(4000), vectors), 0
        for q in vectors[:60]:
            ids, scores, read = index.search(q, 11)
            exact = vectors @ q
            want = np.lexsort((np.arange(4000), -exact))[:11]
            assert (ids == want).all() and (scores == exact[want]).all()
            early += read < np.count_nonzero(q[index.dim_of])
        assert early > 50 or not stops  # with few great components most searches stop early


def test_whole_numbers(spark):
    df = spark.sql("SELECT * FROM VALUES (1, array(0.5f, -0.0001f)), (2, array(1f, NULL)), (3, NULL), (4, array(float('nan'))), (5, array(float('-inf'))), (6, array()) AS t(i, v)")
    got = {r.i: r.w for r in df.select("i", top_k_search.whole_numbers(F.col("v"), 1024).alias("w")).collect()}
    assert got == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []} and math.floor(1024 * -0.0001) == -1
