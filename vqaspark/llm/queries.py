"""The training-data queries: thin calls of the operators with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, license_scan, merkle_manifest, near_duplicates, packing, periodic_runs, personal_data, quality, secret_scan, token_counts, token_store, top_k_search
from .common import documents

#: The vocabulary files of the queries; the operators take any path.
WORD_VOCABULARY, BYTE_VOCABULARY = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), WORD_VOCABULARY)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_VOCABULARY)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(documents(spark, sf_dir), BYTE_VOCABULARY)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), quality.fit_on(spark, sf_dir))


def _id_crc() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose crc of the id ends in 0 with a tail that repeats: word i from a on is the original word a + (i - a) % p."""
    text = F.coalesce(F.make_valid_utf8("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(_id_crc() / 10)
    df = docs.select("doc_id", text.alias("text"), F.when(_id_crc() % 10 == 0, words).alias("words"), g.alias("g"))
    df = df.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    n, a, p = (F.col(c).cast("int") for c in ("n", "a", "p"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return df.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_planted_runs(documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    df = found.withColumn("best", best).withColumn("period", -F.col("best.period"))
    return df.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), "period",
        F.expr("(1000 * best.length) div period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = merkle_manifest.leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF_FIELDS])
    shown = F.when(_id_crc() % 7 == 0, changed)
    found = merkle_manifest.manifest(documents(spark, sf_dir), LEAF_FIELDS, "lang", "doc_id", keep={"changed": shown})
    root = merkle_manifest.folded(F.coalesce("changed", "leaf"), F.col("proof"))
    df = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return df.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", top_k_search.whole_numbers(F.col("embedding"), 1024).alias("vector"))
    return top_k_search.top_inner_products(rows, rows.where("vec_id % 100 = 0"), 10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_personal_data, op2_decontamination, op3_token_counts, op4_license_scan, op5_packing,
        op6_near_duplicates, op7_token_store, op8_html_text, op9_secret_scan, op10_quality_rules,
        op11_periodic_runs, op12_merkle_manifest, op13_top_k_search,
    )
}
#: Shingle sets and their components, trees of digests and inner products can be said in SQL.
ORACLES: dict[str, str] = {
    "op6_near_duplicates": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE e AS (
    SELECT doc_id, lang, concat(coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source)::VARCHAR || ':' || source, '-'), coalesce(strlen(lang)::VARCHAR || ':' || lang, '-')) AS head,
        n_chars, coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail FROM documents
), l AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
        sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') || tail) AS changed FROM e
), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t(lang, level, nodes) AS (
    SELECT lang, 0, list(leaf ORDER BY pos) FROM p GROUP BY lang
    UNION ALL
    SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM t WHERE len(nodes) > 1
), s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
u(level, nodes) AS (
    SELECT 0, list(subroot ORDER BY place) FROM s
    UNION ALL
    SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM u WHERE len(nodes) > 1
), levels AS (
    SELECT lang, list(nodes ORDER BY level) AS trees FROM t WHERE len(nodes) > 1 GROUP BY lang
), tops AS (SELECT list(nodes ORDER BY level) FILTER (len(nodes) > 1) AS upper, max(nodes[1]) FILTER (len(nodes) = 1) AS root FROM u),
bits(doc_id, word, done, h) AS (
    SELECT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents
    UNION ALL
    SELECT doc_id, word, done + 1, list_reduce(list_prepend(xor(h, ascii(word[done + 1])::BIGINT), range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM bits WHERE done < len(word)
), crc AS (SELECT doc_id, xor(h, 4294967295) AS h FROM bits WHERE done = len(word)),
x AS (
    SELECT p.doc_id, p.leaf, s.subroot, tops.root, CASE WHEN crc.h % 7 = 0 THEN p.changed ELSE p.leaf END AS shown,
        list_concat(
            list_transform(coalesce(levels.trees, []), lambda n, i: {'odd': (p.pos // (1 << (i - 1))) % 2 = 1, 'sib': coalesce(CASE WHEN (p.pos // (1 << (i - 1))) % 2 = 1 THEN n[p.pos // (1 << (i - 1))] ELSE n[p.pos // (1 << (i - 1)) + 2] END, '')}),
            list_transform(coalesce(tops.upper, []), lambda n, i: {'odd': (s.place // (1 << (i - 1))) % 2 = 1, 'sib': coalesce(CASE WHEN (s.place // (1 << (i - 1))) % 2 = 1 THEN n[s.place // (1 << (i - 1))] ELSE n[s.place // (1 << (i - 1)) + 2] END, '')})
        ) AS proof
    FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN levels ON levels.lang IS NOT DISTINCT FROM p.lang CROSS JOIN tops JOIN crc ON crc.doc_id = p.doc_id
),
f AS (SELECT *, list_reduce(list_prepend({'odd': false, 'sib': shown}, proof), lambda a, b: {'odd': false, 'sib': sha256(CASE WHEN b.odd THEN b.sib || a.sib ELSE a.sib || b.sib END)}).sib AS folded_root FROM x)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(proof, lambda y: y.sib)), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
""",
    "op13_top_k_search": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
}
