"""Queries of the training loader: samples, batches, shards, packing, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.batches import padded
from ..operators.packing import cut_stream, packed_rows
from ..operators.ranking import by_number, even_shard, exact_sample, numbered, ranked, shuffled
from ..operators.windows import carried
from .registry import query, table, thousandths

LENGTH, BOS, EOS = 2048, 1, 2


def tokens(text: Column) -> Column:
    """Words as numbers from 3 on, by their MD5."""
    return F.transform(F.filter(F.split(text, r"[ \n\t\r]+"), lambda w: w != ""), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") + 3)


TOKENS = r"""WITH d AS (SELECT doc_id, lang, list_transform(list_filter(string_split_regex(coalesce(text, ''), '[ \n\t\r]+'), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) + 3) AS t FROM documents)"""


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", tokens(F.coalesce("text", F.lit(""))).alias("t"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], by_number("doc_id"), ["doc_id"])


POS = "WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT 'documents' AS source, length(text) AS chars FROM documents UNION ALL SELECT 'conversations', length(text) FROM conversations UNION ALL SELECT 'pages', length(url) FROM pages) GROUP BY source")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, c: table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.length(c).alias("chars"))
    every = one("documents", "text").unionByName(one("conversations", "text")).unionByName(one("pages", "url"))
    return every.groupBy("source").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("SELECT lang, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY lang) AS BIGINT) AS stop FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def group_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each group
    return n.select("lang", "n", before.alias("start"), (before + F.col("n")).alias("stop"))


@query("SELECT doc_id, lang, n_chars, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS BIGINT) AS pos FROM documents")
def length_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return numbered(d, ["lang"], ["n_chars", "doc_id"]).drop("pos_total")


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(row_number() OVER (ORDER BY sum(length(text)), conv_id) - 1 AS BIGINT) AS pos FROM conversations GROUP BY conv_id")
def dialog_length_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    return numbered(c, [], ["chars", "conv_id"]).drop("pos_total")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= floor(n * 0.2)")
def exact_k_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 0.2)


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def shuffle_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(shuffled(F.col("doc_id"), 7), "doc_id").limit(50)


@query(POS + " SELECT doc_id, lang, CAST(pos // 16 AS BIGINT) AS batch FROM p WHERE pos < n // 16 * 16")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).where(F.col("pos") < F.floor(F.col("pos_total") / 16) * 16).select("doc_id", "lang", F.floor(F.col("pos") / 16).alias("batch"))


@query(POS + ", b AS (SELECT DISTINCT lang, CAST(pos // 16 AS BIGINT) AS batch FROM p WHERE pos < n // 16 * 16) SELECT lang, batch, CAST(row_number() OVER (ORDER BY md5('3:' || lang || ':' || batch)) - 1 AS BIGINT) AS place FROM b")
def batch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch_plan(spark, sf_dir).select("lang", "batch").distinct().withColumn("_o", shuffled(F.concat_ws(":", "lang", "batch"), 3))
    return ranked(b, [], F.substring("_o", 1, 3), ["_o"], "place").drop("_o", "place_total")


@query(POS + " SELECT doc_id, lang, CAST(pos // 2 % 4 AS BIGINT) AS replica, CAST(pos // 8 * 2 + pos % 2 AS BIGINT) AS local FROM p WHERE pos >= 8")
def rank_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos")
    return positions(spark, sf_dir).where(pos >= 8).select("doc_id", "lang", (F.floor(pos / 2) % 4).alias("replica"), (F.floor(pos / 8) * 2 + pos % 2).alias("local"))


@query("SELECT doc_id, CAST(ntile(7) OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents")
def range_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("doc_id", even_shard(F.col("pos"), F.col("pos_total"), 7).alias("shard"))


@query(POS + " SELECT doc_id FROM p WHERE pos >= n * 1 // 3 AND pos < n * 2 // 3")
def frac_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("pos_total")
    return positions(spark, sf_dir).where((F.col("pos") >= F.floor(n / 3)) & (F.col("pos") < F.floor(n * 2 / 3))).select("doc_id")


@query(POS + " SELECT doc_id FROM p WHERE pos % 4 = 1 AND pos < n // 4 * 4")
def stride_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).where((F.col("pos") % 4 == 1) & (F.col("pos") < F.floor(F.col("pos_total") / 4) * 4)).select("doc_id")


@query("SELECT c_custkey, (SELECT list(p ORDER BY i) FROM (SELECT i, ['red', 'oak', 'worn'][i % 3 + 1] AS p FROM range(8) r(i)))[CAST(c_custkey % 8 AS INTEGER) + 1] AS texture FROM customer")
def prompt_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiled = A.tile(F.array(*map(F.lit, ("red", "oak", "worn"))), 8)
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(tiled, (F.col("c_custkey") % 8).cast("int")).alias("texture"))


@query("SELECT doc_id, ['box', 'name', 'both'][CAST('0x' || substr(md5('5:' || doc_id), 1, 4) AS INTEGER) % 3 + 1] AS choice FROM documents")
def hash_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.conv(F.substring(shuffled(F.col("doc_id"), 5), 1, 4), 16, 10).cast("int") % 3
    return table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*map(F.lit, ("box", "name", "both"))), n).alias("choice"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, pos, part): the stream of all documents' tokens with their end ids, each document cut at the chunks' bounds; begin ids go."""
    d = token_rows(spark, sf_dir).select("doc_id", F.concat(F.array(F.lit(BOS)), "t", F.array(F.lit(EOS))).alias("t"))
    return cut_stream(d, "doc_id", "t", LENGTH, BOS)


PACKED = TOKENS + ", s AS (SELECT doc_id, list_append(t, 2) AS t, sum(len(t) + 1) OVER (ORDER BY doc_id) - len(t) - 1 AS start FROM d), x AS (SELECT start + i - 1 AS pos, t[i] AS token FROM (SELECT start, t, unnest(range(1, len(t) + 1)) AS i FROM s))"


@query(PACKED + " SELECT CAST(pos // 2048 AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n, CAST(sum(token) AS BIGINT) AS total FROM x GROUP BY 1")
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packed(spark, sf_dir).select("chunk", F.size("part").alias("n"), F.aggregate("part", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    return parts.groupBy("chunk").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query(PACKED + ", c AS (SELECT CAST(pos // 2048 AS BIGINT) AS chunk, string_agg(CAST(token AS VARCHAR), ',' ORDER BY pos) AS t, 2048 - count(*) AS pad FROM x GROUP BY 1) SELECT chunk, md5(t || repeat(',0', CAST(pad AS INTEGER))) AS digest, CAST(2048 AS INTEGER) AS length FROM c")
def pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = token_rows(spark, sf_dir).select("doc_id", F.concat(F.array(F.lit(BOS)), "t", F.array(F.lit(EOS))).alias("t"))
    rows = packed_rows(d, "doc_id", "t", LENGTH, BOS)
    return rows.select("chunk", digest(F.col("tokens")).alias("digest"), F.size("tokens").alias("length"))


def digest(a: Column) -> Column:
    return F.md5(F.array_join(a, ",").cast("binary"))


def _digest(sql: str) -> str:
    return f"md5(array_to_string({sql}, ','))"


PADDED = "list_slice(list_concat(t, list_transform(range(64), lambda x: -1)), 1, 64)"


@query(TOKENS + f" SELECT doc_id, {_digest(f'list_transform({PADDED}, lambda x: greatest(x, 0))')} AS tokens, CAST(len(list_filter({PADDED}, lambda x: x >= 0)) AS INTEGER) AS n FROM d")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.pad(F.col("t"), 64)
    return token_rows(spark, sf_dir).select("doc_id", digest(A.loss_mask(p)[0]).alias("tokens"), F.size(F.filter(A.loss_mask(p)[1], lambda m: m == 1.0)).alias("n"))


@query(TOKENS + f" SELECT doc_id, {_digest('list_transform(t, lambda x, i: CASE WHEN i - 1 < 5 THEN -1 ELSE x END)')} AS labels FROM d")
def label_prefix_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark, sf_dir).select("doc_id", digest(A.mask_prefix(F.col("t"), F.lit(5))).alias("labels"))


@query(TOKENS + f" SELECT doc_id, {_digest('list_transform(t, lambda x, i: CASE WHEN i - 1 >= 3 AND i - 1 < 9 THEN x ELSE -100 END)')} AS labels FROM d WHERE len(t) > 3")
def label_span_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = token_rows(spark, sf_dir).withColumn("l", A.mask_outside(F.col("t"), F.lit(3), F.lit(9)))
    return d.where(A.any_label(F.transform("l", lambda x: F.greatest(x, F.lit(0))))).select("doc_id", digest(F.col("l")).alias("labels"))


@query(TOKENS + " SELECT doc_id, CAST(CASE WHEN len(t) >= 5 THEN list_position(list_transform(list_zip(t, t[2:]), lambda s: s[1] * 100000::BIGINT + s[2]), t[4] * 100000::BIGINT + t[5]) - 1 ELSE -1 END AS INTEGER) AS at FROM d")
def sublist_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = token_rows(spark, sf_dir)
    needle = F.when(F.size("t") >= 5, F.slice("t", 4, 2)).otherwise(F.array(F.lit(-5)))
    return d.select("doc_id", A.find_sublist(F.col("t"), needle).alias("at"))


@query(TOKENS + f" SELECT doc_id, {_digest('list_slice(t, -32, len(t))')} AS tail FROM d WHERE len(t) >= 32 UNION ALL SELECT doc_id, {_digest('t')} FROM d WHERE len(t) < 32")
def left_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark, sf_dir).select("doc_id", digest(A.keep_last(F.col("t"), 32)).alias("tail"))


@query(TOKENS + " SELECT lang, CAST(sum(m - len(t)) AS BIGINT) AS padding, CAST(count(*) AS BIGINT) AS n, CAST(max(m) AS INTEGER) AS width FROM (SELECT lang, t, max(len(t)) OVER (PARTITION BY lang) AS m FROM d) GROUP BY lang")
def ragged_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = token_rows(spark, sf_dir).select("lang", F.size("t").alias("n"))
    return d.groupBy("lang").agg((F.max("n").cast("long") * F.count("*") - F.sum("n")).alias("padding"), F.count("*").alias("n"), F.max("n").alias("width"))


@query(TOKENS + f" SELECT doc_id, CAST(m AS INTEGER) AS width, {_digest('list_concat(t, list_transform(range(m - len(t)), lambda x: 0))')} AS tokens FROM (SELECT doc_id, t, max(len(t)) OVER (PARTITION BY doc_id // 16) AS m FROM d)")
def ragged_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of sixteen documents, each filled up to its longest."""
    d = token_rows(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), "t")
    return padded(d, "batch", "t").select("doc_id", F.size("t").alias("width"), digest(F.col("t")).alias("tokens"))


@query(TOKENS + " SELECT doc_id, CAST(coalesce(least(list_position(t, CAST('0x' || substr(md5('the'), 1, 4) AS INTEGER) + 3), list_position(t, CAST('0x' || substr(md5('la'), 1, 4) AS INTEGER) + 3)) - 1, len(t)) AS INTEGER) AS n FROM (SELECT doc_id, t FROM d)")
def stop_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    stops = [[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) + 3] for w in ("the", "la")]
    return token_rows(spark, sf_dir).select("doc_id", F.size(A.first_stop(F.col("t"), stops)).alias("n"))


SCORES = "WITH e AS (SELECT vec_id, i - 1 AS i, CAST(round(embedding[i] * 1000) AS BIGINT) AS s FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, i, s): the elements of each vector in thousandths."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), thousandths(F.col("x")).alias("s"))


@query(SCORES + " SELECT vec_id, i, CAST(round(exp(s / 700.0) / sum(exp(s / 700.0)) OVER (PARTITION BY vec_id) * 1e6) AS BIGINT) AS p FROM e")
def softmax_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.exp(F.col("s") / 700.0)
    return scores(spark, sf_dir).select("vec_id", "i", F.round(x / F.sum(x).over(Window.partitionBy("vec_id")) * 1e6).cast("long").alias("p"))


@query(SCORES + ", w AS (SELECT vec_id, i, s + 10000 AS p, sum(s + 10000) OVER (PARTITION BY vec_id) AS total, coalesce(sum(s + 10000) OVER (PARTITION BY vec_id ORDER BY s DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e) SELECT vec_id, i, CAST(p AS BIGINT) AS p, CAST(sum(p) OVER (PARTITION BY vec_id) AS BIGINT) AS kept, CAST(floor(CAST(p AS DOUBLE) / CAST(sum(p) OVER (PARTITION BY vec_id) AS DOUBLE) * 1000000 + 0.5) AS BIGINT) AS share FROM w WHERE 10 * before <= 7 * total")
def topp_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scores(spark, sf_dir).withColumn("p", F.col("s") + 10000)
    whole, before = Window.partitionBy("vec_id"), Window.partitionBy("vec_id").orderBy(F.desc("s"), "i").rowsBetween(Window.unboundedPreceding, -1)
    kept = e.withColumn("total", F.sum("p").over(whole)).withColumn("before", F.coalesce(F.sum("p").over(before), F.lit(0))).where(10 * F.col("before") <= 7 * F.col("total"))
    return kept.select("vec_id", "i", "p", F.sum("p").over(whole).alias("kept")).withColumn("share", F.floor(F.col("p") / F.col("kept") * 1000000 + 0.5).cast("long"))


@query("SELECT event_id, coalesce(v, lag(v IGNORE NULLS) OVER w, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def previous_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return carried(e, ["event_type"], ["ts", "event_id"], "value", "v", ring=True).select("event_id", "v")
