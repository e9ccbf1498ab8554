"""Queries of the aggregations and moving windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.trees import depths
from ..operators.windows import rolling
from .registry import query, table, thousandths


@query("SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS ids FROM customer GROUP BY c_nationkey")
def class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("c_custkey")), ",").alias("ids"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first FROM events GROUP BY event_type")
def group_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT CAST(count(DISTINCT l_orderkey) AS BIGINT) AS images, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS objects FROM lineitem")
def distinct_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey").alias("images"), F.countDistinct("l_suppkey").alias("objects"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()


@query("SELECT l_orderkey, string_agg(DISTINCT p_brand, '_' ORDER BY p_brand) AS key FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def key_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, sf_dir, "lineitem").join(p, "l_partkey").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), "_").alias("key"))


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5")
def having_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 5")


POINTS = "WITH p AS (SELECT label, vec_id, i, CAST(round(embedding[3 * i + 1] * 1000) AS BIGINT) AS x, CAST(round(embedding[3 * i + 2] * 1000) AS BIGINT) AS y, CAST(round(embedding[3 * i + 3] * 1000) AS BIGINT) AS z FROM (SELECT *, unnest(range(0, 21)) AS i FROM embeddings))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, vec_id, i, x, y, z): vectors cut into points in thousandths; a label is a cloud."""
    e = table(spark, sf_dir, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20))))
    return e.select("label", "vec_id", "i", *(thousandths(F.get("embedding", 3 * F.col("i") + k)).alias(c) for k, c in enumerate("xyz")))


@query(POINTS + " SELECT label, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM p GROUP BY label")
def aabb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return p.groupBy("label").agg(*(((F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in "xyz"), *((F.max(c) - F.min(c)).alias(f"e{c}") for c in "xyz"))


@query("SELECT l_orderkey, min(l_discount) FILTER (WHERE l_discount <> 0) AS low, max(l_discount) FILTER (WHERE l_discount <> 0) AS high FROM lineitem GROUP BY l_orderkey")
def minmax_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(d).alias("low"), F.max(d).alias("high"))


@query("SELECT l_partkey % 50 AS part, CAST(floor(sum(CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END) / (count(*) + 1e-6) * 10000 + 0.5) AS BIGINT) AS ratio FROM lineitem GROUP BY 1")
def vis_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.sum(F.when(F.col("l_quantity") > 20, 1).otherwise(0)) / (F.count("*") + 1e-6)
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("part")).agg(F.floor(share * 10000 + 0.5).cast("long").alias("ratio"))


@query("SELECT l_orderkey, min(q) AS x, min(e) AS y, max(q) - min(q) AS w, max(e) - min(e) AS h, (max(q) - min(q)) * (max(e) - min(e)) AS area FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, l_partkey % 100 AS e FROM lineitem) GROUP BY l_orderkey")
def mask_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"), (F.col("l_partkey") % 100).alias("e"))
    w, h = F.max("q") - F.min("q"), F.max("e") - F.min("e")
    return x.groupBy("l_orderkey").agg(F.min("q").alias("x"), F.min("e").alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"))


@query("SELECT l_orderkey, first(l_linenumber ORDER BY l_quantity DESC, l_linenumber) AS line FROM lineitem GROUP BY l_orderkey")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("line"))


@query(POINTS + ", c AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY label) SELECT label, CAST(floor(max(sqrt((p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z))) + 0.5) AS BIGINT) AS radius FROM p JOIN c USING (label) GROUP BY label")
def centroid_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    c = p.groupBy("label").agg(*(F.avg(k).alias(f"c{k}") for k in "xyz"))
    d = sum(((F.col(k) - F.col(f"c{k}")) * (F.col(k) - F.col(f"c{k}")) for k in "yz"), (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")))
    return p.join(c, "label").groupBy("label").agg(F.floor(F.max(F.sqrt(d)) + 0.5).cast("long").alias("radius"))


EVENTS = "WITH e AS (SELECT event_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("v"))


@query(EVENTS + " SELECT event_type, CAST(count(v) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(floor(sum(v) / count(v) + 0.5) AS BIGINT) AS mean FROM e GROUP BY event_type")
def metric_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).groupBy("event_type").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.floor(F.sum("v") / F.count("v") + 0.5).cast("long").alias("mean"))


@query(EVENTS + ", w AS (SELECT event_id, v, list(v) OVER w AS l, max(v) OVER w AS high, CAST(sum(v) OVER w AS BIGINT) AS total FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT event_id, list_sort(l)[(len(l) - 1) // 2 + 1] AS median, high, total, v AS last FROM w")
def metric_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {"l": lambda w: F.array_sort(F.collect_list("v").over(w)), "high": lambda w: F.max("v").over(w), "total": lambda w: F.sum("v").over(w)}
    x = rolling(metrics(spark, sf_dir), ["event_type"], ["ts", "event_id"], 20, of)
    return x.select("event_id", F.get("l", F.floor((F.size("l") - 1) / 2).cast("int")).alias("median"), "high", "total", F.col("v").alias("last"))


@query(EVENTS + ", r AS (SELECT event_type, event_id % 4 AS rank, sum(v) AS s, count(*) AS n FROM e GROUP BY 1, 2) SELECT event_type, CAST(floor(sum(s * 1.0 / n) / count(*) + 0.5) AS BIGINT) AS mean FROM (SELECT event_type, rank, s, n FROM r) GROUP BY event_type")
def allreduce_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics(spark, sf_dir).groupBy("event_type", (F.col("event_id") % 4).alias("rank")).agg((F.sum("v") / F.count("*")).alias("m"))
    return r.groupBy("event_type").agg(F.floor(F.avg("m") + 0.5).cast("long").alias("mean"))


@query(EVENTS + " SELECT event_type, CAST(-sum(v) AS BIGINT) AS loglik, CAST(floor(avg(v) + 0.5) AS BIGINT) AS mean_nll, bool_and(v >= 100) AS max_equal FROM e GROUP BY event_type")
def loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).groupBy("event_type").agg((-F.sum("v")).alias("loglik"), F.floor(F.avg("v") + 0.5).cast("long").alias("mean_nll"), F.every(F.col("v") >= 100).alias("max_equal"))


@query("SELECT l_orderkey, max(l_linenumber) FILTER (WHERE l_tax <> 0) AS last FROM lineitem GROUP BY l_orderkey")
def last_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_tax") != 0, F.col("l_linenumber"))).alias("last"))


@query("SELECT l_orderkey, CAST(sum(CASE WHEN coalesce(l_quantity > 19 AND l_discount > 0.02, FALSE) THEN 1 ELSE 0 END) AS BIGINT) AS visible, CAST(sum(CASE WHEN l_discount < 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS closed FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey")
def visible_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").where("l_returnflag != 'R'")
    seen = F.coalesce((F.col("l_quantity") > 19) & (F.col("l_discount") > 0.02), F.lit(False))
    return x.groupBy("l_orderkey").agg(F.count_if(seen).alias("visible"), F.count_if(F.col("l_discount") < 0.02).alias("closed"))


@query("""WITH c AS (SELECT event_id, user_id, 'epoch' || (event_id % 7) || CASE WHEN event_id % 3 = 0 THEN '' ELSE '-iter' || (event_id % 900) END AS name FROM events)
SELECT user_id, first(name ORDER BY CAST(regexp_extract(name, 'epoch([0-9]+)', 1) AS INTEGER) DESC, CASE WHEN contains(name, 'iter') THEN CAST(regexp_extract(name, 'iter([0-9]+)', 1) AS INTEGER) ELSE 2147483647 END DESC) AS latest FROM c GROUP BY user_id""")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    c = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("epoch"), n % 7, F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("-iter"), n % 900))).alias("name"))
    epoch = F.regexp_extract("name", "epoch([0-9]+)", 1).cast("int")
    step = F.coalesce(F.nullif(F.regexp_extract("name", "iter([0-9]+)", 1), F.lit("")).cast("int"), F.lit(2147483647))
    return c.groupBy("user_id").agg(F.max_by("name", F.struct(epoch, step)).alias("latest"))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity * l_tax AS area, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN n > 10 THEN -area ELSE 0 END, l_orderkey, l_linenumber) AS place FROM r) SELECT l_suppkey, l_orderkey, l_linenumber, CAST(place AS INTEGER) AS place FROM k WHERE place <= 10""")
def topk_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_tax")).alias("area"))
    n = x.withColumn("n", F.count("*").over(Window.partitionBy("l_suppkey")))
    order = Window.partitionBy("l_suppkey").orderBy(F.when(F.col("n") > 10, -F.col("area")).otherwise(F.lit(0.0)), "l_orderkey", "l_linenumber")
    return n.withColumn("place", F.row_number().over(order)).where("place <= 10").select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def numeric_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.col("o_orderkey").cast("string").cast("long"))


@query(POINTS + ", d AS (SELECT label, i, max(x) - min(x) AS d FROM p GROUP BY label, i) SELECT label, max(d) AS divergence FROM d GROUP BY label")
def replica_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("label", "i").agg((F.max("x") - F.min("x")).alias("d")).groupBy("label").agg(F.max("d").alias("divergence"))


@query(POINTS + ", d AS (SELECT label, vec_id, sum(x * x) AS s FROM p GROUP BY 1, 2) SELECT label, CAST(floor(sqrt(sum(s)) + 0.5) AS BIGINT) AS norm FROM d GROUP BY label")
def norm_of_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = points(spark, sf_dir).groupBy("label", "vec_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return inner.groupBy("label").agg(F.floor(F.sqrt(F.sum(F.pow("n", F.lit(2)))) + 0.5).cast("long").alias("norm"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey, l_linenumber AS id, l_linenumber // 2 AS parent, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS step FROM lineitem),
t AS (SELECT l_orderkey, id, step AS depth FROM n WHERE parent = 0 UNION ALL SELECT n.l_orderkey, n.id, t.depth + n.step FROM n JOIN t ON n.l_orderkey = t.l_orderkey AND n.parent = t.id)
SELECT l_orderkey, CAST(max(depth) AS INTEGER) AS depth FROM t GROUP BY l_orderkey""")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actuated edges on the longest path from the root, which is number 0; what does not hang on it is left out."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("id")).distinct()
    step = F.when(F.col("id") % 3 == 0, 0).otherwise(1)
    found = depths(n.withColumn("parent", F.floor(F.col("id") / 2)), ["l_orderkey"], "id", "parent", step)
    return found.where("above = 0").groupBy("l_orderkey").agg(F.max("depth").cast("int").alias("depth"))


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, c_custkey - 1 - CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 4) AS INTEGER) % 60 AS parent FROM customer),
m AS (SELECT n.id, p.id AS parent FROM n LEFT JOIN n p ON p.id = n.parent), t AS (SELECT id, id AS root, 1 AS depth FROM m WHERE parent IS NULL UNION ALL SELECT m.id, t.root, t.depth + 1 FROM m JOIN t ON m.parent = t.id)
SELECT id, CAST(depth AS BIGINT) AS depth FROM t""")
def tree_depth_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest whose parents are drawn by a hash, of a depth that no id tells."""
    up = F.col("id") - 1 - F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % 60
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return depths(n.withColumn("parent", up), [], "id", "parent", F.lit(1)).drop("above")
