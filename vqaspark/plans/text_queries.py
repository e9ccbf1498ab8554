"""Queries over texts: conversations, prompts, parsing of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.ingest import rooted
from .registry import query, table

SYSTEM = T.TEMPLATES["default"][0]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, system, turns): turns in order as (role, text), system turns apart."""
    c = table(spark, sf_dir, "conversations")
    said = F.col("role") != "system"
    turns = F.array_sort(F.collect_list(F.when(said, F.struct("turn", F.when(said, T.role(F.when(said, F.col("role")).otherwise("user"))).alias("role"), "text"))))
    return c.groupBy("conv_id").agg(F.coalesce(F.min_by(F.when(~said, F.col("text")), F.when(~said, F.col("turn"))), F.lit(SYSTEM)).alias("system"), turns.alias("turns"))


TURNS = f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN role IN ('user', 'human') THEN 0 ELSE 1 END AS role, text FROM conversations WHERE role <> 'system'),
s AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), '{SYSTEM.replace(chr(39), chr(39) * 2)}') AS system FROM conversations GROUP BY conv_id)
"""


@query(
    TURNS
    + """, r AS (SELECT conv_id, string_agg(CASE WHEN coalesce(text, '') <> '' THEN ' ' || CASE role WHEN 0 THEN 'Human' ELSE 'Assistant' END || ': ' || text || chr(10) || '###'
  ELSE ' ' || CASE role WHEN 0 THEN 'Human' ELSE 'Assistant' END || ':' END, '' ORDER BY turn) AS body FROM t GROUP BY conv_id)
SELECT s.conv_id, s.system || chr(10) || chr(10) || '###' || coalesce(body, '') AS prompt FROM s LEFT JOIN r USING (conv_id)"""
)
def conv_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", T.render_single(F.col("system"), F.col("turns")).alias("prompt"))


@query(
    TURNS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t),
r AS (SELECT conv_id, string_agg(' ' || CASE role WHEN 0 THEN 'USER' ELSE 'ASSISTANT' END || CASE WHEN coalesce(text, '') <> '' THEN ': ' || text || CASE WHEN i % 2 = 0 THEN ' ' ELSE '</s>' END ELSE ':' END, '' ORDER BY turn) AS body FROM n GROUP BY conv_id)
SELECT s.conv_id, s.system || ' ' || coalesce(body, '') AS prompt FROM s LEFT JOIN r USING (conv_id)"""
)
def conv_two_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", T.render_two(F.col("system"), F.col("turns")).alias("prompt"))


def _rendered(name: str) -> str:
    """SQL of one template's texts, as MD5."""
    system, human, assistant, style, sep, sep2 = T.TEMPLATES[name]
    quoted = "'" + system.replace("'", "''") + "'"
    who = f"' ' || CASE role WHEN 0 THEN '{human}' ELSE '{assistant}' END"
    end = f"chr(10) || '{sep}'" if style == "single" else f"CASE WHEN i % 2 = 0 THEN '{sep}' ELSE '{sep2}' END"
    lead = f"{quoted} || chr(10) || chr(10) || '{sep}'" if style == "single" else f"{quoted} || '{sep}'"
    body = f"string_agg({who} || CASE WHEN coalesce(text, '') <> '' THEN ': ' || text || {end} ELSE ':' END, '' ORDER BY turn)"
    return f"SELECT s.conv_id, '{name}' AS template, md5({lead} || coalesce(body, '')) AS digest FROM s LEFT JOIN (SELECT conv_id, {body} AS body FROM n GROUP BY conv_id) USING (conv_id)"


@query(TURNS + ", n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t) " + " UNION ALL ".join(map(_rendered, T.TEMPLATES)))
def conv_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation by every template."""
    every = F.array(*[F.struct(F.lit(n).alias("template"), F.md5(T.render(n, F.col("turns")).cast("binary")).alias("digest")) for n in T.TEMPLATES])
    return conversations(spark, sf_dir).select("conv_id", F.explode(every).alias("x")).select("conv_id", "x.*")


@query(TURNS + "SELECT conv_id, turn, text || chr(10) || '###' AS target FROM t WHERE role = 1 AND text IS NOT NULL")
def conv_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).select("conv_id", F.filter("turns", lambda t: t["role"] == 1).alias("a"), T.targets(F.col("turns")).alias("targets"))
    return c.select("conv_id", F.explode(F.arrays_zip(F.transform("a", lambda t: t["turn"]).alias("turn"), "targets")).alias("z")).select("conv_id", F.col("z")["turn"].alias("turn"), F.col("z.targets").alias("target"))


@query(
    TURNS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t)
SELECT a.conv_id, CAST(a.i // 2 AS BIGINT) AS pair, replace(a.text, chr(10), '') AS question, b.text AS answer FROM n a JOIN n b ON b.conv_id = a.conv_id AND b.i = a.i + 1 WHERE a.i % 2 = 0"""
)
def conv_single_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).select("conv_id", F.posexplode("turns").alias("i", "t"))
    pairs = c.groupBy("conv_id", F.floor(F.col("i") / 2).alias("pair")).agg(F.max(F.when(F.col("i") % 2 == 0, F.struct("t.text"))).alias("q"), F.max(F.when(F.col("i") % 2 == 1, F.struct("t.text"))).alias("a"))
    return pairs.where("a IS NOT NULL").select("conv_id", "pair", F.replace(F.col("q.text"), F.lit("\n"), F.lit("")).alias("question"), F.col("a.text").alias("answer"))


@query(
    TURNS + "SELECT s.conv_id, CAST(count(t.turn) AS BIGINT) AS turns, CAST(coalesce(sum(length(t.text)), 0) AS BIGINT) AS chars, CAST(count(t.turn) FILTER (WHERE role = 1) AS BIGINT) AS answers FROM s LEFT JOIN t USING (conv_id) GROUP BY s.conv_id"
)
def role_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    return c.select(
        "conv_id",
        F.size("turns").cast("long").alias("turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.coalesce(F.length(t["text"]), F.lit(0))).alias("chars"),
        F.size(F.filter("turns", lambda t: t["role"] == 1)).cast("long").alias("answers"),
    )


@query(
    r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR regexp_replace(body, '^\s+|\s+$', '', 'g') = '' THEN
 'Below is an instruction that describes a task. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || head || chr(10) || chr(10) || '### Response:'
 ELSE 'Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || head || chr(10) || chr(10) || '### Input:' || chr(10) || body || chr(10) || chr(10) || '### Response:' END AS prompt
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS head, split_part(text, chr(10), 2) AS body FROM documents)"""
)
def prompt_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("head"), F.split_part("text", F.lit("\n"), F.lit(2)).alias("body"))
    return d.select("doc_id", T.prompt("alpaca", F.col("head"), F.when(F.col("doc_id") % 3 != 0, F.col("body"))).alias("prompt"))


@query(
    """SELECT doc_id, 'Below is an instruction that describes a task. Write a response that appropriately completes the request using a single word or phrase.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || split_part(text, chr(10), 1) || chr(10) || chr(10) || '### Response:' AS short,
 'Generate a question whose answer is:' || chr(10) || split_part(text, chr(10), 1) || chr(10) || chr(10) || 'Question:' || chr(10) AS asked FROM documents"""
)
def prompt_short_and_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", T.prompt("shortqa", head).alias("short"), T.prompt("qg", head).alias("asked"))


@query("SELECT doc_id, '' AS prompt, text AS output FROM documents")
def prompt_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.prompt("caption", F.col("text")).alias("prompt"), F.col("text").alias("output"))


@query(r"SELECT conv_id, turn, regexp_replace(replace('<image>' || chr(10) || text, '<image>', ''), '^\s+|\s+$', '', 'g') AS text FROM conversations")
def image_tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.drop_image_tag(F.concat(F.lit("<image>\n"), "text")).alias("text"))


@query(r"SELECT page_id, translate(url, '/\.?!', '-----') AS name FROM pages")
def config_id_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.sanitise(F.col("url")).alias("name"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with four box corners in thousandths of 0..1 and a part name."""
    x = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    return x.select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 9).alias("part"),
        (q * 7 % 500).alias("x1"), (F.col("l_partkey") * 13 % 500).alias("y1"), (q * 7 % 500 + F.col("l_suppkey") % 499).alias("x2"), (F.col("l_partkey") * 13 % 500 + q * 3).alias("y2"),
    )


LINES = """WITH lines AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS part, q * 7 % 500 AS x1, l_partkey * 13 % 500 AS y1, q * 7 % 500 + l_suppkey % 499 AS x2, l_partkey * 13 % 500 + q * 3 AS y2
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem))"""


def milli(c: str) -> Column:
    return F.concat(F.floor(F.col(c) / 1000).cast("long").cast("string"), F.lit("."), F.lpad((F.col(c) % 1000).cast("string"), 3, "0"))


def _milli(c: str) -> str:
    return f"(CAST({c} // 1000 AS VARCHAR) || '.' || lpad(CAST({c} % 1000 AS VARCHAR), 3, '0'))"


@query(LINES + " SELECT l_orderkey, l_linenumber, 'part' || part AS name, x1 / 1000 AS v0, y1 / 1000 AS v1, x2 / 1000 AS v2, y2 / 1000 AS v3, CASE WHEN part = 0 THEN NULL ELSE CAST(part AS DOUBLE) END AS v4 FROM lines")
def box_tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir)
    said = F.concat(F.lit("see <rb>part"), "part", F.lit("</rb>["), F.concat_ws(",", *map(milli, ("x1", "y1", "x2", "y2"))), F.lit(","), F.when(F.col("part") == 0, "-10000").otherwise(F.col("part").cast("string")), F.lit("] end"))
    found = d.select("l_orderkey", "l_linenumber", F.explode(T.tagged_boxes(said)).alias("b"))
    return found.select("l_orderkey", "l_linenumber", F.col("b.name").alias("name"), *(F.get("b.values", F.lit(k)).alias(f"v{k}") for k in range(5)))


@query(LINES + " SELECT l_orderkey, l_linenumber, CAST(p AS INTEGER) AS p, (CASE p WHEN 0 THEN x1 ELSE x2 END) / 100 AS a, (CASE p WHEN 0 THEN y1 ELSE y2 END) / 100 AS b FROM lines, range(2) r(p)")
def box8_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir)
    said = F.concat(F.lit("<box>lid</box>[["), "x1", F.lit(","), "y1", F.lit("],["), "x2", F.lit(","), "y2", F.lit("]]"))
    found = d.select("l_orderkey", "l_linenumber", F.posexplode(T.corner_boxes(said)[0]).alias("p", "v"))
    return found.select("l_orderkey", "l_linenumber", "p", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


@query(
    LINES
    + """, v AS (SELECT l_orderkey, l_linenumber, k, CAST(CASE k WHEN 0 THEN x1 WHEN 1 THEN y1 WHEN 2 THEN x2 ELSE y2 END AS BIGINT) AS n FROM lines, range(4) r(k)),
d AS (SELECT *, CASE WHEN n >= 1000 THEN n / 1000 ELSE CAST(n AS DOUBLE) END AS x FROM v)
SELECT l_orderkey, l_linenumber, CAST(k AS INTEGER) AS k, CASE WHEN x > 100 THEN x / 1000 WHEN x > 10 THEN x / 100 WHEN x >= 1 THEN x / 10 ELSE x END AS v FROM d"""
)
def answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir)
    return d.select("l_orderkey", "l_linenumber", F.posexplode(T.normalise_answer(F.concat(F.lit("box ["), F.concat_ws(", ", "x1", "y1", "x2", "y2"), F.lit("]")))).alias("k", "v"))


@query(LINES + " SELECT l_orderkey, l_linenumber, CASE WHEN part % 2 = 0 THEN 'p' || part ELSE 'it is part p' || part END AS answer FROM lines")
def answer_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir)
    said = F.concat(F.when(F.col("part") % 2 == 0, "The answer is p").otherwise(" it is part p"), "part", F.lit(".\n### more. "), "x1")
    return d.select("l_orderkey", "l_linenumber", T.trim_answer(said).alias("answer"))


@query(LINES + " SELECT part, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN x1 <= x2 AND y1 <= y2 AND part <> 4 THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(sum(CASE WHEN x1 <= x2 AND y1 <= y2 AND part <> 4 THEN 0 ELSE 1 END) AS BIGINT) AS fail FROM lines GROUP BY part")
def pred_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir)
    box = F.when(F.col("part") == 4, F.array("x1", "y1", "x2")).otherwise(F.array("x1", "y1", "x2", "y2"))
    return d.groupBy("part").agg(F.count("*").alias("n"), F.count_if(T.valid_box(box)).alias("valid"), F.count_if(~T.valid_box(box)).alias("fail"))


@query(LINES + " SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(part % 3 AS INTEGER) AS kind FROM lines) GROUP BY kind")
def answer_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("part") % 3 == 0, "a lid").when(F.col("part") % 3 == 1, F.concat(F.lit("["), "x1", F.lit("]"))).otherwise(F.concat(F.lit("<rb>lid</rb>["), "x1", F.lit("]")))
    return lines(spark, sf_dir).groupBy(T.answer_kind(said).alias("kind")).agg(F.count("*").alias("n"))


@query(LINES + f" SELECT l_orderkey, l_linenumber, 'from [' || {_milli('x1')} || ',' || {_milli('y1')} || '] to [' || {_milli('x2')} || ',' || {_milli('y2')} || '] done' AS text FROM lines")
def placeholder_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir)
    boxes = F.array(T.format_boxes(F.array(F.array("x1", "y1"))), T.format_boxes(F.array(F.array("x2", "y2"))))
    return d.select("l_orderkey", "l_linenumber", T.fill_placeholders(F.lit("from <boxes> to <boxes> done"), boxes).alias("text"))


@query(LINES + " SELECT l_orderkey, l_linenumber, CAST(p AS INTEGER) AS p, (CASE p WHEN 0 THEN x1 ELSE x2 END) / 1000 AS a, (CASE p WHEN 0 THEN y1 ELSE y2 END) / 1000 AS b FROM lines, range(2) r(p)")
def box_format_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir)
    found = d.select("l_orderkey", "l_linenumber", F.posexplode(T.extract_boxes(T.format_boxes(F.array(F.array("x1", "y1"), F.array("x2", "y2"))))).alias("p", "v"))
    return found.select("l_orderkey", "l_linenumber", "p", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


@query(LINES + " SELECT l_orderkey, l_linenumber, CAST(p AS INTEGER) AS p, CAST(CASE p WHEN 0 THEN x1 ELSE x2 END AS DOUBLE) AS a, CAST(CASE p WHEN 0 THEN y1 ELSE y2 END AS DOUBLE) AS b FROM lines, range(2) r(p)")
def number_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir)
    said = F.concat(F.lit("a ["), "x1", F.lit(","), "y1", F.lit("] b ["), "x2", F.lit(","), "y2", F.lit("] c"))
    return d.select("l_orderkey", "l_linenumber", F.posexplode(T.number_lists(said, 2)).alias("p", "v")).select("l_orderkey", "l_linenumber", "p", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


@query(LINES + " SELECT l_orderkey, l_linenumber, CAST(x1 + y1 + x2 + y2 + 2 AS BIGINT) AS total FROM lines")
def fixed_arity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("axis ["), F.concat_ws(",", "x1", "y1", "x2", "y2", F.lit(-1), F.lit(3)), F.lit("] box [1,2]"))
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.aggregate(T.fixed_numbers(said, 6)[0], F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS verb, CAST(length(split_part(p_type, ' ', 1)) AS INTEGER) AS n FROM part")
def action_verb(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.verb(F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("[<link>"), "p_name", F.lit("</link>]")))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("verb"), F.length(v).alias("n"))


@query("SELECT doc_id, CASE WHEN contains(text, '. ') THEN split_part(text, '. ', 1) END AS instruction, CASE WHEN contains(text, '. ') THEN substr(text, strpos(text, '. ') + 2) END AS output FROM documents WHERE contains(text, '. ')")
def marker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = T.after_marker(F.col("text"), ". ")
    return table(spark, sf_dir, "documents").select("doc_id", before.alias("instruction"), after.alias("output")).where("output IS NOT NULL")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '  <limit effort="30" velocity="1.0" lower="0" upper="' || l_linenumber || '"/>' ELSE '<joint name="j' || l_linenumber || '"/>' END AS line FROM lineitem""")
def limit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    line = F.when(n % 2 == 0, F.concat(F.lit('  <limit lower="None" upper="'), n, F.lit('"/>'))).otherwise(F.concat(F.lit('<joint name="j'), n, F.lit('"/>')))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.repair_limits(line).alias("line"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def fence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = T.strip_fence(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(inside, "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS first FROM part")
def list_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("p_partkey") % 5 == 0, F.lit("no list")).otherwise(F.concat(F.lit("['"), "p_brand", F.lit("', 'x']")))
    got = T.literal_list(said)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(got).alias("n"), F.get(got, F.lit(0)).alias("first"))


@query("SELECT p_partkey, 'Write a task for a ' || p_name || ' of type ' || p_type || '.' AS prompt FROM part")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = T.fill_template("Write a task for a {OBJECT_CLASS} of type {OBJECT_TYPE}.", {"OBJECT_CLASS": F.col("p_name"), "OBJECT_TYPE": F.col("p_type")})
    return table(spark, sf_dir, "part").select("p_partkey", filled.alias("prompt"))


@query("SELECT l_orderkey, l_linenumber, CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS price, lpad(CAST(l_linenumber AS VARCHAR), 6, '0') AS frame FROM (SELECT *, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS c FROM lineitem)")
def centi_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.format_centi(T.centi(F.col("l_discount"))).alias("price"), F.lpad(F.col("l_linenumber").cast("string"), 6, "0").alias("frame"))


@query("SELECT page_id, replace(url, 'example', 'npy_8192') AS path, regexp_extract(url, '([0-9]+)', 1) AS number, 'root/' || url AS rooted FROM pages")
def path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooted_url = F.concat(F.lit("root/"), "url")  # a url is absolute, which rooted() leaves alone
    return table(spark, sf_dir, "pages").select("page_id", T.rewritten(F.col("url"), {"example": "npy_8192"}).alias("path"), F.regexp_extract("url", "([0-9]+)", 1).alias("number"), rooted_url.alias("rooted"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/abs/' || p_name WHEN 1 THEN 's3://b/' || p_name ELSE 'data/' || p_name END AS path FROM part")
def rooted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths below their root; absolute ones and those of a store stay."""
    lead = F.get(F.array(F.lit("/abs/"), F.lit("s3://b/"), F.lit("")), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", rooted(F.concat(lead, "p_name"), "data/").alias("path"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 2 END AS INTEGER) AS n, CASE WHEN p_partkey % 4 <> 3 THEN 'it''s ' || p_name END AS first FROM part")
def list_literal_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists whose values hold quotes, in either kind of quotes."""
    kinds = [F.concat(F.lit('["it\'s '), "p_name", F.lit("\", 'x']")), F.concat(F.lit("['it\\'s "), "p_name", F.lit("', \"x\", ]")), F.concat(F.lit("  [ \"it's "), "p_name", F.lit("\" , 'a\"b']\n")), F.concat(F.lit("['it's "), "p_name", F.lit("']"))]
    got = T.literal_list(F.get(F.array(*kinds), (F.col("p_partkey") % 4).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(got).alias("n"), F.get(got, F.lit(0)).alias("first"))
