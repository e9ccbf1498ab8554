"""The record builders: one record (image, conversations) for each question, one table for each task.

conversations is the JSON of the two turns, [{"from": "human", "value": ..}, {"from": "gpt", "value": ..}].

A part of an object in an image is a line item: the order is the image, the supplier the object, the nation its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import box_texts, corner_boxes, corner_numbers, format_centi, number_word
from ..operators.grounding import LEAST_ACTIONS, grounded_tasks
from ..sources import readers
from ..sources.scratch import scratch
from .registry import query, table

#: Questions by task (fixed values).
QUESTIONS = {
    "all_parts": "Detect all manipulable object parts and provide their 2D rotated bounding boxes.",
    "joint": "Please provide the joint's type and its 2D rotated bounding box linked to the object part {}.",
    "joint_depth": "Please provide the joint's type and its 2D rotated bounding box with depth linked to the object part {}.",
    "single_link": "Please provide the 2D rotated bounding box of the region this sentence describes: {}",
    "grounding": "Please execute the task described wih 2D rotated bounding box representations by the following instruction: {}",
    "all_parts_3d": "Detect all manipulable object parts and provide their 3D bounding boxes.",
    "joint_3d": "Please provide the joint's type and its 3D axis linked to the object part {}.",
    "single_link_3d": "Please provide the 3D bounding box of the region this sentence describes: {}",
    "grounding_3d": "Please execute the task described wih 3D rotated bounding box representations by the following instruction: {}",
}
#: Answers that list parts: of one, and of several (fixed values).
LISTED = {
    "all_parts": ("There is one manipulable object part with its rotated bounding box: ", "There are {} manipulable object parts with their rotated bounding boxes: "),
    "all_parts_3d": ("There is one manipulable object part with its 3d bounding box: ", "There are {} manipulable object parts with their 3d bounding boxes: "),
}
JOINTS, ACTIONS = ("revolute", "prismatic", "continuous"), ("rotate", "slide_out", "press", "wipe")
PARTS = """WITH parts AS (SELECT l_orderkey AS image, l_linenumber AS link, l_partkey AS id, l_suppkey AS object, n_name AS class, 'part' || l_partkey % 17 AS name, l_partkey * 7 % 97 AS cx, l_suppkey * 13 % 97 AS cy, CAST(l_quantity AS BIGINT) AS w, l_linenumber * 9 AS h,
 l_partkey * 7 % 180 AS angle, CAST(l_quantity AS BIGINT) * 2 % 100 AS depth, ['revolute', 'prismatic', 'continuous'][CAST(l_partkey % 3 AS INTEGER) + 1] AS joint, ['rotate', 'slide_out', 'press', 'wipe'][CAST(l_suppkey % 4 AS INTEGER) + 1] AS action, l_quantity < 20 AS closed
 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_quantity > 5 AND l_discount > 0.02)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible parts with box, joint, action and state; all numbers are hundredths."""
    x = table(spark, sf_dir, "lineitem").where("l_quantity > 5 AND l_discount > 0.02")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("class"))
    q, p = F.col("l_quantity").cast("long"), F.col("l_partkey")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    return x.join(s, "l_suppkey").join(n, "n_nationkey").select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("link"), p.alias("id"), F.col("l_suppkey").alias("object"), "class", F.concat(F.lit("part"), p % 17).alias("name"),
        (p * 7 % 97).alias("cx"), (F.col("l_suppkey") * 13 % 97).alias("cy"), q.alias("w"), (F.col("l_linenumber") * 9).cast("long").alias("h"), (p * 7 % 180).alias("angle"), (q * 2 % 100).alias("depth"),
        pick(JOINTS, p).alias("joint"), pick(ACTIONS, F.col("l_suppkey")).alias("action"), (F.col("l_quantity") < 20).alias("closed"),
    )


def numbers(*columns: str) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(format_centi(F.col(c)) for c in columns)), F.lit("]"))


def _numbers(*columns: str) -> str:
    one = lambda c: f"CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"
    return "'[' || " + " || ',' || ".join(one(c) for c in columns) + " || ']'"


def tagged(tag: str, name: Column, values: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), name, F.lit(f"</{tag}>"), values)


BOX = ("cx", "cy", "w", "h", "angle")
#: Centre, size and rotation.
BOX3 = ("cx", "cy", "depth", "w", "h", "five", "zero", "zero", "angle")
SELECT = " SELECT image, link, id, object, {r} AS conversations FROM parts"


def turns(question: Column, answer: Column) -> Column:
    turn = lambda who, said: F.struct(F.lit(who).alias("from"), said.alias("value"))
    return F.to_json(F.array(turn("human", question), turn("gpt", answer)))


def _turns(question: str, answer: str) -> str:
    return f"CAST(to_json([{{'from': 'human', 'value': {question}}}, {{'from': 'gpt', 'value': {answer}}}]) AS VARCHAR)"


def record(df: DataFrame, question: Column, answer: Column) -> DataFrame:
    return df.select("image", "link", "id", "object", turns(question, answer).alias("conversations"))


def ask(task: str, value: Column | None = None) -> Column:
    head, *rest = QUESTIONS[task].split("{}")
    return F.concat(F.lit(head), value, F.lit(rest[0])) if rest else F.lit(head)


def _ask(task: str, value: str = "") -> str:
    head, *rest = QUESTIONS[task].replace("'", "''").split("{}")
    return f"'{head}' || {value} || '{rest[0]}'" if rest else f"'{head}'"


def listed(task: str, boxes: Column) -> Column:
    """The sentence that lists all parts."""
    one, several = LISTED[task]
    head, rest = several.split("{}")
    lead = F.when(F.size(boxes) == 1, one).otherwise(F.concat(F.lit(head), number_word(F.size(boxes)), F.lit(rest)))
    return F.concat(lead, F.array_join(boxes, ","), F.lit("."))


def _listed(task: str) -> str:
    one, several = LISTED[task]
    head, rest = several.split("{}")
    return f"CASE WHEN n = 1 THEN '{one}' ELSE '{head}' || ['one','two','three','four','five','six','seven','eight','nine','ten','eleven'][n] || '{rest}' END || boxes || '.'"


def with_box3(df: DataFrame) -> DataFrame:
    return df.withColumns({"five": F.lit(5).cast("long"), "zero": F.lit(0).cast("long")})


def _box3() -> str:
    return _numbers("cx", "cy", "depth", "w", "h", "5", "0", "0", "angle")


AXIS = ("cx", "cy", "depth", "ex", "ey", "depth")


def with_axis(df: DataFrame) -> DataFrame:
    """The axis' other end."""
    return df.withColumns({"ex": F.col("cx") + F.col("w"), "ey": F.col("cy") + F.col("h")})


def _axis() -> str:
    return _numbers("cx", "cy", "depth", "(cx + w)", "(cy + h)", "depth")


def _tagged(tag: str, name: str, values: str) -> str:
    return f"'<{tag}>' || {name} || '</{tag}>' || {values}"


@query(PARTS + SELECT.format(r=_turns(_ask("single_link", "name"), _numbers(*BOX))))
def task_single_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(parts(spark, sf_dir), ask("single_link", F.col("name")), numbers(*BOX))


@query(PARTS + SELECT.format(r=_turns(_ask("joint", "name"), _tagged("rb", "joint", _numbers(*BOX)))))
def task_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(parts(spark, sf_dir), ask("joint", F.col("name")), tagged("rb", F.col("joint"), numbers(*BOX)))


@query(PARTS + SELECT.format(r=_turns(_ask("joint_depth", "name"), _tagged("rb", "joint", _numbers(*BOX, "depth")))))
def task_joint_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first depth is the box's sixth number."""
    return record(parts(spark, sf_dir), ask("joint_depth", F.col("name")), tagged("rb", F.col("joint"), numbers(*BOX, "depth")))


@query(PARTS + SELECT.format(r=_turns(_ask("joint_depth", "name"), _tagged("rb", "joint", _numbers(*BOX)) + " || '<rbd>' || " + _numbers("depth", "w") + " || '</rbd>'")))
def task_joint_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both depths stand after the box, in brackets of their own."""
    return record(parts(spark, sf_dir), ask("joint_depth", F.col("name")), F.concat(tagged("rb", F.col("joint"), numbers(*BOX)), F.lit("<rbd>"), numbers("depth", "w"), F.lit("</rbd>")))


@query(PARTS + SELECT.format(r=_turns(_ask("joint", "name"), "CASE WHEN closed THEN 'Closed' ELSE 'Opened' END")) + " WHERE joint <> 'continuous'")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question is that of the joint."""
    return record(parts(spark, sf_dir).where("joint != 'continuous'"), ask("joint", F.col("name")), F.when(F.col("closed"), "Closed").otherwise("Opened"))


@query(PARTS + SELECT.format(r=_turns(_ask("joint_3d", "name"), "CASE WHEN closed THEN 'Closed' ELSE 'Opened' END")) + " WHERE joint <> 'continuous'")
def task_status_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(parts(spark, sf_dir).where("joint != 'continuous'"), ask("joint_3d", F.col("name")), F.when(F.col("closed"), "Closed").otherwise("Opened"))


@query(PARTS + SELECT.format(r=_turns(_ask("joint_3d", "name"), _tagged("axis", "joint", _axis()))))
def task_joint_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(with_axis(parts(spark, sf_dir)), ask("joint_3d", F.col("name")), tagged("axis", F.col("joint"), numbers(*AXIS)))


@query(PARTS + SELECT.format(r=_turns(_ask("single_link_3d", "name"), _box3())))
def task_single_link_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(with_box3(parts(spark, sf_dir)), ask("single_link_3d", F.col("name")), numbers(*BOX3))


ALL = """, k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY CASE WHEN n > 10 THEN -w * h ELSE 0 END, link, id, object, name, cx, cy, w, h, angle) AS r FROM (SELECT *, count(*) OVER (PARTITION BY image) AS n FROM parts)),
g AS (SELECT image, CAST(least(max(n), 10) AS BIGINT) AS n, string_agg({box}, ',' ORDER BY r) AS boxes FROM k WHERE r <= 10 GROUP BY image) SELECT image, {record} AS conversations FROM g"""


def all_parts(p: DataFrame, task: str, box: Column) -> DataFrame:
    """The ten largest parts of an image if it has more, else all in order; an image's parts are few."""
    p = p.withColumn("n", F.count("*").over(Window.partitionBy("image")))
    order = Window.partitionBy("image").orderBy(F.when(F.col("n") > 10, -F.col("w") * F.col("h")).otherwise(F.lit(0)), "link", "id", "object", "name", *BOX)
    top = p.withColumn("r", F.row_number().over(order)).where("r <= 10").select("image", "r", box.alias("box"))
    found = top.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("r", "box"))).alias("b"))
    return found.select("image", turns(ask(task), listed(task, F.transform("b", lambda b: b["box"]))).alias("conversations"))


@query(PARTS + ALL.format(box=_tagged("rb", "name", _numbers(*BOX)), record=_turns(_ask("all_parts"), _listed("all_parts"))))
def task_det_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_parts(parts(spark, sf_dir), "all_parts", tagged("rb", F.col("name"), numbers(*BOX)))


@query(PARTS + ALL.format(box=_tagged("box", "name", _box3()), record=_turns(_ask("all_parts_3d"), _listed("all_parts_3d"))))
def task_det_all_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_parts(with_box3(parts(spark, sf_dir)), "all_parts_3d", tagged("box", F.col("name"), numbers(*BOX3)))


STEPS = """, f AS (SELECT image, name, action, min(link * 1000000 + id) AS k, arg_min({box}, (link * 1000000 + id, cx, cy, w, h, angle, depth)) AS box FROM parts GROUP BY image, name, action),
g AS (SELECT image, string_agg('<{tag}>' || action || '</{tag}>' || box, ',' ORDER BY k, name, action) AS actions, string_agg(action || ' the ' || name, ', then ' ORDER BY k, name, action) AS task FROM f GROUP BY image)
SELECT image, {record} AS conversations FROM g WHERE length(actions) >= 5"""


def grounded(p: DataFrame, task: str, tag: str, box: Column) -> DataFrame:
    """An image's task is the list of its actions, each grounded in the first part that its text names."""
    key = F.struct((F.col("link") * 1000000 + F.col("id")).alias("k"), *BOX, "depth")
    first = p.groupBy("image", "name", "action").agg(F.min(F.col("link") * 1000000 + F.col("id")).alias("k"), F.min_by(box, key).alias("box"))
    steps = first.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("k", "name", "action", "box"))).alias("s"))
    actions = F.array_join(F.transform("s", lambda x: tagged(tag, x["action"], x["box"])), ",")
    told = F.array_join(F.transform("s", lambda x: F.concat(x["action"], F.lit(" the "), x["name"])), ", then ")
    return steps.where(F.length(actions) >= LEAST_ACTIONS).select("image", turns(ask(task, told), actions).alias("conversations"))


@query(PARTS + STEPS.format(box=_numbers(*BOX), tag="rb", record=_turns(_ask("grounding", "task"), "actions")))
def task_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounded(parts(spark, sf_dir), "grounding", "rb", numbers(*BOX))


@query(PARTS + STEPS.format(box=_box3(), tag="box", record=_turns(_ask("grounding_3d", "task"), "actions")))
def task_grounding_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounded(with_box3(parts(spark, sf_dir)), "grounding_3d", "box", numbers(*BOX3))


_STATUS = "CASE WHEN joint = 'continuous' THEN '' WHEN closed THEN 'closed_' ELSE 'opened_' END || name"
CORPUS = f""", tasks AS (SELECT 'NATION_' || p_partkey % 25 AS class, ['closed_', 'opened_', ''][CAST(p_partkey % 3 AS INTEGER) + 1] || 'part' || p_partkey * 7 % 17 AS name, 't' || p_partkey AS task, p_name AS description,
 list_filter([CASE WHEN p_size % 4 > 0 THEN 'press[''' || ['closed_', 'opened_', ''][CAST(p_partkey % 3 AS INTEGER) + 1] || 'part' || p_partkey * 7 % 17 || ''']' END, CASE WHEN p_size % 3 = 0 THEN 'wipe[''part' || p_size % 17 || ''']' END, CASE WHEN p_size % 5 < 2 THEN 'StatusComplete' END], lambda a: a IS NOT NULL) AS actions FROM part),
l AS (SELECT image, class, {_STATUS} AS name, {{box}} AS box, (link, id, object, cx, cy, w, h, angle) AS place FROM parts),
n AS (SELECT image, name, min(place) AS place, arg_max(box, place) AS box FROM l GROUP BY image, name), e AS (SELECT image, list({{{{'name': name, 'box': box}}}} ORDER BY place) AS links FROM n GROUP BY image),
c AS (SELECT image, arg_max({{{{'class': class, 'name': name}}}}, place) AS l FROM l WHERE EXISTS (SELECT 1 FROM tasks t WHERE t.class = l.class AND t.name = l.name) GROUP BY image),
d AS (SELECT image, arg_min(t, (md5('1:' || image || ':' || task), task)) AS a, arg_min(t, (md5('2:' || image || ':' || task), task)) AS b FROM c JOIN tasks t ON t.class = c.l.class AND t.name = c.l.name GROUP BY image),
s AS (SELECT image, a, b, links, {{said_a}} AS said_a, {{said_b}} AS said_b FROM d JOIN e USING (image)),
r AS (SELECT image, CASE WHEN length(said_a) >= 5 THEN a.description ELSE b.description END AS task, CASE WHEN length(said_a) >= 5 THEN said_a ELSE said_b END AS actions FROM s WHERE length(said_a) >= 5 OR length(said_b) >= 5)
SELECT image, {{record}} AS conversations FROM r"""


def _said(draw: str, tag: str) -> str:
    first = "list_filter(links, lambda x: contains(y, x.name))[1]"
    boxed = f"'<{tag}>' || split_part(y, '[', 1) || '</{tag}>' || {first}.box || CASE WHEN i < len({draw}.actions) THEN ',' ELSE '' END"
    return f"array_to_string(list_transform({draw}.actions, lambda y, i: CASE WHEN contains(y, 'StatusComplete') THEN 'StatusComplete' WHEN {first} IS NOT NULL THEN {boxed} ELSE '' END), '')"


def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by class and part, written as JSON files of classes and read back."""
    p, path = table(spark, sf_dir, "part"), scratch(spark, "corpus")
    name = F.concat(F.get(F.array(F.lit("closed_"), F.lit("opened_"), F.lit("")), (F.col("p_partkey") % 3).cast("int")), F.lit("part"), F.col("p_partkey") * 7 % 17)
    steps = F.array(
        F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("press['"), name, F.lit("']"))), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("wipe['part"), F.col("p_size") % 17, F.lit("']"))), F.when(F.col("p_size") % 5 < 2, "StatusComplete"),
    )
    told = F.struct(F.col("p_name").alias("description"), F.filter(steps, lambda a: a.isNotNull()).alias("actions"))
    rows = p.select(F.floor(F.col("p_partkey") / 10000).alias("file"), F.concat(F.lit("NATION_"), F.col("p_partkey") % 25).alias("class"), name.alias("name"), F.struct(F.concat(F.lit("t"), "p_partkey").alias("key"), told.alias("value")).alias("task"))
    links = rows.groupBy("file", "class", "name").agg(F.map_from_entries(F.collect_list("task")).alias("value"))
    classes = links.groupBy("file", "class").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("value"))
    classes.select(F.to_json(F.create_map("class", "value")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.task_corpus(spark, path)[0]


def from_corpus(spark: SparkSession, sf_dir: str, task: str, tag: str, box: Column) -> DataFrame:
    status = F.when(F.col("joint") == "continuous", "").when(F.col("closed"), "closed_").otherwise("opened_")
    links = with_box3(parts(spark, sf_dir)).withColumns({"name": F.concat(status, "name"), "box": box})
    found = grounded_tasks(links, task_files(spark, sf_dir), tag, order=["link", "id", "object", *BOX])
    return found.select("image", turns(ask(task, F.col("description")), F.col("actions")).alias("conversations"))


@query(PARTS + CORPUS.format(box=_numbers(*BOX), said_a=_said("a", "rb"), said_b=_said("b", "rb"), record=_turns(_ask("grounding", "task"), "actions")))
def task_grounding_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_corpus(spark, sf_dir, "grounding", "rb", numbers(*BOX))


@query(PARTS + CORPUS.format(box=_box3(), said_a=_said("a", "box"), said_b=_said("b", "box"), record=_turns(_ask("grounding_3d", "task"), "actions")))
def task_grounding_corpus_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_corpus(spark, sf_dir, "grounding_3d", "box", numbers(*BOX3))


def first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, link, id, object, name, box, answer): a box of eight corners for each part, as a first stage answers."""
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    corner = [F.concat(F.lit("["), three(F.col("cx") + (F.col("w") if i >= 4 else F.lit(0))), F.lit(","), three(F.col("cy") + (F.col("h") if i // 2 % 2 else F.lit(0))), F.lit(","), three(F.col("depth") + 5 * (i % 2)), F.lit("]")) for i in range(8)]
    return parts(spark, sf_dir).select("image", "link", "id", "object", "name", *BOX, tagged("box", F.col("name"), F.concat(F.lit("["), F.concat_ws(",", *corner), F.lit("]"))).alias("answer"))


@query(PARTS + """, t AS (SELECT 'single_link' AS task, class FROM parts UNION ALL SELECT 'joint', class FROM parts UNION ALL SELECT 'status', class FROM parts WHERE joint <> 'continuous')
SELECT task, CASE WHEN class IN ('NATION_3', 'NATION_7') THEN 'val' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1, 2""")
def task_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    tasks = F.filter(F.array(F.lit("single_link"), F.lit("joint"), F.when(F.col("joint") != "continuous", "status")), lambda t: t.isNotNull())
    split = F.when(F.col("class").isin("NATION_3", "NATION_7"), "val").otherwise("train")
    return p.select(F.explode(tasks).alias("task"), split.alias("split")).groupBy("task", "split").agg(F.count("*").alias("n"))


@query(PARTS + " SELECT image, link, id, object, CAST(0 AS INTEGER) AS box, 'Describe the joint of the part at ' || CAST(cx AS VARCHAR) || ',' || CAST(cy AS VARCHAR) || ',' || CAST(depth AS VARCHAR) || '.' AS question FROM parts")
def stage2_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a first stage parsed and turned into the questions of the second, one for each box."""
    a = first_stage(spark, sf_dir)
    boxes = a.select("image", "link", "id", "object", F.posexplode(corner_boxes(F.col("answer"))).alias("box", "corners"))
    at = F.concat_ws(",", *(F.round(F.get(F.get("corners", F.lit(0)), F.lit(k)) * 100).cast("long").cast("string") for k in range(3)))
    return boxes.select("image", "link", "id", "object", "box", F.concat(F.lit("Describe the joint of the part at "), at, F.lit(".")).alias("question"))


def box8(*corner: Column) -> Column:
    """Eight corners as [[x,y,z],..], two places."""
    return F.concat(F.lit("["), F.concat_ws(",", *corner), F.lit("]"))


def corner_texts(between: str = ",") -> list[Column]:
    """The corners of a part's box from (cx, cy, depth) to (cx + w, cy + h, depth + 5)."""
    ends = [(F.col("cx"), F.col("cx") + F.col("w")), (F.col("cy"), F.col("cy") + F.col("h")), (F.col("depth"), F.col("depth") + 5)]
    pick = lambda i: (ends[0][i >= 4], ends[1][i // 2 % 2], ends[2][i % 2])
    return [F.concat(F.lit("["), F.concat_ws(between, *map(format_centi, pick(i))), F.lit("]")) for i in range(8)]


def _corners() -> str:
    ends = (("cx", "(cx + w)"), ("cy", "(cy + h)"), ("depth", "(depth + 5)"))
    return "'[' || " + " || ',' || ".join(_numbers(ends[0][i >= 4], ends[1][i // 2 % 2], ends[2][i % 2]) for i in range(8)) + " || ']'"


#: Whether a question names its part (0) or gives its box (1), by the MD5 of the part.
BY_BOX = "CAST('0x' || substr(md5('9:' || image || ':' || id), 1, 4) AS INTEGER) % 2"
_ASKED = f"CASE WHEN {BY_BOX} = 1 THEN {_numbers(*BOX)} ELSE name END"


def asked() -> Column:
    """How a question points to its part: by its box or by its name, drawn by a hash."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("9"), "image", "id").cast("binary")), 1, 4), 16, 10).cast("int") % 2
    return F.when(draw == 1, numbers(*BOX)).otherwise(F.col("name"))


@query(PARTS + SELECT.format(r=_turns(_ask("joint", _ASKED), _tagged("rb", "joint", _numbers(*BOX)))))
def task_joint_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(parts(spark, sf_dir), ask("joint", asked()), tagged("rb", F.col("joint"), numbers(*BOX)))


@query(PARTS + SELECT.format(r=_turns(_ask("joint_depth", _ASKED), _tagged("rb", "joint", _numbers(*BOX, "depth")))))
def task_joint_ext_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(parts(spark, sf_dir), ask("joint_depth", asked()), tagged("rb", F.col("joint"), numbers(*BOX, "depth")))


@query(PARTS + SELECT.format(r=_turns(_ask("joint_depth", _ASKED), _tagged("rb", "joint", _numbers(*BOX)) + " || '<rbd>' || " + _numbers("depth", "w") + " || '</rbd>'")))
def task_joint_depth_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(parts(spark, sf_dir), ask("joint_depth", asked()), F.concat(tagged("rb", F.col("joint"), numbers(*BOX)), F.lit("<rbd>"), numbers("depth", "w"), F.lit("</rbd>")))


@query(PARTS + SELECT.format(r=_turns(_ask("joint", _ASKED), "CASE WHEN closed THEN 'Closed' ELSE 'Opened' END")) + " WHERE joint <> 'continuous'")
def task_status_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(parts(spark, sf_dir).where("joint != 'continuous'"), ask("joint", asked()), F.when(F.col("closed"), "Closed").otherwise("Opened"))


@query(PARTS + SELECT.format(r=_turns(_ask("joint_3d", _corners()), _tagged("axis", "joint", _axis()))))
def task_joint_3d_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In space the part is always given by the corners of its box."""
    return record(with_axis(parts(spark, sf_dir)), ask("joint_3d", box8(*corner_texts())), tagged("axis", F.col("joint"), numbers(*AXIS)))


@query(PARTS + SELECT.format(r=_turns(_ask("joint_3d", _corners()), "CASE WHEN closed THEN 'Closed' ELSE 'Opened' END")) + " WHERE joint <> 'continuous'")
def task_status_3d_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(parts(spark, sf_dir).where("joint != 'continuous'"), ask("joint_3d", box8(*corner_texts())), F.when(F.col("closed"), "Closed").otherwise("Opened"))


#: The second stage's question for a box that the first stage has found (fixed value).
SECOND = "Please provide the joint's type and its 3D axis linked to the object part  "


def shown_box(text: Column) -> Column:
    """A box's text in hundredths as eight corners of three numbers with two places; missing ones are left out, further ones dropped."""
    # corners and numbers pass through lambdas: a column written out for each of the 24 numbers would parse the box for each
    three = lambda p: F.transform(F.transform(F.array(*map(F.lit, range(3))), lambda k: F.get(p, k)), format_centi)
    eight = lambda found: F.transform(F.array(*map(F.lit, range(8))), lambda i: F.concat(F.lit("["), let(F.get(found, i), lambda p: F.coalesce(F.array_join(three(p), ","), F.lit(""))), F.lit("]")))
    return box8(F.array_join(let(corner_numbers(text), eight), ","))


def second_questions(df: DataFrame, answer: str, keys: list[str]) -> DataFrame:
    """(keys, box, conversations): a question for each box of eight corners in a first stage's answer, numbered from 0; the answer is open."""
    boxes = df.select(*keys, F.posexplode(box_texts(F.col(answer))).alias("box", "text"))
    said = F.to_json(F.array(F.struct(F.lit("human").alias("from"), F.concat(F.lit(SECOND), shown_box(F.col("text"))).alias("value")), F.struct(F.lit("gpt").alias("from"), F.lit(None).cast("string").alias("value"))), {"ignoreNullFields": "false"})
    return boxes.select(*keys, "box", said.alias("conversations"))


@query(PARTS + f""", k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY link, id, object, name, cx, cy, w, h, angle) - 1 AS r FROM parts)
SELECT image, CAST(r AS INTEGER) AS box, CAST(to_json([{{'from': 'human', 'value': '{SECOND.replace("'", "''")}' || {_corners()}}}, {{'from': 'gpt', 'value': NULL}}]) AS VARCHAR) AS conversations FROM k""")
def stage2_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that list all parts of an image, parsed into a question for each."""
    p = first_stage(spark, sf_dir).withColumnRenamed("answer", "told")
    order = F.struct("link", "id", "object", "name", *BOX, "told")
    answers = p.groupBy("image").agg(F.concat(F.lit("The parts are: "), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["told"]), ","), F.lit(".")).alias("answer"))
    return second_questions(answers, "answer", ["image"])


@query("SELECT p_partkey, CASE WHEN length(p_brand) >= 8 THEN p_brand WHEN length(p_type) >= 8 THEN p_type END AS choice FROM part")
def min_length_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two candidates that is long enough, or nothing."""
    long = lambda c: F.when(F.length(c) >= 8, F.col(c))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(long("p_brand"), long("p_type")).alias("choice"))


@query("""WITH f AS (SELECT p_partkey, p_type || '_3d_' || p_size || CASE WHEN p_partkey % 4 = 0 THEN '_reg' ELSE '' END || '.json' AS file FROM part)
SELECT p_partkey, CASE WHEN starts_with(file, 'E') THEN 'detection' WHEN starts_with(file, 'S') THEN 'joint' ELSE 'other' END AS kind FROM f WHERE contains(file, '.json') AND contains(file, '3d') AND NOT contains(file, 'reg')""")
def task_file_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_type", F.lit("_3d_"), "p_size", F.when(F.col("p_partkey") % 4 == 0, "_reg").otherwise(""), F.lit(".json"))
    f = table(spark, sf_dir, "part").select("p_partkey", name.alias("file")).where(F.col("file").contains(".json") & F.col("file").contains("3d") & ~F.col("file").contains("reg"))
    return f.select("p_partkey", F.when(F.col("file").startswith("E"), "detection").when(F.col("file").startswith("S"), "joint").otherwise("other").alias("kind"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 5 + l_linenumber % 5 AS BIGINT) AS image FROM lineitem")
def image_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 5 + F.col("l_linenumber") % 5).alias("image"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS text FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')")
def caption_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "STANDARD"))
    return p.select("p_partkey", F.get(F.array("p_name", "p_brand"), (F.col("p_size") % 2).cast("int")).alias("text"))
