"""Operator 2: benchmark decontamination by canonical templates, with DataFrame functions only.

Three passes over the whole text mark numbers, units after a number, and names (capitalised inside a sentence); then words
are cut and lose case and outer punctuation.  A window of five words has three hashes: ``names``, where all marked words are
typed placeholders; ``numbers``, where names are plain words, so that a copy in another case still fits; and ``exact``, with
no placeholder at all.  Windows are hashed on both sides and hash-joined; those that meet keep what stood in their slots.
Along one alignment of document and item, each slot value of the item must always meet the same value in the document: a
passage with its numbers exchanged throughout fits, chance meetings do not.  A document holds an item if at least 80 % of the
item's distinct windows of one kind fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW, SHARE = 5, 0.8
#: Windows with fewer literal words than this say nothing and have no hash of that kind; ``exact`` windows always have one.
LITERALS = 2
#: Units of measure and money that count as such after a number (fixed values).
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg lb lbs oz gram grams pound pounds ml l liter liters litre litres s sec seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh km/h usd eur gbp dollar dollars euro euros cent cents percent degree degrees w kw v a hz".split()
#: Marks of a word: a number, a unit, a name.  The text's own signs of that kind count as blanks.
NUMBER, UNIT, NAME = "<", ">", "{"
#: Distinct hashes (8 bytes each) that are broadcast at most; beyond it both sides are shuffled by the hash.
BROADCAST_HASHES = 1_000_000


def words(text: Column, first_is_name: bool = False) -> Column:
    """The text's marked words between two empty strings.

    A word holds a letter or a digit; it is a number if its first one is an ASCII digit, a unit if it is one of ``UNITS``
    after a number, and a name if its first sign is a capital, its second is none, and the word before it does not end a
    sentence.  first_is_name: a capitalised first word counts as it would inside a sentence, where a quoted passage begins.
    """
    out = F.concat(F.lit("x " if first_is_name else " "), F.translate(text, "<>{", "   "), F.lit(" "))
    out = F.regexp_replace(out, r"(?=[0-9])(?<=\s[^\p{L}\p{N}\s]{0,4})", NUMBER)
    out = F.regexp_replace(out, rf"({NUMBER}\S+\s+[^\p{{L}}\p{{N}}\s]{{0,4}})(?=(?i:{'|'.join(UNITS)})[^\p{{L}}\p{{N}}\s]*+\s)", f"$1{UNIT}")
    out = F.regexp_replace(out, r"(?=\p{Lu}(?!\p{Lu}))(?<=[^\s.!?:]\s{1,4})", f"\\{NAME}")
    cut = F.split(F.lower(out), r"[^\p{L}\p{N}\s<>{]*\s[^\p{L}\p{N}<>{]*")
    return F.concat(F.array(F.lit("")), F.slice(cut, 2, F.size(cut))) if first_is_name else cut


def windows(df: DataFrame, keys: list[str], text: Column, first_is_name: bool = False) -> DataFrame:
    """df's keys with pos and the marked words of each window of the text, a blank between two."""
    cut = df.select(*keys, words(text, first_is_name).alias("words"))
    # the first and last word are empty; a shift of the array for each place in the window
    count = F.greatest(F.size("words") - (WINDOW + 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice("words", 2 + k, count).alias(f"w{k}") for k in range(WINDOW)])
    return cut.select(*keys, F.posexplode(shifted).alias("pos", "w")).select(*keys, "pos", F.concat_ws(" ", *[F.col(f"w.w{k}") for k in range(WINDOW)]).alias("window"))


def _is_marked(window: Column) -> Column:
    return window.contains(NUMBER) | window.contains(UNIT) | window.contains(NAME)


def _hashes(window: Column) -> Column:
    """The hashes of a window with marks: of each kind, null if too few literal words are left; the last is that of a window without marks."""
    exact, no_names = F.translate(window, "<>{", ""), F.replace(window, F.lit(NAME))
    enough = lambda w, left: F.length(w) - F.length(left) <= WINDOW - LITERALS
    hidden = lambda w: F.xxhash64(F.regexp_replace(w, r"([<>{])\S*", "$1"))
    return F.array(F.when(enough(window, exact), hidden(window)), F.when(enough(no_names, exact), hidden(no_names)), F.xxhash64(exact))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, item_key, item_pos, kind, h, window): each item's windows of each kind, its first word taken both ways."""
    text = common.valid(F.col(text_col))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.xxhash64(text).alias("item_key"), text.alias("text")).where("text IS NOT NULL").dropDuplicates(["item_id", "item_key"])
    keys = ["item_id", "item_key"]
    every = windows(items, keys, F.col("text")).union(windows(items, keys, F.col("text"), True).where("pos = 0"))
    return every.select(*keys, F.col("pos").alias("item_pos"), F.col("window"), F.posexplode(_hashes(F.col("window"))).alias("kind", "h")).where("h IS NOT NULL").distinct()


def contaminated_items(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_hashes: int = BROADCAST_HASHES
) -> DataFrame:
    """(doc_id, text_key, item_id, n_windows, n_item_windows, exact) for each document that holds an item.

    A document is a row's id and text together (text_key is the text's hash): rows with one id and different texts, and rows
    without an id, are judged each by itself; repeated rows count as one.  exact: the slots hold the item's own values.
    Rows with a null or empty text, and items of fewer than five words, match nothing; items with one id and several texts
    are judged each; bytes that are no UTF-8 count as U+FFFD; further columns are not read; empty tables give an empty result.
    """
    items = common.staged(item_windows(benchmark, item_col, item_text_col), "items")
    hashes = items.select("h").distinct()
    if hashes.count() <= broadcast_hashes:  # 8 bytes each, so their number bounds the size
        hashes = F.broadcast(hashes)
    text = common.valid(F.col(text_col))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).where("text IS NOT NULL")
    cut = windows(docs, ["doc_id", "text_key"], F.col("text"))
    cut = cut.withColumn("h", F.explode(F.when(_is_marked(F.col("window")), _hashes(F.col("window"))).otherwise(F.array(F.xxhash64("window")))))
    hits = common.staged(cut.join(hashes, "h", "left_semi").distinct(), "hits")

    # of an item's windows of a kind, so many have to fit that one of the rarest is always among them: these find the candidates
    met = F.count("*").over(Window.partitionBy("kind", "h"))
    order = Window.partitionBy("item_id", "item_key", "kind").orderBy("common", "item_pos")
    places = items.groupBy("item_id", "item_key", "kind", "item_pos").agg(F.min("h").alias("h"), F.collect_set("h").alias("all_h"))
    totals = places.groupBy("item_id", "item_key", "kind").agg(F.count("*").alias("n_item_windows"))
    size = F.count("*").over(Window.partitionBy("item_id", "item_key", "kind"))
    ranked = places.withColumn("common", met).withColumn("place", F.row_number().over(order)).withColumn("n_item_windows", size)
    index = ranked.where(F.col("place") <= F.floor(F.col("n_item_windows") * (1 - SHARE) + 1e-9) + 1).select("item_id", "item_key", F.explode("all_h").alias("h")).distinct()
    candidates = hits.select("doc_id", "text_key", "h").distinct().join(index, "h").select("doc_id", "text_key", "item_id", "item_key").distinct()

    same = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for a, b, c in (("h", "c", "doc_id"), ("h", "c", "text_key"), ("c", "i", "item_id"), ("c", "i", "item_key"))]
    both = hits.alias("h").join(candidates.alias("c"), same[0] & same[1]).join(items.alias("i"), same[2] & same[3] & (F.col("h.h") == F.col("i.h")))
    slots = lambda w: F.split(w, " ")
    pairs = F.transform(F.arrays_zip(slots("i.window").alias("item"), slots("h.window").alias("found")), lambda z: F.struct(z["item"].alias("item"), F.translate(z["found"], "<>{", "").alias("found")))
    bare = F.transform(F.filter(pairs, lambda z: _is_marked(z["item"])), lambda z: F.struct(F.translate(z["item"], "<>{", "").alias("item"), z["found"].alias("found")))
    who = ("doc_id", "text_key", "item_id", "item_key")
    lines = both.select("h.doc_id", "h.text_key", "c.item_id", "c.item_key", F.struct("i.kind", "i.item_pos").alias("place"), (F.col("h.pos") - F.col("i.item_pos")).alias("shift"), bare.alias("pairs"))
    lines = lines.groupBy(*who, "shift").agg(F.collect_set("place").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    # along one alignment an item's slot value always meets the same value
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"]))) == F.size("pairs")
    equal = F.forall("pairs", lambda p: p["item"] == p["found"])
    whole = lines.where(consistent).select(*who, F.explode("at").alias("place"), equal.alias("exact")).groupBy(*who, "place").agg(F.max("exact").alias("exact"))
    whole, who = whole.select(*who, "place.kind", "exact"), (*who, "kind")
    found = whole.groupBy(*who).agg(F.count("*").alias("n_windows"), F.min("exact").alias("exact"))
    good = found.join(totals, (found["item_id"].eqNullSafe(totals["item_id"])) & (found["item_key"] == totals["item_key"]) & (found["kind"] == totals["kind"])).where(F.col("n_windows") >= SHARE * F.col("n_item_windows"))
    good = good.select(*[found[c] for c in ("doc_id", "text_key", "item_id")], "n_windows", "n_item_windows", "exact")
    best = good.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("n_windows", "n_item_windows", "exact")).alias("x"))
    return best.select("doc_id", "text_key", "item_id", "x.*")


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_items, items): the documents that hold an item, with the items' ids in order; otherwise as contaminated_items()."""
    found = contaminated_items(df, benchmark, id_col, text_col)
    return found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("items"))


def clean_rows(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that hold no item; rows without an id and repeated rows are judged as all others."""
    leaks = contaminated(df, benchmark, id_col, text_col).select(F.col("doc_id").alias("leak_id_"), F.col("text_key").alias("leak_key_"))
    return df.join(leaks, F.col(id_col).cast("long").eqNullSafe(F.col("leak_id_")) & (F.xxhash64(common.valid(F.col(text_col))) == F.col("leak_key_")), "left_anti")
