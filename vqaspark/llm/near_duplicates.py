"""Operator 6: near duplicates by SetSketch registers.

Texts with the same shingle set form a class, found by a digest of the set; all later work is on classes.  A class's
SetSketch holds, for each of 512 registers, the minimum of exponentially distributed hashes on an exponentially spaced,
truncated scale of one byte (mergeable by maximum).  Bands of eight registers give buckets.

Pairs within a bucket are never listed.  A bucket's pivot is its least class; each class is confirmed against the pivot with
which it shares most buckets, and the links give provisional components.  Then every bucket belongs to its pivot's component,
and what may still be missing are links between members of the same component's buckets.  Those are found by what sets do
not share with the component's centre c, the elements that more than half of its members have.  With D(x) the elements that
only one of x and c has,

    |x & y| = |x & c| + |y & c| - |c| + |D(x) & D(y)|.

So x and y are certainly linked where 9 (|x & c| + |y & c| - |c|) >= 4 (|x| + |y|).  As this is a sum of one term for each, the
member with the greatest term is linked with all that are certainly linked with any: one star.  The other links need a shared
element of D, and so many of them that a prefix of D, the elements that fewest members have first, already holds one: an
equi-join of a few elements for each member.  The sizes of D tell whether a candidate is a link; the joint likelihood of two
sketches is asked before the full sets are compared only for pivots.

A pair at similarity s shares no bucket with probability (1 - s**8)**64 at most: below 1e-5 at 0.8.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

REGISTERS, BANDS = 512, 64
ROWS = REGISTERS // BANDS
#: The sketch's base and the place of 1 on its scale: registers are floor(1 - log_b(min)) + ZERO in 0..255.
BASE, ZERO = 1.15, 30
#: Links: 100 * intersection >= 80 * union; pairs estimated below DROP, ten standard errors away, are not confirmed.
LINK, DROP = 0.8, 0.6
#: Up to so many documents, the ids whose sets are needed are broadcast; beyond, a filter of a fixed number of bits is sent.
BROADCAST_ROWS, SLOTS = 100_000, 1 << 22
#: Words and classes that a worker remembers; hashing one again costs little.
KNOWN = 60_000
#: A group is dealt out in parts of so many members.
GROUP = 2000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Shingles:
    """Sorted distinct 64-bit hashes of the word pairs of a text."""

    def __init__(self, words: int = 2):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        if len(self.known) > KNOWN:
            self.known.clear()
        if not found:
            return np.zeros(0, np.uint64)
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(h))
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = _mix(out) + h[i : len(h) - k + 1 + i]
        return np.unique(_mix(out))


@functools.cache
def shingles_of(words: int = 2) -> Shingles:
    """One per worker process: the words of a task serve the next."""
    return Shingles(words)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of non-empty sets, a row each.

    An element's points on all registers form one Poisson process, so its least points come first: the process is followed
    up to a level that some point of the set reaches in nearly every register, and further where one has none yet.
    """
    out, todo, level = np.full((len(sets), REGISTERS), np.inf), np.arange(len(sets)), np.log(REGISTERS) + 4.5
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        element, most, place = np.concatenate([sets[i] for i in todo]), (level / sizes)[owner], todo[owner] * REGISTERS
        at, step, flat = np.zeros(len(owner)), 0, out.reshape(-1)
        while len(owner):
            step += 1
            h = _mix(element + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            at = at - np.log1p(-(h >> np.uint64(11)).astype(float) * 2.0**-53) / REGISTERS
            on = at <= most
            owner, element, most, place, at = owner[on], element[on], most[on], place[on], at[on]
            np.minimum.at(flat, place + (h[on] & np.uint64(REGISTERS - 1)).astype(np.int64), at)
        todo, level = todo[np.isinf(out[todo]).any(1)], level * 3
    return np.clip(np.floor(1 - np.log(out) / np.log(BASE)) + ZERO, 0, 255).astype(np.uint8)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set."""
    return registers_of([shingles])[0]


def _estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of sketches with known set sizes, at the greatest joint likelihood.

    With shares u = n / (n + m) and v = m / (n + m), register a exceeds b with probability p(u - v J), b exceeds a with
    p(v - u J), and they are equal with the rest, where p allows for the width of the base.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = (n / (n + m))[:, None]
    v = 1 - u
    j = np.minimum(np.linspace(0, 1, 101)[None, :], np.minimum(u, v) / np.maximum(u, v))
    exceeds = lambda x: np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-9)
    p, q = exceeds(u - v * j), exceeds(v - u * j)
    same = np.maximum(1 - p - q, 1e-9)
    fit = more[:, None] * np.log(p) + less[:, None] * np.log(q) + (REGISTERS - more - less)[:, None] * np.log(same)
    return j[np.arange(len(j)), fit.argmax(1)]


def sketches(df: DataFrame) -> DataFrame:
    """(doc_id, text_key, cid, n, registers): cid is the class's digest, null for an empty set; a task sends a class's registers once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only("shingles")
        shingle, seen = shingles_of(), set()
        for b in common.slices(batches, 200):
            cids, sizes, regs, block, held = [], [], [None] * b.num_rows, [], 0

            def sketch(block: list[tuple[int, np.ndarray]], regs: list) -> None:
                for (i, _), r in zip(block, registers_of([s for _, s in block]), strict=True):
                    regs[i] = r.tobytes()

            for i, text in enumerate(b.column(1).to_pylist()):
                s = shingle(text)
                cid = set_digest(s) if len(s) else None
                cids.append(cid), sizes.append(len(s))
                if cid and cid not in seen:
                    block.append((i, s))
                    held += len(s)
                    seen.add(cid)
                if held > 200_000:  # a bounded number of elements at a time
                    sketch(block, regs)
                    block, held = [], 0
            if block:
                sketch(block, regs)
            if len(seen) > KNOWN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "text_key", "cid", "n", "registers"])

    return df.select("doc_id", "text", "text_key").mapInArrow(run, "doc_id long, text_key long, cid binary, n long, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(bucket, cid): the bands' hashes with their number."""
    key = lambda i: F.xxhash64(F.lit(i), F.expr(f"substring(registers, {ROWS * i + 1}, {ROWS})"))
    return classes.select("cid", F.explode(F.array(*[key(i) for i in range(BANDS)])).alias("bucket"))


def _sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cid, set): the full sets of the classes in pairs (a, b), made from the class's own document."""
    wanted_classes = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    ids = common.staged(classes.join(wanted_classes, "cid", "left_semi").select("key", "cid"), "wanted")
    docs = docs.select(F.coalesce("doc_id", "text_key").alias("key"), "text")
    if ids.count() <= BROADCAST_ROWS:  # 8 bytes each
        wanted, chosen = None, docs.join(F.broadcast(ids.select("key").distinct()), "key", "left_semi").select("key", "text", F.lit(0).cast("long").alias("slot"))
    else:  # a filter of fixed size says which documents' sets may be needed; the join below is exact
        wanted, slot = np.zeros(SLOTS // 64, np.uint64), F.pmod(F.xxhash64("key"), F.lit(SLOTS))
        bits = ids.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
        for r in bits.collect():
            wanted[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
        chosen = docs.select("key", "text", slot.alias("slot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only("shingles")
        shingle = shingles_of()
        for b in common.slices(batches):
            if wanted is not None:
                at = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                b = b.filter(pa.array(((wanted[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)))
            found = [shingle(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "cid", "set"])

    made = chosen.mapInArrow(run, "key long, cid binary, set binary")
    # rows repeated with one id and text are one
    return common.staged(made.join(ids, ["key", "cid"], "left_semi").groupBy("cid").agg(F.first("set").alias("set")), "sets")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each element of the sorted set y, whether x has it."""
    return x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Those of the pairs (a, b) of classes that are linked: estimated from the sketches, then confirmed on full sets."""
    side = lambda p: classes.select(F.col("cid").alias(p), F.col("n").alias(f"{p}_n"), F.col("registers").alias(f"{p}_r"))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 2000):
            if not b.num_rows:
                continue
            regs = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (4, 5)]
            sizes = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3)]
            possible = np.minimum(*sizes) >= LINK * np.maximum(*sizes)  # sizes alone exclude the others exactly
            yield b.filter(pa.array(possible & (_estimate(*regs, *sizes) >= DROP))).select([0, 1])

    near = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_n", "b_n", "a_r", "b_r").mapInArrow(guess, "a binary, b binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = int(_common(x, y).sum())
                good.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield b.filter(pa.array(good, pa.bool_())).select([0, 1])

    first, second = (sets.select(F.col("cid").alias(p), F.col("set").alias(f"{p}_set")) for p in "ba")
    measured = near.join(first, "b").join(second, "a").select("a", "b", "a_set", "b_set").mapInArrow(compare, "a binary, b binary")
    return common.staged(measured, f"{name}-links")


def _dealt(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """df, whose rows each belong to a member m of a group r, with a part for each ``GROUP`` members of the group."""
    return df.join(sizes.where("parts > 1"), "r", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("m"), F.col("parts")), F.lit(0))).drop("parts")


def _to_parts(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """df, one row for each group r, once for each part of the group."""
    return df.join(sizes, "r").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _missing(pairs: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame | None:
    """The links (a, b) between members of a component's buckets that are in different components; None if there is no such member."""
    root = lambda p: roots.select(F.col("node").alias(p), F.col("root").alias(f"{p}_root"))
    placed = pairs.join(root("a"), "a", "left").withColumn("a_root", F.coalesce("a_root", "a")).join(root("b"), "b", "left").withColumn("b_root", F.coalesce("b_root", "b"))
    placed = placed.select(F.col("a_root").alias("r"), "a", F.col("b").alias("m"), F.col("b_root").alias("m_root"))
    placed = common.staged(placed.select("r", "m", "m_root").union(placed.select("r", "a", "r")).distinct(), "placed")
    sizes = placed.groupBy("r").agg(F.count("*").alias("members"), F.max(F.col("m_root") != F.col("r")).alias("open")).where("open")
    sizes = common.staged(sizes.select("r", "members", F.ceil(F.col("members") / GROUP).cast("int").alias("parts")), "sizes")
    if sizes.isEmpty():
        return None
    parts = sizes.select("r", "parts")
    members = _dealt(placed.join(sizes.select("r", "members"), "r"), parts).join(sets.withColumnRenamed("cid", "m"), "m")
    members = common.staged(members.select("r", "part", "m", "m_root", "set", "members"), "members")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            found = [np.frombuffer(x.as_py(), np.int64) for x in b.column(2)]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), pa.array(np.concatenate(found))], names=["r", "members", "element"])

    counts = members.select("r", "members", "set").mapInArrow(elements, "r binary, members long, element long").groupBy("r", "members", "element").agg(F.count("*").alias("n"))
    most = counts.where("2 * n > members")  # at most twice a mean set
    centres = most.groupBy("r").agg(F.collect_list("element").alias("centre"))
    centres = _to_parts(sizes.select("r").join(centres, "r", "left").select("r", F.coalesce("centre", F.array().cast("array<long>")).alias("centre")), parts)

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            ks, sizes_, whole, rest, known = [], [], [], [], {}
            for r, c, m in zip(b.column(0).to_pylist(), b.column(3), b.column(4), strict=True):
                if r not in known:
                    known = {r: np.sort(c.values.to_numpy().view(np.uint64))}
                c, m = known[r], np.frombuffer(m.as_py(), np.uint64)
                inside = _common(c, m) if len(c) else np.zeros(len(m), bool)
                lost = c[~_common(m, c)] if len(c) else c
                ks.append(int(inside.sum())), sizes_.append(len(m)), whole.append(len(c)), rest.append(np.concatenate([m[~inside], lost]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(3)), pa.array(sizes_, pa.int64()), pa.array(ks, pa.int64()), pa.array(whole, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], names=["r", "m", "m_root", "n", "k", "c", "rest"]
            )

    joined = members.join(centres, ["r", "part"]).select("r", "m", "m_root", "centre", "set")
    # term: certain links are those whose terms add up to 9 |c| at least
    star = joined.mapInArrow(against, "r binary, m binary, m_root binary, n long, k long, c long, rest array<long>").withColumn("term", F.col("k") * 9 - F.col("n") * 4)
    star = common.staged(_dealt(star, parts), "star")
    best = _to_parts(star.groupBy("r").agg(F.max_by(F.struct("m", "term"), F.struct("term", "m")).alias("best")), parts)
    star = star.join(best, ["r", "part"])
    certain = star.where((F.col("term") + F.col("best.term") >= F.col("c") * 9) & (F.col("m") != F.col("best.m"))).select(F.col("best.m").alias("a"), F.col("m").alias("b"))
    certain = common.staged(certain, "certain")

    # what is left: members that are not certainly linked with the best one, against all others
    sure = (F.col("term") + F.col("best.term") >= F.col("c") * 9) | (F.col("m") == F.col("best.m"))
    star = star.withColumn("sure", sure).drop("best", "part")
    tops = star.groupBy("r").agg(F.max("term").alias("top"), F.max(F.when(~F.col("sure"), F.col("term"))).alias("open_top"))
    open_ = _dealt(star, parts).join(_to_parts(tops.where("open_top IS NOT NULL"), parts), ["r", "part"])
    # least number of shared elements of D with any partner: an unsure one's is the top member, a sure one's the top unsure one
    need = F.ceil((F.col("c") * 9 - F.col("term") - F.when(F.col("sure"), F.col("open_top")).otherwise(F.col("top"))) / 9)
    open_ = open_.withColumn("need", F.greatest(need, F.lit(1)).cast("int")).where(F.size("rest") >= F.col("need"))
    open_ = common.staged(open_.select("r", "m", "m_root", "n", "term", "c", "sure", "need", "rest"), "open")
    exploded = open_.select("r", "m", F.explode("rest").alias("element"))
    often = exploded.groupBy("r", "element").agg(F.count("*").alias("often")).where("often > 1")
    # elements that one member alone has are shared with none, and come first in the order: each lessens the prefix
    placed_elements = exploded.join(often, ["r", "element"]).groupBy("r", "m").agg(F.array_sort(F.collect_list(F.struct("often", "element"))).alias("listed"))
    near = open_.drop("rest").join(placed_elements, ["r", "m"]).withColumn("size", F.size("listed")).where("size >= need")
    near = common.staged(near.withColumn("prefix", F.col("size") - F.col("need") + 1), "near")
    spread = near.select("r", "m", "n", "term", "c", "m_root", "sure", "size", F.posexplode(F.slice("listed", F.lit(1), F.col("prefix"))).alias("place", "x"))
    side = lambda p, df: df.select("r", F.col("x.element").alias("element"), *(F.col(c).alias(f"{p}_{c}") for c in ("m", "n", "term", "m_root", "sure")), (F.col("size") - F.col("place")).alias(f"{p}_left"), *(["c"] if p == "x" else []))
    lacking = F.col("c") * 9 - F.col("x_term") - F.col("y_term")
    told = (
        (F.col("x_m") != F.col("y_m")) & (F.col("x_m_root") != F.col("y_m_root")) & (F.col("y_sure") | (F.col("x_m") < F.col("y_m")))
        & (F.col("x_n") * 5 >= F.col("y_n") * 4) & (F.col("y_n") * 5 >= F.col("x_n") * 4)
        & (F.least("x_left", "y_left") * 9 >= lacking)
    )
    met = side("x", spread.where("NOT sure")).join(side("y", spread), ["r", "element"]).where(told).select("r", "x_m", "y_m", "c").distinct()
    held = lambda p: near.select("r", F.col("m").alias(f"{p}_m"), F.col("term").alias(f"{p}_term"), F.transform("listed", lambda z: z["element"]).alias(f"{p}_listed"))
    shared = F.size(F.array_intersect("x_listed", "y_listed"))
    links = met.join(held("x"), ["r", "x_m"]).join(held("y"), ["r", "y_m"]).where(shared * 9 >= lacking).select(F.col("x_m").alias("a"), F.col("y_m").alias("b"))
    return common.staged(certain.union(links), "missing")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the least node that can be reached.  Min-label rounds with pointer jumps."""
    both = common.staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lowered = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        nxt = common.staged(lowered.join(jump, "root").select("node", "old", F.least("root", "next").alias("root")), "labels")
        if nxt.where("root != old").isEmpty():
            return nxt.select("node", "root")
        labels = nxt.select("node", "root")


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, cid, root, component_id) for every row: text_key is the text's hash, root the component's least class."""
    docs = common.texts(df, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    rows = common.staged(sketches(docs), "sketches")
    # a class's text is found again by the key of one of its rows: the id, or where there is none the text's hash
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("doc"), F.min(F.coalesce("doc_id", "text_key")).alias("key"), F.max("n").alias("n"), F.max("registers").alias("registers"))
    classes = common.staged(classes, "classes")
    bands = _bands(classes)
    pivots = bands.groupBy("bucket").agg(F.min("cid").alias("a"), F.count("*").alias("size")).where("size > 1").select("bucket", "a")
    pairs = bands.join(pivots, "bucket").where("cid != a").groupBy("a", F.col("cid").alias("b")).agg(F.count("*").alias("shared"))
    pairs = common.staged(pairs, "pairs")
    if pairs.isEmpty():
        roots = classes.select(F.col("cid").alias("node"), F.col("cid").alias("root")).limit(0)
    else:
        sets = _sets(docs, classes, pairs)
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
        linked = _links(best, classes, sets, "best")
        roots = components(linked)
        more = _missing(pairs, roots, classes, sets)
        if more is not None and not more.isEmpty():
            roots = components(linked.union(more))
    rooted = classes.select("cid", "doc").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.select("cid", "root").join(names, "root").select("cid", "root", "component_id")
    return rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "cid").join(named, "cid", "left")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    A null or empty text has no shingle and is linked with nothing: it is its own component and kept.  A row without an id is
    compared like all others; its id stays null, does not name a component and is kept only where its group has no id.
    Repeated rows share a component and are each returned; rows with one id and different texts are compared each.  Bytes that
    are no UTF-8 count as U+FFFD; further columns are not read; an empty table gives an empty result.
    """
    empty = F.col("cid").isNull()
    return grouped(df, id_col, text_col).select(
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (empty | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def distinct_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, of which each component has exactly one: that of its least id (rows without an id last, then the least hash of the text).

    Of repeated rows one is taken.  Rows with a null or empty text are components of their own and stay.
    """
    rows = common.staged(grouped(df, id_col, text_col).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("times")), "grouped")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "times")
    chosen = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(first).alias("x")).select("x.*").union(rows.where("root IS NULL").select(F.lit(True), "doc_id", "text_key", F.lit(1)))
    chosen = common.staged(chosen.select(F.col("id").alias("chosen_id_"), F.col("key").alias("chosen_key_"), F.col("times").alias("chosen_times_")), "chosen")
    key = F.xxhash64(common.valid(F.coalesce(F.col(text_col), F.lit(""))))
    met = F.col(id_col).cast("long").eqNullSafe(F.col("chosen_id_")) & (key == F.col("chosen_key_"))
    once = df.join(chosen.where("chosen_times_ = 1"), met, "left_semi")
    repeated = chosen.where("chosen_times_ > 1")
    if repeated.isEmpty():
        return once
    again = df.join(repeated, met, "left_semi").withColumns({"chosen_id_": F.col(id_col).cast("long"), "chosen_key_": key}).dropDuplicates(["chosen_id_", "chosen_key_"])
    return once.union(again.select(*(again[c] for c in df.columns)))
