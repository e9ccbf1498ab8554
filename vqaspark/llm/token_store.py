"""Operator 7: token ids in a content-addressed store.

A gear rolling hash over the ids cuts each document into chunks, so passages that documents share meet in equal chunks.  A
chunk's address is the BLAKE2b digest of its bytes.  The store is three Parquet tables in one folder:

- ``chunks``: one row for each distinct chunk: its address and its bytes (little-endian unsigned 16-bit ids);
- ``recipes``: one row for each document in ascending doc_id order: part, place and start within the part, n_tokens, the list
  of (address, n), and the leaf: the digest of all these;
- ``manifest``: one row for each part: where it starts, its documents and ids, and the root of a Merkle tree over its leaves,
  of which every node has up to ``FAN_OUT`` children.

A task sends an address's bytes once, so that a chunk that many documents share is no hot key; documents keep addresses only.
Reading back recomputes every address from the bytes, every leaf from its recipe and every node from the leaves.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoders import BATCH_BYTES, BATCH_TEXTS
from .encoders import encoder as encoder_of

LEAST, MOST, MASK_BITS = 64, 4096, 9
SEEN = 500_000
FAN_OUT = 1000


@functools.cache
def gear() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, 65_536, dtype=np.int64).astype(np.uint64)


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the places where the top bits of the gear hash over the last 16 ids are 0."""
    h = gear()[ids]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint64(step)
    return np.flatnonzero((h >> np.uint64(16 - MASK_BITS)) & np.uint64((1 << MASK_BITS) - 1) == 0) + 1


def cuts(found: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids: at the marks found, where that gives chunks of 64 to 4096 ids."""
    ends, last = [], 0
    for m in found:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            ends.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def encoded_rows(df: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(kind, key, doc_id, data): chunks (kind 0) under their address, and documents (kind 1) under their row's number.

    A document's data are its chunks: an address of 16 bytes and the number of ids in 4, each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, end, seen = encoder_of(vocabulary), TaskContext.get().partitionId() << 33, end_id.to_bytes(2, "little"), set()
        for b in common.slices(batches, BATCH_TEXTS, 1, BATCH_BYTES):
            kinds, keys, docs, data = [], [], [], []
            encoded = [raw + end for raw in encoder.encode(b.column(1).to_pylist())]
            # one pass over the batch: the least chunk is longer than the hash's 16 ids, so no cut depends on the document before
            bounds = np.cumsum([0, *(len(raw) // 2 for raw in encoded)])
            every = marks(np.frombuffer(b"".join(encoded), "<u2"))
            first = np.searchsorted(every, bounds, "right").tolist()
            for i, (doc_id, raw) in enumerate(zip(b.column(0).to_pylist(), encoded, strict=True)):
                at, listed = 0, []
                for to in cuts((every[first[i] : first[i + 1]] - bounds[i]).tolist(), len(raw) // 2):
                    part = raw[2 * at : 2 * to]
                    name = address(part)
                    listed += (name, (to - at).to_bytes(4, "little"))
                    if name not in seen:  # this task has not sent it before
                        seen.add(name)
                        kinds.append(0), keys.append(name), docs.append(None), data.append(part)
                    at = to
                kinds.append(1), keys.append(row.to_bytes(8, "big")), docs.append(doc_id), data.append(b"".join(listed))
                row += 1
                if len(seen) > SEEN:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(data, pa.binary())], names=["kind", "key", "doc_id", "data"])

    return df.mapInArrow(run, "kind int, key binary, doc_id long, data binary")


def leaf(doc_id: int | None, part: int, place: int, start: int, n_tokens: int, listed: bytes) -> bytes:
    """The digest of a recipe: where the document stands and what it is made of."""
    return hashlib.sha256(f"{doc_id}:{part}:{place}:{start}:{n_tokens}:".encode() + listed).digest()


def _chunks(data: list[bytes]) -> pa.ListArray:
    """Each document's list of (address, n) from its packed form."""
    packed = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 20)
    names = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(np.arange(0, 16 * len(packed) + 1, 16, dtype=np.int32)), pa.py_buffer(packed[:, :16].tobytes())])
    sizes = pa.array(packed[:, 16:].copy().view("<i4").ravel(), pa.int32())
    offsets = pa.array(np.cumsum([0, *(len(d) // 20 for d in data)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([names, sizes], names=["address", "n"]))


def write_store(df: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes chunks, recipes and manifest under path.  One shuffle moves chunk bytes; the other moves addresses."""
    spark = df.sparkSession
    rows = encoded_rows(common.texts(df, id_col, text_col), vocabulary, end_id)
    once = rows.groupBy("kind", "key").agg(F.first("doc_id").alias("doc_id"), F.first("data").alias("data"))  # equal keys have equal data
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/written")
    # a folder of a kind without rows does not exist: the schema is given, and the kind read as a filter on the folders
    written = spark.read.schema("key binary, doc_id long, data binary, kind int").parquet(f"{path}/written")
    ordered = written.where("kind = 1").select("doc_id", F.col("key").alias("row_key"), "data").repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")

    def recipe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, start = TaskContext.get().partitionId(), 0, 0
        for b in common.slices(batches, 2000):
            data = b.column(2).to_pylist()
            chunks = _chunks(data)
            sizes = np.diff(np.concatenate([[0], np.cumsum(chunks.values.field(1))])[chunks.offsets]).tolist()
            starts, leaves = [], []
            for i, (doc_id, n) in enumerate(zip(b.column(0).to_pylist(), sizes, strict=True)):
                starts.append(start), leaves.append(leaf(doc_id, part, place + i, start, n, data[i]))
                start += n
            columns = [b.column(0), b.column(1), pa.array([part] * len(data), pa.int32()), pa.array(range(place, place + len(data)), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), chunks, pa.array(leaves, pa.binary())]
            place += len(data)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "part", "place", "start_in_part", "n_tokens", "chunks", "leaf"])

    recipes = common.staged(
        ordered.mapInArrow(recipe, "doc_id long, row_key binary, part int, place long, start_in_part long, n_tokens long, chunks array<struct<address:binary,n:int>>, leaf binary"), "recipes", f"{path}/recipes"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not for each document
    nodes(recipes).withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/manifest")


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(address, data): each distinct chunk once."""
    return spark.read.schema("key binary, doc_id long, data binary, kind int").parquet(f"{path}/written").where("kind = 0").select(F.col("key").alias("address"), "data")


def nodes(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, node): the roots of the parts' trees; a part is what one task wrote.

    Three levels of up to ``FAN_OUT`` children take 10**9 documents a part; a level gathers no more than that many digests.
    """
    level = recipes.select("part", "place", F.lit(1).cast("long").alias("n_docs"), "n_tokens", F.hex("leaf").alias("node"))
    for _ in range(3):
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["node"])), ",")
        level = level.groupBy("part", F.floor(F.col("place") / FAN_OUT).alias("up")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(children, 256).alias("node"))
        level = level.withColumnRenamed("up", "place")
    return level.select("part", "n_docs", "n_tokens", "node")


def merkle_root(spark: SparkSession, path: str) -> str:
    """One digest for the whole store, over the parts' nodes in order (a row for each part reaches the driver)."""
    found = spark.read.parquet(f"{path}/manifest").orderBy("part").select("node").collect()
    return hashlib.sha256("".join(r.node for r in found).encode()).hexdigest()


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row_key, start, n_tokens, ids): every document's ids, put together from the stored chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("base"))
    data = stored_chunks(spark, path)
    used = recipes.select("doc_id", "row_key", "part", "start_in_part", "n_tokens", F.posexplode("chunks").alias("seq", "chunk"))
    joined = used.join(data, F.col("chunk.address") == F.col("address")).join(parts, "part")
    whole = joined.groupBy("doc_id", "row_key", "n_tokens", (F.col("base") + F.col("start_in_part")).alias("start")).agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x["data"] for x in found), "<u2").astype(np.int32) for found in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(2), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row_key", "start", "n_tokens", "ids"])

    return whole.mapInArrow(run, "doc_id long, row_key binary, start long, n_tokens long, ids array<int>")


def _mapped(table: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """A linear map of CRC-32 registers, given by what it makes of each of their four bytes."""
    return table[0][registers & 255] ^ table[1][registers >> 8 & 255] ^ table[2][registers >> 16 & 255] ^ table[3][registers >> 24]


@functools.cache
def _zeros() -> list[np.ndarray]:
    """The linear maps that 1, 2, 4, ... zero bytes apply to a CRC-32 register."""
    columns, found = np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(8):
        columns = columns >> 1 ^ (columns & 1) * np.uint32(0xEDB88320)
    bits = np.arange(256)[:, None] >> np.arange(8) & 1 == 1
    for _ in range(48):
        found.append(np.stack([np.bitwise_xor.reduce(np.where(bits, c, np.uint32(0)), axis=1) for c in columns.reshape(4, 8)]))
        columns = _mapped(found[-1], columns)
    return found


def after_zeros(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 (unsigned, 32 bits) adds to that of a longer string in which n_bytes follow it."""
    out = crcs.copy()
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = np.flatnonzero(n_bytes >> k & 1)
        out[on] = _mapped(_zeros()[k], out[on])
    return out


def crc_join(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two strings put together, from theirs and the second's length."""
    return int(after_zeros(np.array([first], np.uint32), np.array([n_bytes]))[0]) ^ second


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) for every document, from the files alone.

    Each stored chunk is read once: its address is recomputed from its bytes, and its CRC-32 (over unsigned 32-bit ids) goes
    to the documents that use it, where the parts' values join to the CRC of the whole.  verified: all chunks were there and
    matched their addresses and lengths, the recipe's digest is its leaf, and the part's tree over the leaves has the
    manifest's root.
    """
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 2000):
            data = b.column(1).to_pylist()
            good = [address(d) == a for a, d in zip(b.column(0).to_pylist(), data, strict=True)]
            crcs = [zlib.crc32(np.frombuffer(d[: len(d) & ~1], "<u2").astype("<u4").tobytes()) for d in data]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crcs, pa.int64()), pa.array([len(d) // 2 for d in data], pa.int32()), pa.array(good, pa.bool_())], names=["address", "crc", "size", "good"])

    stored = stored_chunks(spark, path).mapInArrow(checked, "address binary, crc long, size int, good boolean")
    place = ("doc_id", "row_key", "part", "place", "start_in_part", "n_tokens", "leaf")
    used = recipes.select(*place, F.posexplode("chunks").alias("seq", "chunk")).select(*place, "seq", F.col("chunk.address").alias("address"), F.col("chunk.n").alias("n"))
    met = used.join(stored, "address", "left")
    good = F.coalesce(F.col("good") & (F.col("size") == F.col("n")), F.lit(False)).alias("good")
    whole = met.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("seq", "address", "n", "crc", good))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 2000):
            lists = b.column(6)
            bounds = lists.offsets.to_numpy()  # no list is empty: a document has its end id
            names, sizes, parts, well = (lists.values.field(i) for i in range(1, 5))
            # the values of a document's parts add up, each moved by the bytes after it
            ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(), dtype=np.int64)])
            after = np.repeat(ends[bounds[1:]], np.diff(bounds)) - ends[bounds[0] + 1 : bounds[-1] + 1]
            parts = after_zeros(pc.fill_null(parts, 0).to_numpy()[bounds[0] : bounds[-1]].astype(np.uint32), 4 * after)
            crcs = np.bitwise_xor.reduceat(parts, bounds[:-1] - bounds[0]).astype(np.int64)
            found_sizes, right, at = np.diff(ends[bounds]).tolist(), [], bounds.tolist()
            names, sizes, well = names.to_pylist(), sizes.to_pylist(), well.to_pylist()
            for i, (doc_id, part, place, start, n, told) in enumerate(zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)):
                mine = range(at[i], at[i + 1])
                packed = b"".join([names[j] + sizes[j].to_bytes(4, "little") for j in mine])
                right.append(all(well[at[i] : at[i + 1]]) and found_sizes[i] == n and leaf(doc_id, part, place, start, n, packed) == told)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(crcs, pa.int64()), pa.array(right, pa.bool_())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32", "good"])

    found = whole.select("doc_id", "part", "place", "start_in_part", "n_tokens", "leaf", "found").mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long, good boolean")
    kept = manifest.select("part", F.col("start").alias("base"), "node").join(nodes(recipes).select("part", F.col("node").alias("found_node")), "part")
    return found.join(kept, "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", (F.col("good") & (F.col("node") == F.col("found_node"))).alias("verified")
    )


def token_store(df: DataFrame, vocabulary: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the store (by default in the shared folder) and returns read_digests() of it.

    A null or empty text is its end id alone; a null id stays null and comes first; repeated rows are stored each (their
    chunks once); further columns are not read; an empty table gives an empty store.
    """
    spark = df.sparkSession
    path = path or f"{common.shared_dir(spark)}/store-{uuid.uuid4().hex}"
    write_store(df, path, vocabulary, end_id, id_col, text_col)
    return read_digests(spark, path)
