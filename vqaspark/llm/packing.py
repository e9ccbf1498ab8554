"""Operator 5: sequences packed along a space-filling curve.

A first pass encodes each document once, hashes its ids into a vector, projects that to a few dimensions and keeps the
Hilbert key of the cell; the result is written to the shared folder.  The table is then range-partitioned and sorted by
(key, doc_id), so that neighbours on the curve meet, and each partition is cut into full sequences; what is left over at its
end becomes sequences of falling powers of two.  Range boundaries include doc_id: copies of one text, which share a key, spread.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common
from .encoders import BATCH_BYTES, BATCH_TEXTS
from .encoders import encoder as encoder_of

BUCKETS, DIMS, BITS = 256, 4, 12
END_ID = 1


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of cell coordinates (Skilling 2004, on columns of a whole batch)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class CurveKeys:
    """Hilbert key of a document's ids, by hashed counts and a fixed random projection."""

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(0, BUCKETS, 65_536).astype(np.uint8)
        self.projection = rng.standard_normal((BUCKETS, DIMS))

    def __call__(self, ids: list[np.ndarray]) -> np.ndarray:
        counts = np.array([np.bincount(self.bucket[x], minlength=BUCKETS) for x in ids], float).reshape(-1, BUCKETS)
        counts = np.sqrt(counts)
        counts -= counts.mean(axis=1, keepdims=True)
        counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
        share = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(counts @ self.projection / math.sqrt(2)))
        return hilbert_keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def curve_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, curve_key, ids): ids as little-endian unsigned 16-bit bytes with the end id; row_key tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, keys, n = encoder_of(vocabulary), CurveKeys(), TaskContext.get().partitionId() << 33
        end = END_ID.to_bytes(2, "little")
        for b in common.slices(batches, BATCH_TEXTS, 1, BATCH_BYTES):
            ids = [x + end for x in encoder.encode(b.column(1).to_pylist())]
            curve = keys([np.frombuffer(x, "<u2") for x in ids])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.arange(n, n + len(ids))), pa.array(curve), pa.array(ids, pa.binary())], names=["doc_id", "row_key", "curve_key", "ids"]
            )
            n += len(ids)

    return common.texts(df, id_col, text_col).mapInArrow(run, "doc_id long, row_key long, curve_key long, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces_of(rows: Iterator[tuple[int | None, np.ndarray]], size: int, base: int) -> Iterator[tuple]:
    """Pieces of one partition's documents in order: full sequences, then powers of two for the rest."""
    sequence, held, room = base, [], size  # held: the open sequence's (doc_id, ids, start, length)

    def out(doc_id, ids, start, length, offset):
        part = ids[start : start + length]
        return doc_id, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), sequence, offset

    for doc_id, ids in rows:
        start = 0
        while start < len(ids):
            length = min(room, len(ids) - start)
            held.append((doc_id, ids, start, length))
            start, room = start + length, room - length
            if not room:
                offset = 0
                for x in held:
                    yield out(*x, offset)
                    offset += x[3]
                held, room, sequence = [], size, sequence + 1
    rest, offset = size - room, 0
    want = 1 << (rest.bit_length() - 1) if rest else 0
    for doc_id, ids, start, length in held:
        while length:
            take = min(want - offset, length)
            yield out(doc_id, ids, start, take, offset)
            start, length, offset = start + take, length - take, offset + take
            if offset == want:
                rest, offset, sequence = rest - want, 0, sequence + 1
                want = 1 << (rest.bit_length() - 1) if rest else 0


def pack(df: DataFrame, vocabulary: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) that cover every id of every row once.

    Sequences hold ``size`` ids, or a power of two at the end of a partition, so none needs padding.  A null or empty text
    is its end id alone; a null id stays null; repeated rows are packed each; further columns are not read; an empty table
    gives no piece.  Memory: one document, one open sequence, a batch's units; the sort spills.
    """
    encoded = common.staged(curve_documents(df, vocabulary, id_col, text_col), "curve")
    ordered = encoded.repartitionByRange("curve_key", "doc_id", "row_key").sortWithinPartitions("curve_key", "doc_id", "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in common.slices(batches, 200):
                for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield doc_id, np.frombuffer(ids, "<u2")

        names, held = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], []
        for piece in pieces_of(rows(), size, TaskContext.get().partitionId() << 40):
            held.append(piece)
            if len(held) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=names)

    return ordered.select("doc_id", "ids").mapInArrow(run, PIECES)
