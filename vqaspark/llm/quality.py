"""Operator 10: quality rules with a trained verdict.

Base rules count words, symbols, repeated lines and repeated word windows.  A logistic regression over hashed words and
character four-grams, trained on labelled rows and calibrated on held-out ones, judges what the base rules keep.  The model
is two arrays of fixed size that travel with the tasks; scoring is one narrow stage over Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
BITS = 16
WIDTH = 1 << BITS
#: Labelled rows used for fitting: those with the smallest hash of doc_id; the rest of the labels is not needed.
TRAIN_ROWS = 2000
#: Kept: calibrated probability of good quality at least this.
KEEP = 0.35


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 4:
        h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
        windows = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            again = np.zeros(n - 2, bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeated = int(covered.sum())
    return n, len(text) - sum(map(text.count, common.ASCII_SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a text's words and of its UTF-8 four-grams, in two halves of one range."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    w = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (WIDTH - 1)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return w, np.zeros(0, np.int64)
    grams = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
    return w, ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class QualityModel:
    """Weights of words and of grams, each applied to its mean over the text, and the calibration's slope and offset."""

    words: np.ndarray
    grams: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, text: str) -> float:
        w, g = hashed(text)
        return self.bias + (float(self.words[w].mean()) if len(w) else 0.0) + (float(self.grams[g].mean()) if len(g) else 0.0)

    def probability(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.offset, -30, 30))))


def _calibrate(margins: np.ndarray, good: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Platt's sigmoid with his smoothed targets, by Newton steps that are halved until the loss falls."""
    n1, n0 = good.sum(), (1 - good).sum()
    target = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(margins.std()), 1e-9)
    x, beta = np.stack([margins / spread, np.ones_like(margins)], 1), np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-3 * ((b - [1, 0]) ** 2).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (p - target) + 2e-3 * (beta - [1, 0]))
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(beta[0] / spread), float(beta[1])


def train(features: list[np.ndarray], shares: list[np.ndarray], good: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-7) -> QualityModel:
    """AdaGrad on all rows at once, classes weighted alike; every fifth row is held out for the calibration."""
    good = np.asarray(good, float)
    if len(good) < 10 or good.min() == good.max():
        return QualityModel(np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), offset=30.0)  # nothing to learn: keep
    held = np.arange(len(good)) % 5 == 4
    owner = np.repeat(np.arange(len(good)), [len(f) for f in features])
    index, share = np.concatenate(features), np.concatenate(shares)
    weight = np.where(good > 0, 0.5 / good[~held].sum().clip(1), 0.5 / (1 - good[~held]).sum().clip(1)) * ~held
    w, b, seen, seen_b = np.zeros(2 * WIDTH), 0.0, np.full(2 * WIDTH, 1e-12), 1e-12
    for _ in range(rounds):
        margin = np.bincount(owner, share * w[index], len(good)) + b
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - good) * weight
        grad = np.bincount(index, share * slope[owner], 2 * WIDTH) + decay * w
        seen += grad**2
        seen_b += slope.sum() ** 2
        w -= rate * 10 * grad / np.sqrt(seen)
        b -= rate * slope.sum() / np.sqrt(seen_b)
    margin = np.bincount(owner, share * w[index], len(good)) + b
    a, c = _calibrate(margin[held], good[held]) if 0 < good[held].mean() < 1 else (1.0, 0.0)
    return QualityModel(w[:WIDTH].astype(np.float32), w[WIDTH:].astype(np.float32), float(b), a, c)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers with their shares of the text's words and grams."""
    w, g = hashed(text)
    wi, wn = np.unique(w, return_counts=True)
    gi, gn = np.unique(g, return_counts=True)
    return np.concatenate([wi, gi + WIDTH]), np.concatenate([wn / max(1, len(w)), gn / max(1, len(g))])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel:
    """Trains on at most ``rows`` labelled documents, chosen by the hash of their id; only hashed features reach the driver.

    Rows without a label, an id or a text do not count; of several texts with one id the first in order does.  A row's features are
    at most 2 * WIDTH pairs of numbers, whatever its text's length.  With fewer than ten rows or a single class every text is kept.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("doc_id IS NOT NULL AND good IN (0, 1)")
    chosen = chosen.groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = common.texts(df.where(F.col(text_col).isNotNull()), id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most `rows` small rows
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"))  # of repeated ids one text, so `rows` bounds the rows too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            found = [counted(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([s.astype("<f4").tobytes() for _, s in found], pa.binary())],
                names=["doc_id", "good", "features", "shares"],
            )

    got = sorted(known.select("doc_id", "text", "good").mapInArrow(run, "doc_id long, good int, features binary, shares binary").collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return train([np.frombuffer(r.features, "<i4").astype(np.int64) for r in got], [np.frombuffer(r.shares, "<f4").astype(float) for r in got], np.array([r.good for r in got]))


def fit_on(spark: SparkSession, sf_dir: str) -> QualityModel:
    """The model of a data set's own documents and labels."""
    return fit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(df: DataFrame, model: QualityModel, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good) for every row.

    A null text counts as empty and so fails the base rules; a null id stays null; repeated rows give repeated results;
    further columns are not read; an empty table gives an empty result; bytes that are no UTF-8 count as U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            found = b.column(1).to_pylist()
            counts = np.array([base_counts(t) for t in found], np.int64).reshape(-1, 5)
            p = np.array([model.probability(t) for t in found])
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"
    return common.texts(df, id_col, text_col).mapInArrow(run, schema)


def kept_rows(df: DataFrame, model: QualityModel, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that quality_rules() keeps: one narrow stage, without a join by id.

    A null or empty text fails the base rules and goes; repeated rows and rows without an id are judged each; bytes that are no
    UTF-8 become U+FFFD; an empty table gives an empty result.
    """
    at = df.columns.index(text_col)
    df = df.withColumn(text_col, common.valid(F.col(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            good = []
            for text in b.column(at).to_pylist():
                n, _, _, _, repeated = base_counts(text or "")
                good.append(n >= 50 and 100 * repeated <= 50 * n and model.probability(text) >= keep)
            yield b.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(run, df.schema)
