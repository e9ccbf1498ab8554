"""Operator 9: secrets by patterns and by a battery of randomness tests.

Patterns find assigned values, access keys and hexadecimal runs.  Besides, every long token that mixes letters and digits, or
small and capital letters, is tested for randomness in the alphabet it seems to use, and so are its long parts between the
signs that join names and paths: chi-squared uniformity of its characters, the runs test about the
middle of the alphabet and lag-one serial correlation, put together by Fisher's rule.  Stretches of each document's running
letters show how often language of a given length looks random by chance; with those counts, over all documents, each length
class of whole tokens, of parts and of tokens without a digit gets the threshold that holds the expected share of false finds
at most at ``FALSE_SHARE``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "random")
#: Base patterns and the least length of what must be found (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # shorter runs fail in any case
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
#: What a part of a token may lie between: a name's or a query's equals signs, and within those a path's or a name's signs.
WITHIN = tuple(re.compile(x) for x in (r"[^/]+", r"[^_-]+", r"[^/_+-]+"))
#: Small before capital letter, as names of several words and nearly all random strings without a digit have.
MIXED = re.compile(r"[a-z][A-Z]")
#: Whole tokens and parts with a digit, and either without one, have thresholds of their own, so that no sort's language hides another's secrets.
SORTS = 3
#: Encodings from the narrowest on: alphabet in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_")
FALSE_SHARE = 0.01
#: Length classes end before these; scores are binned in steps of one half up to BINS / 2.
LENGTHS = (20, 24, 32, 40, 64, 1 << 30)
BINS = 60
#: Lengths of the stretches of running letters that stand for language in each class.
SPANS = (18, 22, 28, 36, 50, 80)
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
NO_LETTER = bytes(b for b in range(256) if chr(b) not in UPPER + LOWER)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points by start, then kind; per kind leftmost and without overlap."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str) -> float:
    """Fisher's sum of the three p-values' logarithms, negated: near 0 for a random string, more the less random it looks."""
    used = set(token)
    alphabet = next((a for a in ENCODINGS if used <= set(a)), None)
    if alphabet is None:
        return float("inf")
    k, n = len(alphabet), len(token)
    x = np.array([alphabet.index(c) for c in token])
    counts = np.bincount(x, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    cube = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))  # Wilson and Hilferty
    uniform = _normal_tail(cube)
    high = x >= k / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n0 and n1:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * n0 * n1 / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        in_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        in_runs = 2.0 ** (1 - n)
    centred = x - x.mean()
    total = float((centred**2).sum())
    serial = 2 * _normal_tail(abs(float((centred[1:] * centred[:-1]).sum()) / total) * math.sqrt(n)) if total else 0.0
    return -sum(math.log(max(p, 1e-300)) for p in (uniform, in_runs, serial))


def _parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of the run and of its parts of ``LEAST`` characters at least, without joining signs at the ends; the run is first."""
    found = [(0, len(run))]
    for m in re.finditer("[^=]+", run):
        found += [m.span(), *(x.span() for split in WITHIN for x in split.finditer(run, *m.span()))]
    out = {}
    for start, end in found:
        core = run[start:end].strip("-_+/=")
        if len(core) >= LEAST:
            at = run.index(core, start)
            out[at, at + len(core)] = None
    return list(out)


def tokens(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, class, score bin) of the long tokens that mix letters and digits or small and capital letters, and of their long parts.

    The class is the sort times the number of length classes, plus the length class.
    """
    out = []
    for m in TOKEN.finditer(text):
        whole = m.group().strip("-_+/=")
        for start, end in _parts(m.group()):
            core = m.group()[start:end]
            digit = any(c.isdigit() for c in core)
            if digit and any(c.isalpha() for c in core) or MIXED.search(core):
                sort = 2 if not digit else 0 if len(core) == len(whole) else 1
                length = next(i for i, top in enumerate(LENGTHS) if len(core) < top)
                out.append((m.start() + start, m.start() + end, sort * len(LENGTHS) + length, _bin(core)))
    return out


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest spans, of equals the first, without those that meet a longer one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if not any(s < y and x < e for x, y in out):
            out.append((s, e))
    return out


def _bin(string: str) -> int:
    return min(BINS - 1, int(2 * min(randomness(string), 1e6)))


def without(text: str, spans: list[tuple[int, int, int, int]]) -> str:
    """The text less the spans: what is to be judged is no sample of language."""
    at, out = 0, []
    for s, e, *_ in sorted(spans):
        if s > at:
            out.append(text[at:s])
        at = max(at, e)
    return "".join([*out, text[at:]])


def language(text: str) -> list[int]:
    """Class and score bin, as one number, of one stretch of the text's running letters for each length class.

    The place is drawn by a checksum of the text, so every document gives each class it is long enough for one null sample.
    """
    letters = text.encode("utf-8", "surrogatepass").translate(FOLD, NO_LETTER).decode("ascii")
    place = zlib.crc32(letters.encode())
    return [c * BINS + _bin(letters[(at := place % (len(letters) - n + 1)) : at + n]) for c, n in enumerate(SPANS) if len(letters) >= n]


def scanned(df: DataFrame) -> DataFrame:
    """(doc_id, base, candidates, language): spans of the patterns, tokens to be judged, and the scores of language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triple = pa.list_(pa.list_(pa.int64()))
        for b in common.slices(batches):
            base, odd, plain = [], [], []
            for text in b.column(1).to_pylist():
                base.append(base_spans(text))
                odd.append(tokens(text))
                plain.append(language(without(text, odd[-1])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, triple), pa.array(odd, triple), pa.array(plain, pa.list_(pa.int32()))], names=["doc_id", "base", "candidates", "language"])

    return df.mapInArrow(run, "doc_id long, base array<array<long>>, candidates array<array<long>>, language array<int>")


def thresholds(null_counts: dict[int, int], candidates: dict[int, int], share: float = FALSE_SHARE) -> list[int]:
    """For each length class the highest score bin to accept, or -1: there, expected false finds are at most ``share`` of all.

    Expected false finds: the candidates, times the part of language in the class that scores as low.  A class
    without enough of those (fewer than 1 / share) uses the counts of all classes.
    """
    out, every = [], np.array([sum(null_counts.get(c * BINS + v, 0) for c in range(len(LENGTHS))) for v in range(BINS)], float)
    for c in range(len(LENGTHS)):
        null = np.array([null_counts.get(c * BINS + v, 0) for v in range(BINS)], float)
        null = null if null.sum() >= 1 / share else every
        got = np.array([candidates.get(c * BINS + v, 0) for v in range(BINS)], float)
        expected = got.sum() * (np.cumsum(null) + 1) / (null.sum() + 1)
        good = np.flatnonzero((expected <= share * np.cumsum(got)) & (np.arange(BINS) < BINS - 1))
        out.append(int(good[-1]) if len(good) else -1)
    return out


def find_secrets(df: DataFrame, share: float = FALSE_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row.

    Spans are kind:start:end in code points, end exclusive; random ones are added where they meet no base span, and of
    overlapping ones the longest.  The first pass is written to the shared folder; two histograms of a fixed number of bins
    reach the driver.  A null or empty text has no span; a null id stays null; repeated rows give repeated results; further
    columns are not read; an empty table gives an empty result; bytes that are no UTF-8 count as U+FFFD, in places too.
    """
    found = common.staged(scanned(common.texts(df, id_col, text_col)), "secrets")
    null_counts = {r.bin: r.n for r in found.select(F.explode("language").alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).collect()}
    odd = found.select(F.explode("candidates").alias("x")).groupBy((F.col("x")[2] * BINS + F.col("x")[3]).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    counts, size = {r.bin: r.n for r in odd.collect()}, len(LENGTHS) * BINS
    limit = [x for sort in range(SORTS) for x in thresholds(null_counts, {k % size: n for k, n in counts.items() if k // size == sort}, share)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for base, candidates in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                more = [(s, e, 3) for s, e in outermost([(s, e) for s, e, c, v in candidates if v <= limit[c] and not any(s < y and x < e for x, y, _ in base)])]
                text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in base)
                whole = ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted([*map(tuple, base), *more], key=lambda x: (x[0], x[2])))
                rows.append((*(sum(k == i for _, _, k in base) for i in range(3)), hashlib.sha256(text.encode()).hexdigest(), whole, len(more)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return found.select("doc_id", "base", "candidates").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
