"""Operator 11: all runs (maximal periodic stretches) of words, in linear time over an ordered alphabet.

A run's Lyndon roots are edges (i, next smaller suffix of i) of the Lyndon array of one of the two orders of the alphabet, and
its ends are what such an edge extends to on both sides.  The array is built from left to right with the lengths matched on the
way: the stretch that reaches furthest was matched with an earlier copy of itself, whose edges answer every comparison that ends
before its reach, so only steps that move the reach are made on words.  No suffix structure, no hash of a text.

Words that no five-word window repeats within the document are left out beforehand: every word of a run of twelve words or more
lies in a window of five that the run itself repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The least length of a run, and the window that each word of so long a run shares with another place (3 * (WINDOW - 1) <= LEAST).
LEAST, WINDOW = 12, 5
BELOW_ALL = -(1 << 62)


def lyndon_edges(t: list[int]) -> tuple[list[int], list[int]]:
    """For each i the start of the next smaller suffix (len(t) for none) and the length that both suffixes share."""
    n = len(t)
    t = [*t, BELOW_ALL]
    after, after_len = [-1] * (n + 1), [0] * (n + 1)
    before, before_len = [-1] * (n + 1), [0] * (n + 1)
    left, right, reach = -1, n, 0  # t[left:] and t[right:reach] agree as far as reach
    for r in range(1, n + 1):
        i, k = r - 1, 0
        while True:
            known = False
            if right < r < reach and i >= right:
                a, b = i - (right - left), r - (right - left)
                if after[a] == b or before[b] == a:
                    e = after_len[a] if after[a] == b else before_len[b]
                    known = r + e < reach
                    k = e if known else max(k, reach - r)
            if not known:
                while t[i + k] == t[r + k]:
                    k += 1
                if r + k >= reach:
                    left, right, reach = i, r, r + k
            if t[r + k] > t[i + k]:
                before[r], before_len[r] = i, k
                break
            after[i], after_len[i] = r, k
            # smaller suffixes further left share before_len with the one just ended; where that differs from k it decides
            i, m = before[i], before_len[i]
            while i >= 0 and m > k:
                after[i], after_len[i] = r, k
                i, m = before[i], before_len[i]
            if i < 0:
                break
            if m < k:
                before[r], before_len[r] = i, m
                break
    return after, after_len


def runs(t: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` symbols and twice its period, by start, then period."""
    found = set()
    for s in (t, [-x for x in t]):
        after, shared = lyndon_edges(s)
        ended: dict[int, int] = {}  # by period: the end of the last stretch looked at, which its other roots share
        for i in range(len(s)):
            j, r = after[i], shared[i]
            p = j - i
            short = max(least - p - r, p - r)
            if short >= p or ended.get(p) == j + r:
                continue
            ended[p] = j + r
            k, most = 0, min(p, i)
            while k < most and s[i - 1 - k] == s[j - 1 - k]:
                k += 1
            if short <= k < p:
                found.add((i - k, k + p + r, p))
    return sorted(found)


def repeated_stretches(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal stretches, of one document each, of ``least`` words or more whose every word lies in a window that its document repeats.

    Windows are named by ranks of pairs of ranks, so equal names are equal words.
    """
    n = len(ids)
    if n < least:
        return []
    names, width = ids, 1
    while width < window:
        step = min(width, window - width)
        names = names[: n - width - step + 1] * (int(names.max()) + 1) + names[step : n - width + 1] if step == width else names[:-step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(names, return_inverse=True)[1].astype(np.int64)
        width += step
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    key = names[starts] * (int(doc[-1]) + 1) + doc[starts]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = starts[twice]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    live = np.cumsum(cover)[:n] > 0
    edge = np.flatnonzero(np.diff(np.where(live, doc + 1, 0), prepend=0, append=0))
    return [(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if live[a] and b - a >= least]


def kept_mask(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that a run contains after its first period."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.cumsum(cover)[:n] == 0


def runs_of_texts(texts: list[str], least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(number of words, runs, kept words joined by one space) of each text."""
    words = [t.encode().split() for t in texts]  # bytes split at the six ASCII white spaces only
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    number = {w: i for i, w in enumerate(set(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    ends = np.cumsum(sizes)
    found: dict[int, list[tuple[int, int, int]]] = {}
    doc = np.repeat(np.arange(len(words)), sizes)
    for a, b in repeated_stretches(ids, doc, least) if least >= LEAST else zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        if b > a:
            at = int(doc[a])
            base = a - int(ends[at] - sizes[at])
            found.setdefault(at, []).extend((s + base, length, p) for s, length, p in runs(ids[a:b].tolist(), least))
    for i, ws in enumerate(words):
        mine = found.get(i, [])
        if mine:
            yield len(ws), mine, b" ".join([w for w, k in zip(ws, kept_mask(len(ws), mine).tolist(), strict=True) if k]).decode()
        else:
            yield len(ws), mine, b" ".join(ws).decode()


def periodic_runs(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: runs of at least ``least`` words as (start, length, period) by start,
    then period, and the text without the words that some run contains after its first period, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has no words, no runs and an empty collapsed text; bytes that are no
    UTF-8 count as U+FFFD; a null id stays null; repeated rows give repeated results; other columns are not read; an empty
    table gives an empty result.  One narrow stage; memory is bounded by a slice of rows, or by one text longer than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in common.slices(batches, column=1):
            out = list(runs_of_texts(b.column(1).to_pylist(), least))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], kind), pa.array([x[2] for x in out], pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return common.texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
