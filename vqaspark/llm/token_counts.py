"""Operator 3: token counts by rank-synchronous array merging.

Distinct units of a batch become ragged numpy arrays of symbols.  Each round looks up the rank of every neighbouring pair,
takes each sequence's lowest rank and merges all of that pair's places at once (left to right, without overlap); sequences
without a ranked pair leave with the number of symbols that survive.  A pair's product only occurs in pairs of higher rank,
so the rounds give what one merge at a time gives.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .encoders import CACHE_UNITS, PLAIN, load

#: The vocabulary's split rule for plain Latin text (fixed values).
LETTER, DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\\s{LETTER}{DIGIT}]+")
NONE = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RaggedMerger:
    """Symbols left after merging, for pre-tokens given as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + end] for c in alphabet], np.int64)
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], np.diff(keys[order]) > 0])  # a pair listed twice keeps its lowest rank
        keys, ranks = keys[order][first], order[first]
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.mask = (1 << 18) - 1
        self.table_key, self.table_rank = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):  # all keys still without a place try the next one
            slot = (self._hash(keys[left]) + self.probes) & self.mask
            free = self.table_key[slot] < 0
            _, winner = np.unique(slot[free], return_index=True)
            won = left[free][winner]
            self.table_key[slot[free][winner]], self.table_rank[slot[free][winner]] = keys[won], ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            self.probes += 1

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        base, out = self._hash(keys), np.full(len(keys), NONE)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            slot = (base[todo] + probe) & self.mask
            held = self.table_key[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.table_rank[slot[hit]]
            todo = todo[~hit & (held >= 0)]
            if not len(todo):
                break
        return out

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = sizes.copy()
        data = np.frombuffer(b"".join(tokens), np.uint8)
        if not len(data):
            return out
        owner = np.repeat(np.arange(len(tokens)), sizes)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[data[ends]]
        while len(owner) > 1:
            same = owner[1:] == owner[:-1]
            ranks = np.full(len(owner), NONE)  # of the pair that starts here
            at = np.flatnonzero(same)
            ranks[at] = self._ranks((symbols[at] << 16) | symbols[at + 1])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.concatenate([starts, [len(owner)]]))
            done = lowest == NONE
            out[owner[starts[done]]] = lengths[done]
            best = np.repeat(lowest, lengths)
            merge = (ranks == best) & (best < NONE)
            hit = np.flatnonzero(merge)
            if not len(hit):
                break
            new_run = np.concatenate([[True], np.diff(hit) > 1])  # 'aaa': of adjoining places, every second one
            within = np.arange(len(hit)) - np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[within % 2 == 0]
            symbols[hit] = self.product[ranks[hit]]
            keep = best < NONE
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(owner) == 1:
            out[owner[0]] = 1
        return out


class TokenCounter:
    def __init__(self, path: str):
        self.tokenizer, self.merger = load(path), RaggedMerger(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.code = {c: b for b, c in enumerate(byte_alphabet())}
        self.units: dict[str, int] = {}

    def _learn(self, units: list[str]) -> None:
        tokens = [SPLIT.findall(u) for u in units]
        flat = self.merger.counts([x.encode() for t in tokens for x in t])
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        sums = np.concatenate([[0], np.cumsum(flat)])[np.concatenate([[0], ends])]
        self.units.update(zip(units, np.diff(sums).tolist(), strict=True))

    def _whole(self, text: str) -> int:
        n = len(self.special.findall(text))
        for part in self.special.split(text):
            words = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)) if part else []
            n += int(self.merger.counts([bytes(self.code[c] for c in w) for w, _ in words]).sum()) if words else 0
        return n

    def count(self, texts: list[str]) -> list[int]:
        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        split = [t.lower().split() if PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        known, new = self.units.__contains__, set()
        for p in split:
            if p:
                new.update(u for u in set(p) if not known(u))
        if new:
            self._learn(list(new))
        get = self.units.__getitem__
        return [self._whole(t) if p is None else sum(map(get, p)) for t, p in zip(texts, split, strict=True)]


@functools.cache
def counter_of(path: str) -> TokenCounter:
    """One per worker process: what a task has learnt serves the next."""
    return TokenCounter(path)


def token_counts(df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; a null text counts as empty (0 bytes, 0 tokens).

    One narrow stage: repeated rows give repeated results, a null id stays null, further columns are not read, an empty
    table gives an empty result; bytes that are no UTF-8 count as U+FFFD, in n_bytes too.  Memory is bounded by the unit cache
    and one slice of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for b in common.slices(batches):
            found = b.column(1).to_pylist()
            n = counter.count(found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in found], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return common.texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
