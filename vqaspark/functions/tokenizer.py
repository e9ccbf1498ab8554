"""A tokenizer as a column function: any encoder, called on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def numbers(ids: list[int], lead: list[int], tail: list[int]) -> np.ndarray:
    return np.array(lead + ids + tail, np.int32)


def encoded(text: Column, factory: Callable[[], Callable[[str], list[int]]], bos: int | None = None, eos: int | None = None) -> Column:
    """array<int> of a text's ids with optional begin and end ids; the encoder is made once per task; a null text stays null.

    A batch keeps its ids as four bytes each, not as Python's numbers.
    """

    @pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = factory()
        lead, tail = [] if bos is None else [bos], [] if eos is None else [eos]
        for texts in batches:
            yield texts.map(lambda t: None if t is None else numbers(one(t), lead, tail))

    return encode(text)


def word_numbers() -> Callable[[str], list[int]]:
    """A stand-in encoder: words as numbers from 3 on, by their MD5."""
    from hashlib import md5

    return lambda text: [int(md5(w.encode()).hexdigest()[:4], 16) + 3 for w in text.split()]
