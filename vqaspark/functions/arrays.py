"""Token arrays: labels, padding, searching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_sublist(a: Column, b: Column) -> Column:
    """Index of the first place where b stands in a, or -1."""
    last = F.size(a) - F.size(b)
    at = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(a, i + 1, F.size(b)) == b))
    return F.coalesce(F.get(at, F.lit(0)), F.lit(-1))


def mask_prefix(tokens: Column, n: Column, fill: int = -1) -> Column:
    return F.transform(tokens, lambda v, i: F.when(i < n, fill).otherwise(v))


def mask_outside(tokens: Column, start: Column, end: Column, fill: int = -100) -> Column:
    """Labels that keep only the tokens in [start, end)."""
    return F.transform(tokens, lambda v, i: F.when((i >= start) & (i < end), v).otherwise(fill))


def pad(tokens: Column, length: int, fill: int = -1) -> Column:
    """Exactly ``length`` elements: padded at the end or cut."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(fill), length)), 1, length)


def loss_mask(padded: Column) -> tuple[Column, Column]:
    """Padding as 0, and 1.0 where a token stood."""
    return F.transform(padded, lambda v: F.greatest(v, F.lit(0))), F.transform(padded, lambda v: (v >= 0).cast("double"))


def keep_last(tokens: Column, n: int) -> Column:
    """The last n elements, or all of a shorter array."""
    return F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), n)


def first_stop(tokens: Column, stops: list[list[int]]) -> Column:
    """Tokens up to the first of the stop sequences."""
    at = [F.when(find_sublist(tokens, F.array(*map(F.lit, s))) >= 0, find_sublist(tokens, F.array(*map(F.lit, s)))) for s in stops]
    end = F.coalesce(F.least(*at) if len(at) > 1 else at[0], F.size(tokens))
    return F.slice(tokens, F.lit(1), end)


def gather(values: Column, index: Column) -> Column:
    """values at the places of a nested index."""
    return F.transform(index, lambda s: F.transform(s, lambda i: F.get(values, i)))


def any_label(labels: Column) -> Column:
    return F.exists(labels, lambda x: x != 0)


def tile(values: Column, n: int) -> Column:
    """Exactly n elements by repetition from the start; an empty array stays empty."""
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(values, i % F.size(values)))).otherwise(values)


def pick_columns(rows: Column, columns: list[int]) -> Column:
    return F.transform(rows, lambda r: F.array(*[F.get(r, F.lit(c)) for c in columns]))


def zero_nulls(v: Column) -> Column:
    return F.transform(v, lambda x: F.coalesce(x, F.lit(0)))


def strip_begin(tokens: Column, bos: int = 1) -> Column:
    """Tokens without the begin id that an encoder put first."""
    return F.when(F.get(tokens, F.lit(0)) == bos, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written and evaluated once; elsewhere a column is copied to each place that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_grid(rows: Column, n: int) -> Column:
    """A matrix (array of rows) cut into n * n equal parts, by row and then column of the grid; a size that n does not divide is an error."""

    def cut(m: Column) -> Column:
        high, wide = F.size(m), F.size(F.get(m, F.lit(0)))
        checked = F.when((high % n == 0) & (wide % n == 0), F.struct((high / n).cast("int").alias("h"), (wide / n).cast("int").alias("w")))
        sizes = F.coalesce(checked, F.raise_error(F.lit("the grid does not divide the matrix")).cast("struct<h:int,w:int>"))
        part = lambda i, j, s: F.transform(F.slice(m, i * s["h"] + 1, s["h"]), lambda r: F.slice(r, j * s["w"] + 1, s["w"]))
        return let(sizes, lambda s: F.array(*[part(i, j, s) for i in range(n) for j in range(n)]))

    return let(rows, cut)


def merge_grid(parts: Column, n: int) -> Column:
    """The matrix that split_grid() has cut."""
    joined = lambda p, i: F.transform(F.get(p, F.lit(i * n)), lambda _, r: F.flatten(F.transform(F.slice(p, i * n + 1, n), lambda x: F.get(x, r))))
    return let(parts, lambda p: F.flatten(F.array(*[joined(p, i) for i in range(n)])))
