"""Column helpers for the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for the row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _sums(lengths: Column) -> Column:
    """Sums of a short array's elements before each position; the result is copied at each step."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def running(lengths: Column, block: int = 256) -> Column:
    """Sums of an array's elements before each position: within blocks, and over the blocks' totals, so that no long array is copied for each element."""

    def over(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return let(_sums(totals), lambda before: F.flatten(F.transform(parts, lambda p, i: F.transform(_sums(p), lambda x: x + F.get(before, i)))))

    cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(n), F.lit(1)) - 1) / block).cast("int")), lambda i: F.slice(n, i * block + 1, block))
    return let(lengths, lambda n: F.when(F.size(n) <= block, _sums(n)).otherwise(let(cut(n), over)))


#: Code points of a block of a text, and how many of those before it each block holds too.
BLOCK, BACK = 4096, 64


def blocks(text: Column) -> Column:
    """A text in blocks, so that what stands around a place is found without a walk from the text's beginning."""
    last = F.floor(F.length(text) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, F.greatest(i * BLOCK - BACK, F.lit(0)) + 1, F.lit(BLOCK) + F.when(i > 0, BACK).otherwise(0)))


def around(cut: Column, at: Column, before: int, after: int) -> Column:
    """Up to ``before`` code points before a place and ``after`` from it on (within its block), by the text's blocks; before is BACK at most."""
    i = F.floor(at / BLOCK).cast("int")
    local = at - F.greatest(i * BLOCK - BACK, F.lit(0))
    first = F.greatest(local - before, F.lit(0))
    return F.substring(F.get(cut, i), first + 1, local - first + after)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found>> of a pattern's matches, leftmost and without overlap, in code points, end exclusive.

    The pieces between the matches and the matches themselves add up to the text, which gives the places.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(f: Column) -> Column:
        return let(
            pieces,
            lambda p: let(
                running(F.transform(F.arrays_zip(p.alias("p"), f.alias("f")), lambda z: F.length(z["p"]) + F.coalesce(F.length(z["f"]), F.lit(0)))),
                lambda before: F.transform(
                    f,
                    lambda m, i: F.struct(
                        (F.get(before, i) + F.length(F.get(p, i))).alias("start"), (F.get(before, i) + F.length(F.get(p, i)) + F.length(m)).alias("end"), m.alias("found")
                    ),
                ),
            ),
        )

    return let(found, place)
