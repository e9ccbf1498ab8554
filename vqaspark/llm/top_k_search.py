"""Operator 13: exact top-k by inner product with an impact-ordered index, score at a time.

Vectors are dealt into blocks.  A block's index quantises every component to a signed impact and holds, by dimension and impact,
a segment of the vectors that have it; impact 0 has no segment.  A query takes the segments in descending order of
|weight * impact| and adds each to its vectors' accumulators.  A score then differs from its accumulator by no more than what
the next segment of each dimension could still add, and |query| times the length that impacts leave of the vector (Cauchy and
Schwarz).  A vector whose upper bound is below the k-th greatest lower bound is proved to be no member; a query stops when few
possible members are left, or when all segments are done, and rescores all possible members exactly, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Components in a block of the index, impacts to a root mean square, and how often a query looks for a proof.
BLOCK, IMPACTS, CHECKS = 1 << 20, 4, 12
#: A null id comes after all others among equal scores.
NO_ID = (1 << 63) - 1


class ImpactIndex:
    """The segments of one block.  vectors: int64, a row for each id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, impacts: int = IMPACTS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        n, dims = self.vectors.shape
        real = self.vectors.astype(np.float64)
        self.step = max(1.0, float(np.sqrt((real * real).sum() / max(1, real.size))) / impacts)
        level = np.rint(real / self.step).astype(np.int64)
        self.rest = np.sqrt(((real - level * self.step) ** 2).sum(1))  # what impacts leave of each vector
        self.rows, dim_of, impact_of = [], [], []
        for d in range(dims):
            by = np.argsort(level[:, d], kind="stable")
            values, starts = np.unique(level[by, d], return_index=True)
            for v, a, b in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                if v:
                    self.rows.append(by[a:b])
                    dim_of.append(d)
                    impact_of.append(v * self.step)
        self.dim_of, self.impact_of = np.array(dim_of, np.int64), np.array(impact_of, np.float64)

    def search(self, query: np.ndarray, k: int, few: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, exact scores, segments read) of the k greatest, by score, then smaller id."""
        n = len(self.ids)
        possible, read = np.arange(n), 0
        if n > k:
            few = max(8 * k, n >> 7) if few is None else few
            weight = query.astype(np.float64)
            gain = weight[self.dim_of] * self.impact_of
            order = np.argsort(-np.abs(gain), kind="stable")[: int(np.count_nonzero(gain))]
            sizes, dims = np.abs(gain[order]), self.dim_of[order]
            # rounding of the sums is far below a millionth of the greatest possible score
            rest = np.sqrt(weight @ weight) * (self.rest + 1e-6 * self.step * len(query)) + 1e-6
            score, taken, gain = np.zeros(n), order.tolist(), gain.tolist()
            for part in range(CHECKS):
                for s in taken[read : len(taken) * (part + 1) // CHECKS]:
                    score[self.rows[s]] += gain[s]
                read = len(taken) * (part + 1) // CHECKS
                ahead = float(sizes[read:][np.unique(dims[read:], return_index=True)[1]].sum())  # each dimension's next segment is its greatest
                least = np.partition(score - rest, n - k)[n - k] - ahead
                possible = np.flatnonzero(score + rest + ahead >= least)
                if len(possible) <= few:
                    break
        exact = self.vectors[possible] @ query
        top = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible][top], exact[top], read


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, null where the vector is null or holds a component that is null or not finite."""
    value = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.coalesce(odd, F.lit(True)), F.lit(None)).otherwise(value)


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """A row for each vector; shorter ones end in zeros."""
    out = np.zeros((len(vectors), dims), np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    at = np.arange(dims) < sizes[:, None]
    out[at] = vectors.flatten().to_numpy()
    return out


def top_inner_products(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``candidates`` with the greatest inner products with each row of ``queries``,
    all if there are fewer, ties by smaller id (null last).  queries are rows of candidates, and no row finds itself.

    Both tables have an id and an array<long>; a null array takes no part, nor does a null element.  Shorter vectors count as ending in zeros.
    Components of magnitude 2^26 and more are taken as 2^26 - 1, so that a score fits a long.  Repeated query rows give repeated results and
    find each other; other columns are not read; an empty table gives an empty result.

    Candidates are dealt into blocks of ``block`` components, whatever their ids; each block gets every query and answers with its
    k + 1 best, so that a task holds one block, and the blocks' answers are ranked for each query.
    """
    limit = (1 << 26) - 1
    clean = F.transform(F.col(vector_col), lambda x: F.greatest(F.least(x, F.lit(limit)), F.lit(-limit)).cast("long"))
    usable = F.col(vector_col).isNotNull() & ~F.exists(F.col(vector_col), lambda x: x.isNull())
    pick = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), clean.alias("vector")]
    rows = staged(candidates.where(usable).select(*pick).withColumn("row", F.monotonically_increasing_id()), "impact-vectors")
    asked = queries.where(usable).select(*pick).groupBy("id", "vector").agg(F.count("*").alias("times"))
    asked = staged(asked.withColumn("query", F.monotonically_increasing_id()), "impact-queries")
    size = rows.agg(F.sum(F.size("vector")), F.max(F.size("vector")), F.count("*")).first()
    dims, blocks = max(1, size[1] or 0), max(1, -(-max(size[0] or 0, size[2]) // block))
    deal = F.pmod(F.xxhash64("row"), F.lit(blocks))
    both = rows.select(deal.alias("block"), F.lit(0).alias("asks"), "row", "id", "vector").unionByName(
        asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("asks"), F.col("query").alias("row"), "id", "vector")
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by block, its vectors before the queries
        at, held, index = None, [], None
        for batch in batches:
            cut = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(cut)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                here, asks = divmod(int(cut[a]), 2)
                part = batch.slice(a, b - a)
                ids, vectors = part.column(3).to_numpy(), _matrix(part.column(4), dims)
                if here != at:
                    at, held, index = here, [], None
                if not asks:
                    held.append((ids, vectors))
                    continue
                if index is None:
                    if not held:
                        continue  # a block without vectors
                    index = ImpactIndex(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held = [held[0]]
                found = [index.search(v, k + 1) for v in vectors]
                sizes = [len(x[0]) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(2).to_numpy(), sizes)), pa.array(np.concatenate([x[0] for x in found])),
                        pa.array(np.concatenate([x[1] for x in found])),
                    ],
                    names=["query", "id", "score"],
                )

    dealt = both.repartition(blocks, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(answer, "query long, id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # the query's own row is one of the rows with its id and its product with itself: the first of them goes, if it is there
    own = asked.select("query", F.col("id").alias("query_id"), "times", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("square"))
    found = found.join(own, "query")
    self_place = F.min(F.when((F.col("id") == F.col("query_id")) & (F.col("score") == F.col("square")), F.col("place"))).over(Window.partitionBy("query"))
    found = found.withColumn("self", F.coalesce(self_place, F.lit(k + 2))).where(F.col("place") != F.col("self"))
    found = found.withColumn("rank", (F.col("place") - F.when(F.col("place") > F.col("self"), 1).otherwise(0)).cast("int")).where(F.col("rank") <= k)
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    shown = [F.when(F.col(c) != NO_ID, F.col(c)).alias(n) for c, n in (("query_id", "query_id"), ("id", "vec_id"))]
    return found.select("*", repeats).select(shown[0], "rank", shown[1], "score")
