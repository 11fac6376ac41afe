"""Exact top-k inner products by a uniform threshold in three phases.

The dimensions are dealt out over ``SLICES`` lists: the local score of a vector in a list is the inner product over the
list's dimensions, and its score is the sum of its local scores. For each query:

1. every list gives its ``k`` best local scores; the k-th best full score among those vectors is a lower bound ``low``;
2. every list gives its entries of at least ``low / SLICES``, the safe cutoff: a vector that no list gives has a score
   below ``low``. Sums of the entries seen, and the cutoff for those not seen, bound each score from above;
3. vectors whose bound reaches ``low`` are scored in full, and the k best are taken.

Queries and candidates meet in blocks of at most about ``BLOCK`` rows each, so a task holds two blocks, and local scores
of ``TOGETHER`` queries at a time; cutoffs travel with the query rows. Only what can be among the k best of a block leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.shared import ship, stored

K = 10
SLICES = 4
BLOCK = 4096
#: Queries of a block whose local scores are worked out together.
TOGETHER = 256
SCALE = 1024
FOUND = "query long, query_id long, vec_id long, row long, score long"
#: Whole numbers up to here are exact in doubles, and so are their sums in any order.
EXACT = float(1 << 53)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down, as doubles; null if the vector or a component is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(table: pa.Table) -> np.ndarray:
    values = table.column("vector").combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _local(queries: np.ndarray, rows: np.ndarray, slices: int) -> np.ndarray:
    """Local scores, list by query by row; exact, or an error where doubles cannot hold them."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(queries.shape[1], 1)
    if most < EXACT:
        parts = np.array_split(np.arange(queries.shape[1]), slices)
        return np.stack([queries[:, p] @ rows[:, p].T for p in parts]).astype(np.int64)
    exact_q, exact_r = (np.array([[int(x) for x in v] for v in m], dtype=object).reshape(m.shape) for m in (queries, rows))
    found = np.stack([exact_q[:, p] @ exact_r[:, p].T for p in np.array_split(np.arange(queries.shape[1]), slices)])
    if max(map(abs, found.sum(axis=0).ravel()), default=0) >= 1 << 62 or max(map(abs, found.ravel()), default=0) >= 1 << 62:
        raise OverflowError("a score does not fit 64 bits")
    return found.astype(np.int64)


def _asked(queries: pa.Table, rows: pa.Table, slices: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each query's place and its local scores, list by row."""
    asking, near = _matrix(queries), _matrix(rows)
    for first in range(0, len(asking), TOGETHER):
        local = _local(asking[first : first + TOGETHER], near, slices)
        for at in range(local.shape[1]):
            yield first + at, local[:, at]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _result(queries: pa.Table, rows: pa.Table, found: list) -> pa.Table:
    q = np.array([x[0] for x in found], dtype=np.int64)
    r = np.array([x[1] for x in found], dtype=np.int64)
    return pa.table(
        {
            "query": queries.column("query").take(pa.array(q)),
            "query_id": queries.column("vec_id").take(pa.array(q)),
            "vec_id": rows.column("vec_id").take(pa.array(r)),
            "row": rows.column("row").take(pa.array(r)),
            "score": pa.array([x[2] for x in found], pa.int64()),
        }
    )


def _first_lists(k: int, slices: int):
    """Phase 1 in a block: vectors among the k best of a list, with their full scores."""

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if len(queries) and len(rows):
            ids, own = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            for q, local in _asked(queries, rows, slices):
                other = np.flatnonzero(ids != own[q])
                seen = {int(other[x]) for part in local for x in _best(part[other], ids[other], k)}
                found += [(q, r, int(local[:, r].sum())) for r in sorted(seen)]
        return _result(queries, rows, found)

    return meet


def _safe_entries(k: int, slices: int):
    """Phases 2 and 3 in a block: entries above the cutoff, bounds, and full scores where the bound allows."""

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if len(queries) and len(rows):
            ids, own = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            lows = queries.column("low").to_pylist()
            for q, local in _asked(queries, rows, slices):
                if lows[q] is None:  # fewer than k vectors in all
                    open_ = np.flatnonzero(ids != own[q])
                else:
                    cutoff = -(-lows[q] // slices)
                    given = local >= cutoff
                    some = np.flatnonzero(given.any(axis=0) & (ids != own[q]))
                    bound = np.where(given[:, some], local[:, some], cutoff).sum(axis=0)
                    open_ = some[bound >= lows[q]]
                scores = local[:, open_].sum(axis=0)
                found += [(q, int(open_[x]), int(scores[x])) for x in _best(scores, ids[open_], k)]
        return _result(queries, rows, found)

    return meet


def _in_blocks(queries: DataFrame, rows: DataFrame, blocks: int, query_blocks: int, meet) -> DataFrame:
    def block(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(1), key), F.lit(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", block("query", query_blocks)).withColumn("rb", every(blocks))
    right = rows.withColumn("rb", block("row", blocks)).withColumn("qb", every(query_blocks))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both come from one table
    keys = ["qb", "rb", "dims"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = K, slices: int = SLICES, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with rows of another vec_id.

    ``vectors`` has vec_id and embedding (more columns are ignored); ``queries`` tells which rows are queries. Ties go to
    the smaller vec_id, all rows are given if there are fewer than k. Rows with a null vec_id, or a vector that
    is null or holds null or non-finite components, take no part. A vector meets those of as many components. Repeated
    rows are candidates and queries of their own; a row's copies have its vec_id and so are no candidates for it.
    """
    ship(vectors.sparkSession)
    known = vectors.select(F.col("vec_id").cast("long"), whole_numbers(F.col("embedding"), scale).alias("vector"), queries.alias("asks"))
    known = known.where("vec_id IS NOT NULL AND vector IS NOT NULL").withColumn("dims", F.size("vector"))
    # tells repeated rows apart; stored, so that cutoffs meet the rows they are of whatever is run again
    rows = stored(known.withColumn("row", F.monotonically_increasing_id()))
    asking = rows.where("asks").select("vec_id", "vector", "dims", F.col("row").alias("query"))
    total, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    rows = rows.select("vec_id", "vector", "dims", "row")
    blocks, query_blocks = -(-total // block) or 1, -(-asked // block) or 1

    first = _in_blocks(asking, rows, blocks, query_blocks, _first_lists(k, slices))
    low = _ranked(first, k).where(F.col("rank") == k).select("query", F.col("score").alias("low"))
    found = _in_blocks(asking.join(low, "query", "left"), rows, blocks, query_blocks, _safe_entries(k, slices))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
