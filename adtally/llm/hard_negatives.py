"""Hard negatives by exact whole-number products in residues.

Components become whole numbers. A block of anchors meets a block of rows in a task, where their products are taken modulo several
small primes: residues lie around zero and are multiplied as float32 matrices, a stretch of dimensions at a time that
float32 sums exactly. The Chinese remainder theorem gives the signed scores back; there are as many primes as the longest
vectors of the two blocks need.

Two rounds: anchors meet the rows of their own label, which gives each anchor its positives; then all rows of other
labels, of which the best inside each positive's window are taken. Only what can be among the best of a block leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.shared import ship
from adtally.llm.topk_search import whole_numbers

POSITIVES = 5
NEGATIVES = 10
SCALE = 256
#: A negative's score is between these shares, in hundredths, of its positive's score.
LOWEST, HIGHEST = 30, 90
ANCHOR_BLOCK, ROW_BLOCK = 2048, 8192
#: Anchors of a block whose scores a task holds at once.
TOGETHER = 256
#: Dimensions whose products of residues are summed in float32, which is exact below 2**24.
STRETCH = 256
_FLOAT32_EXACT = 1 << 24
#: Scores have to fit 64 bits; a share of one in hundredths is taken with Python's numbers.
_MOST = 1 << 63
POSITIVE = "anchor long, anchor_id long, positive_id long, score long"
NEGATIVE = "anchor long, anchor_id long, positive_id long, place int, negative_id long, positive_score long, score long"


@lru_cache(maxsize=64)
def primes(dims: int, bound: int) -> tuple[int, ...]:
    """Largest primes whose residues float32 multiplies exactly over ``dims``, with a product above twice ``bound``."""
    half = math.isqrt((_FLOAT32_EXACT - 1) // max(min(dims, STRETCH), 1))
    found, product, n = [], 1, 2 * half + 1
    while product <= 2 * bound:
        if n < 3:
            raise OverflowError("too few small primes for scores of this size")
        if all(n % k for k in range(2, math.isqrt(n) + 1)):
            found.append(n)
            product *= n
        n -= 2
    return tuple(found)


def residues(numbers: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo ``p``, from -p//2 to p//2, as float32; exact for doubles of any size."""
    found = np.fmod(numbers, p)
    found[found > p // 2] -= p
    found[found < -(p // 2)] += p
    return found.astype(np.float32)


def _modular_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo ``p`` of residues, from 0 to p - 1."""
    total = np.zeros((len(a), len(b)), dtype=np.int64)
    for start in range(0, a.shape[1], STRETCH):
        part = a[:, start : start + STRETCH] @ b[:, start : start + STRETCH].T
        total += part.astype(np.int64)
    return np.mod(total, p)


def _reconstructed(parts: list[np.ndarray], moduli: tuple[int, ...]) -> np.ndarray:
    """Signed whole numbers from their residues, digit by digit in the mixed radix of the moduli."""
    product = math.prod(moduli)
    wide = product >= _MOST
    value, radix = parts[0].astype(object) if wide else parts[0].copy(), moduli[0]
    for part, p in zip(parts[1:], moduli[1:]):
        digit = (part - value % p) * pow(radix, -1, p) % p
        value = value + digit * radix
        radix *= p
    value[value > product // 2] -= product
    if wide:
        if len(value) and not all(-_MOST <= x < _MOST for x in value.ravel()):
            raise OverflowError("a score does not fit 64 bits")
        value = value.astype(np.int64)
    return value


class Rows:
    """A matrix of whole numbers with its residues by each prime, worked out once."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.by_prime = numbers, {}
        self.longest = float(np.sqrt((numbers**2).sum(axis=1)).max(initial=0))

    def residues(self, p: int) -> np.ndarray:
        if p not in self.by_prime:
            self.by_prime[p] = residues(self.numbers, p)
        return self.by_prime[p]


def products(a: Rows, b: Rows) -> Iterator[tuple[int, np.ndarray]]:
    """Exact inner products of rows of ``a`` with those of ``b``, ``TOGETHER`` rows of ``a`` at a time with the first of them."""
    # lengths of vectors bound their product; the share added covers the rounding of the lengths
    bound = int(a.longest * b.longest * (1 + 1e-9)) + 1
    moduli = primes(a.numbers.shape[1], bound)
    for start in range(0, len(a.numbers), TOGETHER):
        own = slice(start, start + TOGETHER)
        yield start, _reconstructed([_modular_product(a.residues(p)[own], b.residues(p), p) for p in moduli], moduli)


def _matrix(table: pa.Table, at: np.ndarray | None = None) -> np.ndarray:
    values = table.column("vector").combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    found = flat.reshape(len(table), len(flat) // len(table))
    return found if at is None else found[at]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _table(columns: dict[str, list[np.ndarray]], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array(np.concatenate(columns[name]) if columns[name] else [], kind) for name, kind in schema})


def _positives(k: int):
    """In a block: the k best rows of each anchor's own label."""

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = [("anchor", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())]
        found = {name: [] for name, _ in names}
        if len(anchors) and len(rows):
            labels, own, ids = _column(rows, "label"), _column(anchors, "vec_id"), _column(rows, "vec_id")
            keys, wanted = _column(anchors, "anchor"), _column(anchors, "label")
            for label in np.unique(wanted):
                a, b = np.flatnonzero(wanted == label), np.flatnonzero(labels == label)
                for start, scores in products(Rows(_matrix(anchors, a)), Rows(_matrix(rows, b))):
                    for line, at in zip(scores, a[start : start + TOGETHER]):
                        other = np.flatnonzero(ids[b] != own[at])
                        best = other[_best(line[other], ids[b][other], k)]
                        found["anchor"].append(np.full(len(best), keys[at]))
                        found["anchor_id"].append(np.full(len(best), own[at]))
                        found["positive_id"].append(ids[b][best])
                        found["score"].append(line[best])
        return _table(found, names)

    return meet


def _negatives(k: int, lowest: int, highest: int):
    """In a block: the k best rows of other labels in the window of each positive of an anchor."""

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        long, names = pa.int64(), ("anchor", "anchor_id", "positive_id", "place", "negative_id", "positive_score", "score")
        found = {name: [] for name in names}
        if len(anchors) and len(rows):
            labels, ids = _column(rows, "label"), _column(rows, "vec_id")
            keys, own, wanted = _column(anchors, "anchor"), _column(anchors, "vec_id"), _column(anchors, "label")
            positives = anchors.column("positives").to_pylist()
            for start, scores in products(Rows(_matrix(anchors)), Rows(_matrix(rows))):
                for at, line in enumerate(scores, start):
                    apart = labels != wanted[at]
                    for positive in positives[at]:
                        score = positive["score"]
                        inside = (line >= -(-lowest * score // 100)) & (line <= highest * score // 100)
                        near = np.flatnonzero(apart & inside)
                        best = near[_best(line[near], ids[near], k)]
                        same = (keys[at], own[at], positive["positive_id"], positive["place"])
                        for name, value in zip(names, (*same, ids[best], score, line[best])):
                            found[name].append(value if isinstance(value, np.ndarray) else np.full(len(best), value))
        return _table(found, [(name, pa.int32() if name == "place" else long) for name in names])

    return meet


def _in_blocks(anchors: DataFrame, rows: DataFrame, blocks: int, anchor_blocks: int, meet, schema: str) -> DataFrame:
    """Each block of anchors with each block of rows; ``rows`` has its block already."""

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("ab", F.pmod(F.xxhash64("anchor"), F.lit(anchor_blocks)).cast("int")).withColumn("rb", every(blocks))
    right = rows.withColumn("ab", every(anchor_blocks))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both come from one table
    keys = ["ab", "rb", "dims"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def _first(found: DataFrame, keys: list[str], by: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), by)
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: int = SCALE,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    anchor_block: int = ANCHOR_BLOCK,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    ``vectors`` has vec_id, embedding and label (more columns are ignored); ``anchors`` tells which rows are anchors. A score is
    the inner product of whole numbers, components times ``scale`` rounded down. An anchor's positives are the best rows of its
    label with another vec_id; a positive's negatives are the best rows of other labels with ``lowest`` to ``highest``
    hundredths of its score. Ties go to the smaller vec_id, and all rows are given if there are fewer.

    Rows with a null vec_id or label, or a vector that is null or holds null or non-finite components, take no
    part. A vector meets those of as many components. Rows that repeat all of vec_id, label and vector are one anchor, but each
    is a positive or negative of its own; so are different rows of one vec_id. An anchor without positives, or a positive
    without rows in its window, gives no row, and so does an empty table.
    """
    ship(vectors.sparkSession)
    known = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), whole_numbers(F.col("embedding"), scale).alias("vector"), anchors.alias("asks")
    )
    known = known.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").withColumn("dims", F.size("vector"))
    # a row of one anchor or of many copies: both sides are told apart by their values, so it is the same if a task is run again
    asking = known.where("asks").select("vec_id", "label", "vector", "dims").distinct()
    asking = asking.withColumn("anchor", F.xxhash64("vec_id", "label", "vector"))
    total, asked = known.agg(F.count("*"), F.count_if("asks")).first()
    blocks, anchor_blocks = -(-total // row_block) or 1, -(-asked // anchor_block) or 1
    # rows are dealt out in turn, so copies of a row do not meet in one block
    rows = known.select("vec_id", "label", "vector", "dims").repartition(blocks).withColumn("rb", F.spark_partition_id())

    found = _in_blocks(asking, rows, blocks, anchor_blocks, _positives(positives), POSITIVE)
    found = _first(found, ["anchor"], "positive_id", positives)
    chosen = found.groupBy("anchor").agg(F.collect_list(F.struct("positive_id", F.col("rank").alias("place"), "score")).alias("positives"))
    found = _in_blocks(asking.join(chosen, "anchor"), rows, blocks, anchor_blocks, _negatives(negatives, lowest, highest), NEGATIVE)
    found = _first(found, ["anchor", "place"], "negative_id", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
