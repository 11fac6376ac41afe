"""Removal of word passages that occur earlier in the corpus: seed and extend on winnowed anchors.

Of the ``WINDOW - GRAM + 1`` word grams in each window of ``threshold`` words, the one with the least hash
is the window's *anchor*, so equal windows have equal anchors and neighbouring windows mostly share one.
A *seed* is an anchor with the run of neighbouring windows it stands for. Seeds are joined on the anchor:

1. anchors that occur once in the corpus are left out (a count with partial sums, then a semi join);
2. seeds whose whole run of words is equal are one class; all but the first of a class lie in a repeat;
3. only where an anchor has several classes, at the ends of repeats, the first seed of each class is
   extended word by word both ways, as far as the window that holds the anchor reaches on either side.

Runs of windows that touch are put together to maximal repeats per document. No step puts out pairs, so a
passage that a third of all documents share costs one row for each document that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.shared import TEXTS_AT_ONCE, mapped, stored
from adtally.llm.words import Runs, Words, chunks, words

THRESHOLD = 20
GRAM = 6

SEED = "anchor long, run long, doc_id long, same int, first int, windows int"
RESULT = "n_words long, n_removed long, kept_sha256 string, kept string"

#: Turns a key into another one of the same equality. The join on it deals out both sides anew, so that
#: Spark can split a partition with a frequent key; next to an aggregate on the same key it could not.
_TURN = 0x5DEECE66D


def _windows(found: Words, grams: Runs, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of ``threshold`` words of one row, and where its anchor starts."""
    n = len(found)
    if n < threshold:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes = grams.of(np.arange(n - gram + 1), gram)
    windows = n - threshold + 1
    least, place = hashes[:windows].copy(), np.zeros(windows, dtype=np.int64)
    for step in range(1, threshold - gram + 1):
        here = hashes[step : step + windows]
        smaller = here <= least  # of equal ones the last
        least[smaller] = here[smaller]
        place[smaller] = step
    start = np.flatnonzero(found.row[:windows] == found.row[threshold - 1 :])
    return start, start + place[start]


def _seeds(found: Words, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of the whole run, row, first window and number of windows of each seed."""
    grams = Runs(found.hashes())
    start, anchor = _windows(found, grams, threshold, gram)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(start)))
    first = start[at]
    run = grams.of(first, count + threshold - 1) + (anchor[at] - first).astype(np.uint64) * np.uint64(0x9E3779B9)
    row = found.row[first]
    return grams.of(anchor[at], gram), run, row, first - found.first[row], count


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(kind.to_pandas_dtype()))


def seeds(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """One row per seed of ``docs`` (doc_id, same, text)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in chunks(batch):
                anchor, run, row, first, count = _seeds(words(part.column("text")), threshold, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        _column(anchor, pa.int64()),
                        _column(run, pa.int64()),
                        part.column("doc_id").take(pa.array(row)),
                        part.column("same").take(pa.array(row)),
                        _column(first, pa.int32()),
                        _column(count, pa.int32()),
                    ],
                    names=["anchor", "run", "doc_id", "same", "first", "windows"],
                )

    return mapped(docs, batches, SEED)


def _extended(docs: DataFrame, edges: DataFrame, threshold: int, gram: int) -> DataFrame:
    """One row per window of the seeds in ``edges`` (doc_id, same, seeds), with the hash of its words."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in chunks(batch):
                found = words(part.column("text"))
                grams = Runs(found.hashes())
                lists = part.column("seeds")
                flat = lists.flatten()
                row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                first = flat.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
                count = flat.field("windows").to_numpy(zero_copy_only=False).astype(np.int64)
                anchor = flat.field("anchor").to_numpy(zero_copy_only=False)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row, anchor, first = np.repeat(row, count), np.repeat(anchor, count), np.repeat(first, count) + step
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor),
                        _column(grams.of(first + found.first[row], threshold), pa.int64()),
                        part.column("doc_id").take(pa.array(row)),
                        part.column("same").take(pa.array(row)),
                        _column(first, pa.int32()),
                    ],
                    names=["anchor", "run", "doc_id", "same", "first"],
                )

    return mapped(docs.select("doc_id", "same", "text").join(edges, ["doc_id", "same"]), batches, "anchor long, run long, doc_id long, same int, first int")


def _not_first(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows other than the first of their anchor and run; ``firsts`` has a row for each of these."""
    place = F.struct("doc_id", "same", "first").alias("head")
    firsts = firsts.where("n > 1").select("anchor", F.col("run").bitwiseXOR(F.lit(_TURN)).alias("turned"), place)
    rows = rows.withColumn("turned", F.col("run").bitwiseXOR(F.lit(_TURN))).drop("run")
    return rows.join(firsts, ["anchor", "turned"]).where(F.struct("doc_id", "same", "first") != F.col("head"))


def _firsts(rows: DataFrame, *columns: str) -> DataFrame:
    """The first row of each anchor and run, and the number of its rows."""
    found = rows.groupBy("anchor", "run").agg(
        F.min(F.struct("doc_id", "same", "first", *columns)).alias("head"), F.count("*").alias("n")
    )
    return found.select("anchor", "run", "head.*", "n")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, a hash that tells texts of one doc_id apart, and more columns."""
    return docs.select(F.col("doc_id").cast("long"), F.hash("text").alias("same"), "text", *more)


def repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """Stretches of words (doc_id, same, first, last) that occur earlier and cover all repeats.

    ``docs`` is the result of ``keyed``, with doc_id in each row. Each step is written to the shared folder, so
    that its shuffle files can go before the next. Stretches may touch or overlap; ``last`` is the word behind one.
    """
    found = seeds(docs.select("doc_id", "same", "text"), threshold, gram)
    several = found.groupBy("anchor").count().where("count > 1")
    several = several.select(F.col("anchor").bitwiseXOR(F.lit(_TURN)).alias("turned"))
    found = found.select(F.col("anchor").bitwiseXOR(F.lit(_TURN)).alias("turned"), "run", "doc_id", "same", "first", "windows")
    found = found.join(several, "turned", "left_semi")
    found = stored(found.select(F.col("turned").bitwiseXOR(F.lit(_TURN)).alias("anchor"), "run", "doc_id", "same", "first", "windows"), TEXTS_AT_ONCE)

    classes = stored(_firsts(found, "windows"))
    whole = _not_first(found, classes).select("doc_id", "same", "first", (F.col("first") + F.col("windows") + threshold - 1).alias("last"))
    whole = stored(whole)

    edges = classes.groupBy("anchor").count().where("count > 1")
    edges = edges.select(F.col("anchor").bitwiseXOR(F.lit(_TURN)).alias("turned"))
    heads = classes.withColumn("turned", F.col("anchor").bitwiseXOR(F.lit(_TURN))).join(edges, "turned", "left_semi")
    lists = heads.groupBy("doc_id", "same").agg(F.collect_list(F.struct("anchor", "first", "windows")).alias("seeds"))
    windows = stored(_extended(docs, lists, threshold, gram), TEXTS_AT_ONCE)
    single = _not_first(windows, _firsts(windows)).select("doc_id", "same", "first", (F.col("first") + threshold).alias("last"))
    return whole.unionAll(stored(single))


def _kept(texts: bool):
    """Counts, digest and text of the words outside the spans; texts without spans stay as they are."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in chunks(batch):
                found = words(part.column("text"))
                lists = part.column("spans")
                row = np.repeat(np.arange(len(part)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                level = np.zeros(len(found) + 1, dtype=np.int64)
                np.add.at(level, found.first[row] + flat.field("first").to_numpy(zero_copy_only=False), 1)
                np.add.at(level, found.first[row] + flat.field("last").to_numpy(zero_copy_only=False), -1)
                keep = np.cumsum(level)[:-1] == 0
                data, own = found.data.tobytes(), part.column("text")
                result: list[list] = [[], [], [], []]
                for at in range(len(part)):
                    a, b = found.first[at], found.first[at + 1]
                    chosen = np.flatnonzero(keep[a:b]) + a
                    text = b" ".join([data[s:e] for s, e in zip(found.starts[chosen].tolist(), found.ends[chosen].tolist())])
                    left = None if not texts else text.decode() if len(chosen) < b - a else own[at].as_py()
                    for column, value in zip(result, (b - a, b - a - len(chosen), hashlib.sha256(text).hexdigest(), left)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                others = [c for c in part.schema.names if c not in ("text", "spans")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), *(pa.array(c, k) for c, k in zip(result, kinds))],
                    names=[*others, "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return batches


def substring_dedup(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, texts: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """Words of each document that remain when repeated passages of ``threshold`` words or more go.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one space), kept, the columns named in ``more``, and
    same (a hash of the text): a row for each row of ``docs`` (doc_id, text; other columns are ignored). ``kept`` is
    null unless ``texts`` are asked for; then it is the words left, or the text as it is if all are.

    A word goes if a window of ``threshold`` words that covers it starts earlier too: in a smaller doc_id, or
    earlier in the same document. A null or empty text has no words. Rows without doc_id have no place in the order:
    they keep all words and remove none. Texts that share a doc_id are ordered by ``same``; rows that repeat both are
    one document, each with the same result. Hashes have 64 bits, of the anchor and of the run each.
    """
    known = keyed(docs, *more)
    placed, rest = known.where("doc_id IS NOT NULL"), known.where("doc_id IS NULL")
    spans = repeats(placed, threshold, gram)
    spans = spans.groupBy("doc_id", "same").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rest = rest.withColumn("spans", F.lit(None).cast("array<struct<first:int,last:int>>"))
    joined = placed.join(spans, ["doc_id", "same"], "left").unionByName(rest)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("text", "spans").schema.fields)
    return mapped(joined, _kept(texts), f"{kind}, {RESULT}")
