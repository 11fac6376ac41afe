"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Pieces are packed best fit, longest first, in the partition where they are made, without a shuffle. Bins that are nearly
full are done. The others are items of the next round, as long as what they hold: they meet with those of ``FAN_IN``
partitions and are packed best fit again, and so on until one partition is left. A bin that no other item can join, because even the
shortest item of the round is longer than what is left, is done too; so what reaches the last rounds is little.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.shared import checkpointed, mapped
from adtally.llm.tokenizing import TOGETHER_BYTES, encoded, load
from adtally.llm.words import chunks

CAPACITY = 2048
END_ID = 0
#: A bin with at most this much left is nearly full.
SLACK = 2
FAN_IN = 8
#: Most items that one task of a later round holds.
ITEMS_PER_TASK = 200_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Bins:
    """Bins of one partition by what is left in them; the next number is ``number``."""

    def __init__(self, number: int, capacity: int):
        self.number, self.capacity = number, capacity
        self.left: list[int] = []  # amounts that some open bin has left, sorted
        self.open: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of an item: the open bin that it leaves least room in, or a new one."""
        at = bisect_left(self.left, length)
        if at < len(self.left):
            left = self.left[at]
            number = self.open[left].pop()
            if not self.open[left]:
                del self.open[left]
                self.left.pop(at)
        else:
            left, number = self.capacity, self.number
            self.number += 1
        rest = left - length
        if rest:
            if rest not in self.open:
                self.open[rest] = []
                insort(self.left, rest)
            self.open[rest].append(number)
        return number, self.capacity - left


def best_fit(lengths: np.ndarray, number: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, packed best fit with the longest first; bins count up from ``number``."""
    bins, places = _Bins(number, capacity), np.zeros((len(lengths), 2), dtype=np.int64)
    for at in np.argsort(-lengths, kind="stable").tolist():
        places[at] = bins.place(int(lengths[at]))
    return places[:, 0], places[:, 1]


def _packed(capacity: int, level: int):
    """Pack the items of a partition: adds bin, offset, and what the bin holds in all (used)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(rows)
        if held:
            table = pa.Table.from_batches(held)
            lengths = table.column("length").to_numpy()
            bins, offsets = best_fit(lengths, 0, capacity)
            used = np.bincount(bins, lengths).astype(np.int64)[bins] if len(bins) else bins
            bins = bins + ((level << 56) | (TaskContext.get().partitionId() << 32))
            for name, values in (("bin", bins), ("offset", offsets), ("used", used)):
                table = table.append_column(name, pa.array(values))
            yield from table.to_batches(max_chunksize=50_000)

    return batches


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token ids of each document with the end id, cut into pieces of at most ``capacity``: counts and checksums."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load(tokenizer)
        for batch in rows:
            for part in chunks(batch, TOGETHER_BYTES):
                ids = encoded(library, [x or "" for x in part.column("text").to_pylist()], end_id)
                found = [
                    (doc, at // capacity, at, min(capacity, len(x) // 4 - at), zlib.crc32(x[4 * at : 4 * (at + capacity)]))
                    for doc, x in zip(part.column("doc_id").to_pylist(), ids)
                    for at in range(0, len(x) // 4, capacity)
                ]
                columns = list(zip(*found))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), batches, PIECE)


def packed(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """``items`` (with ``length``, at most ``capacity``) with ``sequence_id`` and ``offset``, gapless from 0.

    Items stay in their partition for the first round. No item is dropped or divided; an empty table gives no rows. Equal items and
    equal bins are taken as they come, so the number of sequences may differ between runs on differently dealt rows.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    first = checkpointed(mapped(items, _packed(capacity, 0), f"{kind}, bin long, offset long, used long"))
    parts, level, rounds = first.rdd.getNumPartitions(), 0, []
    bins = first.where("offset = 0").select(F.col("bin").alias("child"), F.col("used").alias("length"))
    while parts > 1:
        bins = bins.where(F.col("length") < capacity - slack)
        count, shortest = bins.agg(F.count("*"), F.min("length")).first()
        after = max(-(-parts // FAN_IN), -(-count // ITEMS_PER_TASK), 1)
        if not count or after >= parts:
            break
        level, parts = level + 1, after
        bins = bins.where(F.col("length") <= capacity - shortest).repartition(parts, F.xxhash64("child"))
        bins = checkpointed(mapped(bins, _packed(capacity, level), "child long, length long, bin long, offset long, used long"))
        rounds.append(bins.select("child", "bin", "offset"))
        bins = bins.where("offset = 0").select(F.col("bin").alias("child"), F.col("used").alias("length"))
    places = None
    for moved in reversed(rounds):
        if places is not None:
            further = places.select(F.col("child").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"))
            moved = moved.join(further, "bin", "left").select(
                "child", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")
            )
        places = moved
    rows = first.drop("used")
    if places is not None:
        places = places.select(F.col("child").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        rows = rows.join(places, "bin", "left")
        rows = rows.withColumns({"bin": F.coalesce("to", "bin"), "offset": F.col("offset") + F.coalesce("by", F.lit(0))}).drop("to", "by")
    return rows.withColumnRenamed("bin", "sequence_id")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: a row for each piece of ``docs`` (doc_id, text).

    A null or empty text is the end id alone. A null doc_id and repeated rows are packed as any other. More columns are ignored.
    """
    return packed(pieces(docs, tokenizer, capacity, end_id), capacity)
