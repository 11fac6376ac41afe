"""Collocations: phrases of words scored by how they are put together, counted in suffix subtrees.

A suffix starts at a word and goes on for ``LONGEST`` words of its piece at most, and no further than pairs of neighbouring words that
are frequent, since no frequent phrase goes further. Equal suffixes are put together with their count before anything is
shuffled.

Suffixes are partitioned vertically, by prefixes of words: prefixes fall into ``BUCKETS`` buckets, and suffixes put out together with
prefixes of one bucket are a fragment, which is one row. Neighbouring buckets make up a group as long as their suffixes fit the
memory budget of a task. Fragments of a bucket above the budget are divided by prefixes with one word more. Each group is one
task's: it sorts its suffixes, builds the subtree of their words level by level, cut at ``LONGEST``, and reads the count of each node
from the totals of the leaves below.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.shared import TEXTS_AT_ONCE, mapped, step, stored
from adtally.llm.words import Words, chunks, mixed, words

LONGEST = 5
LEAST = 100
FIRST = 2000
#: Suffixes that a task builds a subtree from, and buckets of prefixes of each length.
BUDGET, BUCKETS = 1 << 18, 1 << 12
#: Bits that tell which hashes may be frequent; a hash too many costs time only.
BITS = 1 << 26
#: Different hashes of a task that are held before they are put out; up to twice as many rows wait to be put together.
HELD = 1 << 17
#: Suffixes that are put out at once.
SENT = 1 << 15
UNKNOWN = "und"
FRAGMENTS = "bucket int, length int, suffixes long, content binary"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STOPS = np.frombuffer(b".,;:!?", dtype=np.uint8)


def _languages(batch: pa.RecordBatch) -> list[str]:
    return [UNKNOWN if x is None else x for x in batch.column("lang").to_pylist()]


def _pieces(batch: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    """Words of all texts with A-Z in lower case, and the number of each word's piece."""
    texts = batch.column("text").cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].copy()
    data[(data >= 65) & (data <= 90)] += 32
    stop = np.isin(data, _STOPS) | ((data >= 0x0A) & (data <= 0x0D))
    data[stop] = 0x0A
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data.tobytes()))
    found = words(plain)
    return found, np.cumsum(stop)[found.starts] if len(found) else np.zeros(0, np.int64)


def _hashes(found: Words, languages: list[str]) -> np.ndarray:
    """A hash of each word and the language of its text."""
    seeds = {x: np.uint64(xxhash.xxh64_intdigest(x.encode())) for x in set(languages)}
    by_row = np.array([seeds[x] for x in languages], dtype=np.uint64)
    return mixed(found.hashes() ^ by_row[found.row])


def run_key(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of a run of words from the words' hashes; that of one word is its own."""
    key = parts[0]
    for part in parts[1:]:
        key = mixed(key * _FACTOR + part)
    return key


def _may_be(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(BITS - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bits(frequent: DataFrame, column: str) -> np.ndarray:
    """A bit for each place of a hash that is among the frequent ones; BITS / 8 bytes, however many there are."""
    place = F.col(column).bitwiseAND(F.lit(BITS - 1)) + 1  # the functions count from one
    rows = frequent.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    found = np.zeros(BITS // 8, dtype=np.uint8)
    with step(rows.sparkSession, TEXTS_AT_ONCE):
        rows = rows.collect()
    for row in rows:
        start = (row["at"] - 1) * 4096
        found[start : start + 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return found


class _Counts:
    """Counts of hashes of a task, with values of one occurrence of each."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, hashes: np.ndarray, *values: np.ndarray, counts: np.ndarray | None = None) -> None:
        hashes, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.bincount(back, counts, minlength=len(hashes)).astype(np.int64)
        self.parts.append((hashes, counts, *(v[first] for v in values)))
        self.rows += len(hashes)

    def put_together(self) -> tuple:
        if len(self.parts) > 1:
            hashes, counts, *values = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, self.rows = [], 0
            self.add(hashes, *values, counts=counts)
        return self.parts[0]

    def full(self) -> bool:
        """Whether there are too many different hashes to hold."""
        if self.rows < 2 * HELD:
            return False
        self.put_together()
        return self.rows > HELD

    def taken(self) -> tuple | None:
        found = self.put_together() if self.parts else None
        self.parts, self.rows = [], 0
        return found


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h, n): how often each word occurs in each language; h is a hash of both."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()

        def out() -> pa.RecordBatch:
            hashes, counts, langs, spelled = held.taken() or (np.zeros(0, np.uint64), np.zeros(0, np.int64), [], [])
            columns = [pa.array(langs, pa.string()), pa.array(spelled, pa.string()), pa.array(hashes.view(np.int64)), pa.array(counts)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "h", "n"])

        for batch in rows:
            for part in chunks(batch):
                found, _ = _pieces(part)
                languages = np.array(_languages(part), dtype=object)
                hashes, first, back = np.unique(_hashes(found, languages.tolist()), return_index=True, return_inverse=True)
                data = found.data.tobytes()
                spans = zip(found.starts[first].tolist(), found.ends[first].tolist())
                spelled = np.array([data[a:b].decode() for a, b in spans] + [None], dtype=object)[:-1]
                held.add(hashes, languages[found.row[first]], spelled, counts=np.bincount(back, minlength=len(hashes)))
            if held.full():
                yield out()
        yield out()

    rows = mapped(docs.select("text", "lang"), batches, "lang string, word string, h long, n long")
    return rows.groupBy("h").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n"))


def _pairs(found: Words, piece: np.ndarray, hashes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that are followed by another in their piece, where both may be frequent, and hashes of the two."""
    likely = _may_be(frequent, hashes)
    both = likely[:-1] & likely[1:] & (piece[:-1] == piece[1:]) & (found.row[:-1] == found.row[1:])
    at = np.flatnonzero(both)
    return at, run_key([hashes[at], hashes[at + 1]])


def pair_counts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(h, n): how often each pair of neighbouring words occurs of which both may be frequent."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()

        def out() -> pa.RecordBatch:
            hashes, counts = held.taken() or (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["h", "n"])

        for batch in rows:
            for part in chunks(batch):
                found, piece = _pieces(part)
                held.add(_pairs(found, piece, _hashes(found, _languages(part)), frequent)[1])
            if held.full():
                yield out()
        yield out()

    return mapped(docs.select("text", "lang"), batches, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _fragments(suffix: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Suffixes, each with depth and count behind its words, as a row for each bucket of their first ``length`` words."""
    bucket = (run_key(list(suffix[:, :length].T)) & np.uint64(BUCKETS - 1)).astype(np.int32)
    order = np.lexsort((*suffix[:, LONGEST - 1 :: -1].T, bucket))
    bucket = bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(bucket))
    # rows are put out together as long as they begin in the same stretch of suffixes
    first = np.flatnonzero(np.diff(starts // SENT, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(starts)]):
        content = [suffix[order[x:y]].tobytes() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]
        columns = [pa.array(bucket[starts[a:b]]), pa.array(np.full(b - a, length, np.int32)), pa.array(ends[a:b] - starts[a:b]), pa.array(content, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "length", "suffixes", "content"])


def _suffixes(content: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(content), dtype=np.uint64).reshape(-1, LONGEST + 2)


def suffixes(docs: DataFrame, frequent: np.ndarray, frequent_pairs: np.ndarray) -> DataFrame:
    """Fragments of the different suffixes of two words at least with their counts, as hashes of their words, zero behind the last."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()

        def out() -> Iterator[pa.RecordBatch]:
            if found := held.taken():
                _, counts, suffix = found
                yield from _fragments(np.concatenate([suffix, counts.astype(np.uint64)[:, None]], axis=1), 1)

        for batch in rows:
            for part in chunks(batch):
                found, piece = _pieces(part)
                hashes = _hashes(found, _languages(part))
                at, pairs = _pairs(found, piece, hashes, frequent)
                at = at[_may_be(frequent_pairs, pairs)]
                goes_on = np.zeros(len(hashes) + LONGEST, dtype=bool)
                goes_on[at] = True
                depth, more = np.full(len(at), 2), np.ones(len(at), dtype=bool)
                for k in range(1, LONGEST - 1):
                    more &= goes_on[at + k]
                    depth += more
                padded = np.append(hashes, np.zeros(LONGEST, np.uint64))
                columns = [np.where(depth > k, padded[at + k], np.uint64(0)) for k in range(LONGEST)] + [depth.astype(np.uint64)]
                held.add(run_key(columns), np.stack(columns, axis=1))
            if held.full():
                yield from out()
        yield from out()

    return mapped(docs.select("text", "lang"), batches, FRAGMENTS)


def _longer(length: int):
    """Fragments divided by prefixes of this length, many of them together, as each would make a row for almost each of its suffixes."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows:
            for content in batch.column("content").to_pylist():
                held.append(content)
                size += len(content)
                if size >= HELD * 8 * (LONGEST + 2):
                    yield from _fragments(_suffixes(held), length)
                    held, size = [], 0
        if held:
            yield from _fragments(_suffixes(held), length)

    return batches


def partitioned(rows: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, int]:
    """Fragments with their group, and the number of groups.

    The driver sees how many suffixes are in each bucket, ``BUCKETS`` numbers at most for each length of prefixes.
    """
    groups, found = 0, []
    for length in range(1, LONGEST + 1):
        plan, held = [], budget
        for bucket, count in rows.groupBy("bucket").agg(F.sum("suffixes")).orderBy("bucket").collect():
            if count > budget and length < LONGEST:
                plan.append((bucket, None))
                continue
            if held + count > budget:
                groups, held = groups + 1, 0
            held += count
            plan.append((bucket, groups - 1))
        # a row for each bucket, of which there are BUCKETS at most
        planned = rows.join(F.broadcast(rows.sparkSession.createDataFrame(plan, "bucket int, `group` int")), "bucket")
        found.append(planned.where("`group` IS NOT NULL").select("group", "length", "content"))
        if all(group is not None for _, group in plan):
            break
        rows = stored(mapped(planned.where("`group` IS NULL").select("content"), _longer(length + 1), FRAGMENTS), TEXTS_AT_ONCE)
    return reduce(DataFrame.unionByName, found), max(groups, 1)


class Subtree:
    """The subtree of sorted suffixes: for each level its nodes, with parent, first leaf, and the total of the leaves below."""

    def __init__(self, suffix: np.ndarray, depth: np.ndarray, counts: np.ndarray):
        self.suffix = suffix
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        new = np.zeros(len(suffix), dtype=bool)
        new[:1] = True
        above = np.zeros(len(suffix), dtype=np.int64)
        for k in range(suffix.shape[1]):
            new[1:] |= suffix[1:, k] != suffix[:-1, k]
            inside = depth > k  # leaves that are shallower end above this level
            leaves = np.flatnonzero(inside)
            node = np.cumsum(new[leaves] | (np.diff(leaves, prepend=-2) > 1)) - 1
            first = np.flatnonzero(np.diff(node, prepend=-1))
            totals = np.add.reduceat(counts[leaves], first) if len(leaves) else counts[:0]
            self.levels.append((above[leaves[first]], leaves[first], totals))
            above = np.zeros(len(suffix), dtype=np.int64)
            above[leaves] = node

    def nodes(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of the nodes at a level, from 1, and their counts."""
        _, first, totals = self.levels[level - 1]
        return self.suffix[first, :level], totals


def _counted(least: int):
    """Nodes of each group's subtree as phrases; those above the group's prefixes have a part of their count only."""

    def phrases(content: list[bytes], length: int) -> pa.RecordBatch:
        rows = _suffixes(content)
        rows = rows[np.lexsort(rows[:, LONGEST - 1 :: -1].T)]
        tree = Subtree(rows[:, :LONGEST], rows[:, LONGEST].astype(np.int64), rows[:, LONGEST + 1].astype(np.int64))
        keys, runs, totals = [], [], []
        for level in range(2, LONGEST + 1):
            found, total = tree.nodes(level)
            if level >= length:
                found, total = found[total >= least], total[total >= least]
            keys.append(run_key(list(found.T)))
            runs += found.view(np.int64).tolist()
            totals.append(total)
        keys, totals = np.concatenate(keys).view(np.int64), np.concatenate(totals)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(runs, pa.list_(pa.int64())), pa.array(totals)], names=["phrase_key", "run", "a"])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in rows:
            for group, length, content in zip(*(batch.column(c).to_pylist() for c in ("group", "length", "content"))):
                if (group, length) != at and held:
                    yield phrases(held, at[1])
                    held = []
                at = (group, length)
                held.append(content)
        if held:
            yield phrases(held, at[1])

    return batches


def phrase_counts(rows: DataFrame, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(phrase_key, run, a): phrases of 2 to ``LONGEST`` words that occur ``least`` times, with their words' hashes."""
    rows, groups = partitioned(rows, budget)
    grouped = rows.repartitionByRange(groups, "group").sortWithinPartitions("group", "length")
    nodes = mapped(grouped, _counted(least), "phrase_key long, run array<long>, a long")
    return nodes.groupBy("phrase_key").agg(F.first("run").alias("run"), F.sum("a").alias("a")).where(F.col("a") >= least)


def _with_parts(candidates: DataFrame) -> DataFrame:
    """(phrase_key, k, left_key, right_key): each candidate cut after its first k words."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys, runs = batch.column("phrase_key").to_numpy(), batch.column("run").to_pylist()
            size = np.array([len(r) for r in runs], dtype=np.int64)
            parts = []
            for m in range(2, LONGEST + 1):
                some = np.flatnonzero(size == m)
                run = np.array([runs[i] for i in some], dtype=np.int64).reshape(-1, m).view(np.uint64)
                for k in range(1, m):
                    parts.append((keys[some], np.full(len(some), k), run_key(list(run[:, :k].T)), run_key(list(run[:, k:].T))))
            key, k, left, right = (np.concatenate(x) for x in zip(*parts))
            arrays = [pa.array(key), pa.array(k, pa.int32()), pa.array(left.view(np.int64)), pa.array(right.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["phrase_key", "k", "left_key", "right_key"])

    return mapped(candidates, batches, "phrase_key long, k int, left_key long, right_key long")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` best phrases of each language.

    ``docs`` has text and lang (more columns are ignored); a null lang is ``und``, a null text is empty. A-Z count as small
    letters; texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs. A candidate
    has 2 to ``LONGEST`` words in one piece and occurs ``least`` times in its language, ``a`` times in all. Cut into two parts, which
    occur ``l`` and ``r`` times, it scores floor(1000 * a * n / (l * r)) where n is the number of words of the language; the
    cut with the lowest score counts, the first of equal ones. Candidates inside a longer phrase that occurs as often are
    dropped. Order: score, then a, from high to low, then phrase by its bytes. Repeated rows count as often as they are there; an empty
    table gives no rows.
    """
    counts = stored(word_counts(docs), TEXTS_AT_ONCE)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = stored(counts.where(F.col("n") >= least))
    likely = _bits(frequent, "h")
    pairs = pair_counts(docs, likely).where(F.col("n") >= least)
    rows = stored(suffixes(docs, likely, _bits(pairs, "h")), TEXTS_AT_ONCE)
    candidates = stored(phrase_counts(rows, least, budget), TEXTS_AT_ONCE)

    # the longer phrase with one word more at either end is a candidate too, and no longer one occurs more often
    cuts = stored(_with_parts(candidates.select("phrase_key", "run")))
    known = candidates.select(F.col("phrase_key").alias("key"), F.col("a").alias("f")).unionByName(frequent.select(F.col("h").alias("key"), F.col("n").alias("f")))
    size = candidates.select("phrase_key", "a", F.size("run").alias("size"))
    parts = cuts.join(size, "phrase_key")
    ends = parts.where("k = 1").select(F.col("right_key").alias("inner"), "a").unionAll(parts.where("k = size - 1").select("left_key", "a"))
    covered = ends.groupBy("inner").agg(F.max("a").alias("most"))
    left = candidates.join(covered, F.col("phrase_key") == F.col("inner"), "left").where("most IS NULL OR most < a").select("phrase_key", "run", "a")

    cut = cuts.join(left.select("phrase_key", "a"), "phrase_key")
    cut = cut.join(known.select(F.col("key").alias("left_key"), F.col("f").alias("l")), "left_key")
    cut = cut.join(known.select(F.col("key").alias("right_key"), F.col("f").alias("r")), "right_key")
    spelled = left.select("phrase_key", F.posexplode("run").alias("at", "h")).join(frequent.select("h", "lang", "word"), "h")
    spelled = spelled.groupBy("phrase_key").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    langs = spelled.join(totals, "lang")
    scored = cut.join(langs, "phrase_key")
    wide = {c: f"cast({c} AS decimal(20,0))" for c in "alrn"}
    score = F.expr(f"cast(1000 * {wide['a']} * {wide['n']} AS decimal(38,0)) div cast({wide['l']} * {wide['r']} AS decimal(38,0))")
    best = scored.withColumn("score", score).groupBy("phrase_key").agg(F.min(F.struct("score", "k", "lang", "phrase", "a", "l", "r", "n")).alias("x")).select("x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return found.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
