"""Texts with similar sets of word shingles, by T-occurrence search with DivideSkip.

A text's set holds hashes of its different shingles; equal sets are one node. Two sets of a Jaccard similarity of at
least ``share`` have an overlap of at least T = share * size of either. With the shingles of all texts in one order, common ones
last, the first ``size - T + m`` of their shingles, the keys, have m in common. So a node with fewer keys that another node of a
fitting size has too is linked with nothing and goes no further.

The others that share a key go to the cell of the least node of that key; a node leaves out the cells with the fewest of its keys
as long as a similar node meets it in another one. First only parity sketches go there, a bit or two for each shingle: two sets
differ in at least as many shingles as their sketches in bits. Nodes without another one that is near enough by this leave the
cell, the others are sent their whole sets. A cell has an inverted index:
of each shingle the list of nodes with it. For a node that asks, its lists are divided: the longest are set
aside, the short ones are merged through a heap, and nodes that the merge finds often enough are probed by binary search in
the long ones. A node is linked if the overlap counted in this way reaches what the sizes ask for.

A cell above ``PART`` shingles is dealt out in parts, each with the cell's least node. What a first round in the parts
leaves outside the cell's main component asks in all other parts in a second round, so no part or pair of parts is above its size and
no pair of a cell is left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.components import components
from adtally.llm.shared import forget, mapped, stored
from adtally.llm.words import Runs, chunks, mixed, words

SHINGLE = 3
#: Hundredths of the union that two sets have in common at least.
SHARE = 90
#: Keys that two similar sets have in common at least, in hundredths of the size; with more, fewer nodes go on.
SHARED_KEYS = 5
#: Nodes of a cell whose sketches are compared; a cell with more keeps them all.
COMPARED = 256
#: Shingles of a part of a cell.
PART = 1 << 20
#: Shingles whose order is by how often they occur: those seen most, at least twice in the same batch of texts.
COMMON, OFTEN = 1 << 17, 16
#: Weight of a long list in the choice of how many to set aside.
_MU = 0.0085
#: Bound of the buckets of rows that are sent to all executors.
BUCKETS = 1 << 20
_TURN = 0x5DEECE66D


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each row, ascending, and their number; A-Z count as small letters."""
    found = words(texts)
    data = found.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    hashes, rows = replace(found, data=data).hashes(), len(texts)
    counts = np.diff(found.first)
    shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    row = np.repeat(np.arange(rows), shingles)
    first = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + np.repeat(found.first[:-1], shingles)
    length = np.minimum(size, found.first[1:][row] - first)
    hashes = Runs(hashes).of(first, length)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=rows)


def _nodes(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each row's set of shingles."""
    sums = np.zeros(len(count), dtype=np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        sums[some] = np.add.reduceat(mixed(hashes), (np.cumsum(count) - count)[some])
    return mixed(sums + count.astype(np.uint64)).view(np.int64)


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(values.view(np.int64)))


def _sketches(hashes: np.ndarray, count: np.ndarray) -> pa.Array:
    """Of each row bits for its hashes, a power of two of at least twice as many; each tells if an odd number of hashes falls on it."""
    size = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * count, 1))).astype(np.int64))
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(count)), count)
    place = start[row] + (hashes & (size[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=int(size.sum())) & 1
    bits = np.packbits(odd.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(np.append(0, np.cumsum(size // 8)).astype(np.int32)), pa.py_buffer(bits)])


def _differences(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _near(share: int):
    """Rows (cell, node, n) of nodes that have another one in their cell that may be similar by its sketch."""

    def staying(held: list[tuple]) -> list[tuple]:
        sketches, stays = [np.frombuffer(x[3], dtype=np.uint64) for x in held], [False] * len(held)
        for i, (_, _, n, _) in enumerate(held):
            for j in range(i - 1, -1, -1):
                if 100 * held[j][2] < share * n:
                    break
                if not (stays[i] and stays[j]) and (100 + share) * _differences(sketches[i], sketches[j]) <= (100 - share) * (n + held[j][2]):
                    stays[i] = stays[j] = True
        return [x[:3] for x, stay in zip(held, stays) if stay]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in rows:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "n", "sketch"))):
                if row[0] != cell:
                    found += staying(held)
                    held, cell = [], row[0]
                held.append(row)
            yield members(found)
        yield members(staying(held))

    return batches


def members(rows: list[tuple]) -> pa.RecordBatch:
    columns = np.array(rows, dtype=np.int64).reshape(-1, 3).T
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "node", "n"])


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("same"), "text")


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``COMMON`` most frequent shingles, ascending, and how often they were seen, over all texts.

    A shingle is counted where it is in at least two texts of a batch. The counts only set the order of shingles, so
    what is found does not depend on them.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            parts = [shingle_sets(part.column("text"), size)[0] for part in chunks(batch)]
            shingle, seen = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            often = seen > 1
            yield pa.RecordBatch.from_arrays([pa.array(shingle[often].view(np.int64)), pa.array(seen[often])], names=["shingle", "seen"])

    counts = mapped(docs.select("text"), batches, "shingle long, seen long").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    found = stored(counts.where(F.col("seen") >= OFTEN).orderBy(F.desc("seen"), "shingle").limit(COMMON))
    rows = found.toArrow()
    shingle = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], rows.column("seen").to_numpy()[order]


def _required(share: int, size: np.ndarray | int):
    """The least overlap of a set of this size with one that is similar to it."""
    return -(-share * size // 100)


def _shared_keys(size):
    """Keys in common with a set of this size; one of each kind that is similar has as many at least as its required overlap says."""
    return np.maximum(SHARED_KEYS * size // 100, 1)


def _keyed(docs: DataFrame, size: int, share: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, same, node, n, least, keys, sketch) of each row: hash of the text, hash and size of its set, shared keys asked for, keys, sketch."""
    frequent, seen = common

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in chunks(batch):
                hashes, count = shingle_sets(part.column("text"), size)
                row = np.repeat(np.arange(len(part)), count)
                weight = np.zeros(len(hashes), dtype=np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                    weight = np.where(frequent[at] == hashes, seen[at], 0)
                order = np.lexsort((hashes, weight, row))
                most = np.where(count > 0, count - _required(share, count) + _shared_keys(count), 0)
                least = _shared_keys(_required(share, count))
                first = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count) < np.repeat(most, count)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("same"), pa.array(_nodes(hashes, count)), pa.array(count, pa.int64()), pa.array(least), _lists(hashes[order][first], most), _sketches(hashes, count)],
                    names=["doc_id", "same", "node", "n", "least", "keys", "sketch"],
                )

    return mapped(_placed(docs), batches, "doc_id long, same long, node long, n long, least long, keys array<long>, sketch binary")


def _sets(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the rows ``chosen`` (doc_id, same), which are one row for each node."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in chunks(batch):
                hashes, count = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(hashes, count)), _lists(hashes, count)], names=["node", "shingles"])

    bucket = F.pmod(F.xxhash64("doc_id", "same"), F.lit(BUCKETS)).alias("bucket")
    # texts that share a bucket with no chosen one are not shuffled; there are BUCKETS numbers at most
    buckets = F.broadcast(stored(chosen.select(bucket).distinct()))
    near = _placed(docs).select("*", bucket).join(buckets, "bucket", "left_semi")
    texts = near.join(chosen, near.doc_id.eqNullSafe(chosen.doc_id) & (near.same == chosen.same), "left_semi")
    return mapped(texts.select("text"), batches, "node long, shingles array<long>").dropDuplicates(["node"])


class InvertedIndex:
    """Of each shingle of some sets the ascending list of the sets with it, all lists in one ascending array of numbers."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        shingle = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, shingle))
        self.owner = owner[order]
        self.shingles, self.starts = np.unique(shingle[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(shingle))
        # a list's place times the number of sets, and the set: ascending over all lists
        self.entries = np.repeat(np.arange(len(self.shingles)), self.ends - self.starts) * max(len(sets), 1) + self.owner

    def _merged(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sets in the lists and in how many; a heap hands out the two shortest lists to be merged until one is left."""
        heap = [(len(found), i, found) for i, found in enumerate(lists)]
        heapq.heapify(heap)
        while len(heap) > 1:
            _, i, a = heapq.heappop(heap)
            _, _, b = heap[0]
            both = np.concatenate([a, b])
            both.sort(kind="stable")  # merges two ascending runs
            heapq.heapreplace(heap, (len(both), i, both))
        return np.unique(heap[0][2], return_counts=True) if heap else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _probed(self, places: np.ndarray, owner: int) -> int:
        """In how many of the lists at ``places`` a set is, by binary search."""
        wanted = places * max(len(self.sizes), 1) + owner
        at = np.searchsorted(self.entries, wanted)
        at[at == len(self.entries)] = 0
        return int((self.entries[at] == wanted).sum()) if len(self.entries) else 0

    def search(self, asked: np.ndarray, share: int, open_) -> Iterator[int]:
        """Sets whose overlap with ``asked`` reaches ``share`` hundredths of the union, of those that are still ``open_``."""
        least = _required(share, len(asked))
        places = np.searchsorted(self.shingles, asked)
        places[places == len(self.shingles)] = 0
        places = places[self.shingles[places] == asked] if len(self.shingles) else places[:0]
        if len(places) < max(least, 1):
            return
        lengths = self.ends[places] - self.starts[places]
        places = places[np.argsort(lengths, kind="stable")]
        aside = min(int(least / (_MU * math.log2(int(lengths.max()) + 1) + 1)), least - 1)
        short, long = places[: len(places) - aside], places[len(places) - aside :]
        owners, seen = self._merged([self.owner[self.starts[p] : self.ends[p]] for p in short])
        near = np.lexsort((owners, -seen))
        near = near[(seen >= least - aside)[near]]
        sizes = self.sizes[owners]
        near = near[((100 * sizes >= share * len(asked)) & (100 * len(asked) >= share * sizes))[near]]
        near = near[open_(owners[near])]
        while len(near):
            at, near = near[0], near[1:]
            overlap = int(seen[at]) + self._probed(long, int(owners[at]))
            if 100 * overlap >= share * (len(asked) + int(sizes[at]) - overlap):
                yield int(owners[at])
                near = near[open_(owners[near])]


class _Cell:
    """A part of a cell: its members are indexed, and nodes of other parts ask in it one by one."""

    def __init__(self, share: int):
        self.share, self.index = share, None
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.links: list[tuple[int, int]] = []
        self.label: dict[int, int] = {}  # of the roots known before
        self.above: list[int] = []
        self.own: list[int] = []
        self.group = np.zeros(0, dtype=np.int64)

    def _group(self, root: int) -> int:
        at = self.label.setdefault(root, len(self.above))
        if at == len(self.above):
            self.above.append(at)
        while self.above[at] != at:
            at = self.above[at]
        return at

    def _ask(self, node: int, shingles: np.ndarray, group: int, before: int) -> None:
        """Link a node to each group of members before this place that it is similar to."""

        def is_open(at: np.ndarray) -> np.ndarray:
            return (at < before) & (self.group[at] != group)

        for at in self.index.search(shingles, self.share, is_open):
            self.links.append((node, self.nodes[at]))
            joined = int(self.group[at])
            self.group[self.group == joined] = group
            self.above[joined] = group

    def add(self, node: int, root: int, shingles: np.ndarray, asks: bool) -> None:
        group = self._group(root)
        if asks:
            self.close(search=False)
            self._ask(node, shingles, group, len(self.nodes))
        else:
            self.nodes.append(node)
            self.own.append(group)
            self.sets.append(shingles)

    def close(self, search: bool = True) -> None:
        """All members are there; those of a part in which nobody asks search among themselves."""
        if self.index is not None:
            return
        self.index, self.group = InvertedIndex(self.sets), np.array(self.own, dtype=np.int64)
        if search:
            for place, (node, shingles) in enumerate(zip(self.nodes, self.sets)):
                self._ask(node, shingles, int(self.group[place]), place)
        self.sets = []


def _searched(share: int):
    def links(cell: _Cell | None) -> list[tuple[int, int]]:
        if cell is None:
            return []
        cell.close()
        found, cell.links = cell.links, []
        return found

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at = None, None
        for batch in rows:
            found = []
            lists = batch.column("shingles")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            columns = (batch.column(c).to_pylist() for c in ("cell", "part", "node", "root", "asks"))
            for i, (key, part, node, root, asks) in enumerate(zip(*columns)):
                if (key, part) != at:
                    found += links(cell)
                    cell, at = _Cell(share), (key, part)
                cell.add(node, root, values[ends[i] : ends[i + 1]].copy(), asks)
            yield _pairs(found)
        yield _pairs(links(cell))

    return batches


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def _cell_links(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) in cells of ``members`` (cell, part, node, root, asks)."""
    rows = members.join(sets, "node").repartition("cell", "part").sortWithinPartitions("cell", "part", "asks", "node")
    return mapped(rows, _searched(share), "a long, b long")


def _in_lists(rows: DataFrame, share: int) -> DataFrame:
    """``rows`` (node, n, least, key) with the cell of the key, for keys that nodes of fitting sizes have."""
    lists = rows.groupBy("key").agg(F.min("node").alias("cell"), F.count("*").alias("count"), F.min("n").alias("low"), F.max("n").alias("high"))
    lists = lists.where((F.col("count") > 1) & ((F.col("count") > 2) | (100 * F.col("low") >= share * F.col("high")))).select(_turned("key"), "cell")
    return rows.select("node", "n", "least", "key", _turned("key")).drop("cell").join(lists, "turned").drop("turned")


def _turned(name: str):
    return F.col(name).bitwiseXOR(F.lit(_TURN)).alias("turned")


def connected(docs: DataFrame, size: int, share: int, part: int = PART, near=_near, compared_nodes: int = COMPARED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, same, node, n) of each row, and (node, root) of the nodes that are linked.

    ``near`` finds the nodes that may be similar to another one by their sketches, in cells of ``compared_nodes`` at most.
    """
    known = stored(_keyed(docs, size, share, common_shingles(docs, size)))
    some = known.where("n > 0")
    rows = some.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "least", "keys"))).select("node", "n", "least", F.explode("keys").alias("key"))
    rows = stored(_in_lists(rows, share))
    enough = rows.groupBy("node").agg(F.count("*").alias("shared"), F.first("least").alias("least")).where("shared >= least").select("node")
    cells = _in_lists(rows.join(enough, "node", "left_semi"), share).groupBy("cell", "node")
    cells = cells.agg(F.first("n").alias("n"), F.first("least").alias("least"), F.count("*").alias("shared"))
    # two nodes leave out fewer keys together than they share
    fewest = F.sum("shared").over(Window.partitionBy("node").orderBy("shared", "cell"))
    cells = stored(cells.withColumn("fewest", fewest).where("fewest > (least - 1) div 2").select("cell", "node", "n"))
    sketches = some.groupBy("node").agg(F.first("sketch").alias("sketch"))
    large = cells.groupBy("cell").count().where(F.col("count") > compared_nodes)
    compared = cells.join(large, "cell", "left_anti").join(sketches, "node").repartition("cell").sortWithinPartitions("cell", "n", "node")
    compared = mapped(compared, near(share), "cell long, node long, n long")
    cells = stored(compared.unionByName(cells.join(large, "cell", "left_semi")))

    live = cells.select("node").distinct()
    chosen = some.join(live, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "same")).alias("row")).select("row.*")
    sets = stored(_sets(docs, stored(chosen), size))
    parts = stored(cells.groupBy("cell").agg(F.ceil(F.sum("n") / part).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    with_parts = cells.select("cell", "node", _turned("cell")).join(parts.select(_turned("cell"), "parts"), "turned").drop("turned")
    # the least node of a cell is in all its parts
    each = F.when(F.col("node") == F.col("cell"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    members = with_parts.select("cell", F.explode(each).alias("part"), "node", F.col("node").alias("root"), F.lit(False).alias("asks"))
    found = stored(_cell_links(members, sets, share))

    if parts.where("parts > 1").limit(1).count():
        roots = components(found)
        rows = with_parts.where("parts > 1").join(roots, "node", "left").select("cell", "node", "parts", F.coalesce("root", "node").alias("root"), own.alias("own"))
        rows = stored(rows)
        sums = rows.groupBy("cell", "root").agg(F.count("*").alias("count")).groupBy("cell").agg(F.max(F.struct("count", "root")).alias("top"))
        rows = rows.withColumn("turned", _turned("cell")).join(sums.select(_turned("cell"), F.col("top.root").alias("main")), "turned").drop("turned")
        others = rows.where("root <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> own")
        again = rows.select("cell", F.col("own").alias("part"), "node", "root", F.lit(False).alias("asks"))
        again = again.unionByName(others.select("cell", "part", "node", "root", F.lit(True).alias("asks")))
        found = found.unionByName(stored(_cell_links(again, sets, share)))
    forget(sets)
    forget(cells)
    return known.select("doc_id", "same", "node", "n"), components(found)


def similar_sets(docs: DataFrame, size: int = SHINGLE, share: int = SHARE, part: int = PART) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text; more columns are ignored).

    Words are taken from the whole text with A-Z in lower case. Texts are linked where their sets of shingles of ``size`` words
    have at least ``share`` hundredths of their union in common; a text of fewer words is one shingle. ``component_id`` is
    the smallest doc_id that links reach, the row's own included. A null text, or one without words, has an empty set and is linked with
    nothing, not even its like. Rows without doc_id link others but give no id; a component of such rows only has a null one. Repeated
    rows have equal results, and different texts of one doc_id are rows of their own. An empty table gives no rows.
    """
    if not 50 < share <= 100:
        raise ValueError("share has to be above 50 hundredths and at most 100")
    known, roots = connected(docs, size, share, part)
    some = known.where("n > 0")
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(roots, "node", "left")
    nodes = nodes.select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id")).select(_turned("root"), "component_id")
    nodes = nodes.select("node", _turned("root")).join(least, "turned").select("node", "component_id")
    found = some.join(nodes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(known.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
