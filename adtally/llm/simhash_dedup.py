"""Near-duplicates by SimHash fingerprints, searched with BK-trees.

Equal fingerprints are put together first, so a group of copies is one fingerprint whatever its size. Two fingerprints
that differ in 3 bits at most are equal in one of four blocks of 16 bits, and in one of four blocks of 12 of the other
48 bits. These 28 bits are a shard: 16 shards for each fingerprint, and any pair to be linked meets in one of them.
Each shard has BK-trees (children keyed by their Hamming distance to the parent; only edges within the radius are
followed). A shard of more than ``TREE_SIZE`` fingerprints has several trees, and each of its trees is sent to each of
its parts, so that no task holds more than one tree and one part. Within a shard only links that connect something
new are put out, which leaves the components as they are.

For groups of texts with similar sets of shingles a fingerprint within 3 bits is no promise. There the shards are the cells of
:mod:`adtally.llm.jaccard_join`, in one of which similar sets meet, and the fingerprints are its parity sketches, which differ in no more
bits than the sets do in shingles. BK-trees of a cell find the sets within the radius that the similarity needs, and only these are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.llm.components import components
from adtally.llm.jaccard_join import connected, members
from adtally.llm.shared import checkpointed, mapped, stored
from adtally.llm.words import chunks, words

SHINGLE = 3
RADIUS = 3
TREE_SIZE = 4096
SEED = 42
#: For groups of similar texts: words of a shingle, and hundredths of the union that two sets share.
WORDS_TOGETHER, SIMILAR = 5, 80
USUAL_SIZE = 256
#: Bound of the buckets of rows that are sent to all executors.
BUCKETS = 1 << 20
_TURN = 0x5DEECE66D
_EVERY_EIGHTH = np.uint64(0x0101010101010101)


def _shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows in their order, and each row's number of them."""
    found = words(texts)
    data = found.data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    lengths = found.ends - found.starts
    inside = np.repeat(found.starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(found) else np.zeros(0, int)
    joined = np.full(int(lengths.sum()) + len(found), 0x20, dtype=np.uint8)
    joined[np.arange(len(inside)) + np.repeat(np.arange(len(found)), lengths)] = data[inside]
    text = joined.tobytes()
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = np.diff(found.first)
    shingles = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    step = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    first = np.repeat(found.first[:-1], shingles) + step
    last = np.minimum(first + size, np.repeat(found.first[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(text[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())]
    return np.array(hashes, dtype=np.uint64), shingles


def _majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each row the bits that are set in over half of its hashes; ``hashes`` has those of all rows in order.

    Eight bits of a hash at a time are counted in the eight bytes of a number, over at most 255 hashes.
    """
    sums = np.zeros((len(count), 64), dtype=np.int64)
    some = np.flatnonzero(count)
    if len(some):
        parts = -(-count[some] // 255)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat((np.cumsum(count) - count)[some], parts) + 255 * number
        lanes = [np.add.reduceat((hashes >> np.uint64(k)) & _EVERY_EIGHTH, starts) for k in range(8)]
        bits = np.stack(lanes, axis=1).view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
        sums[some] = np.add.reduceat(bits, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > count[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def _fingerprints(texts: pa.Array, size: int) -> np.ndarray:
    return _majority(*_shingle_hashes(texts, size))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row of ``docs`` (doc_id, text), as a signed number."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in chunks(batch):
                found = _fingerprints(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), batches, "doc_id long, fp long")


class BKTree:
    """Numbers in a tree; a node's children are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at a distance of ``radius`` at most."""
        found, open_ = [], [0] if self.values else []
        while open_:
            node = open_.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            open_ += [c for d, c in self.children[node].items() if distance - radius <= d <= distance + radius]
        return found

    def add(self, value: int) -> int:
        node, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            distance = (self.values[node] ^ value).bit_count()
            below = self.children[node].setdefault(distance, new)
            if below == new:
                break
            node = below
        return new


class _Cell:
    """The tree of one shard part, and links found so far.

    A link needs fingerprints within ``radius`` and, if ``most`` is given, marks that differ in so many bits at most.
    """

    def __init__(self, radius: int, most: int | None):
        self.radius, self.most, self.tree, self.above, self.links = radius, most, BKTree(), [], []
        self.nodes: list[int] = []
        self.marks: list[int] = []

    def root(self, at: int) -> int:
        while self.above[at] != at:
            self.above[at] = at = self.above[self.above[at]]
        return at

    def add(self, node: int, value: int, mark: int, member: bool, new: bool) -> None:
        """Link a node to each part of the shard that it touches; a member joins the tree.

        Links of members to each other are put out where they are ``new``, in the tree's own cell.
        """
        near = self.tree.within(value, self.radius)
        if self.most is not None:
            near = [x for x in near if (self.marks[x] ^ mark).bit_count() <= self.most]
        roots = {self.root(x): x for x in near}
        if new or not member:
            self.links += [(node, self.nodes[x]) for x in roots.values()]
        if member:
            at = self.tree.add(value)
            self.above.append(at)
            self.nodes.append(node)
            self.marks.append(mark)
            roots[at] = at
        top = min(roots, default=0)
        for x in roots:
            self.above[x] = top


def _linked(radius: int, most: int | None):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at = None, None
        for batch in rows:
            keys = zip(*(batch.column(c).to_pylist() for c in ("shard", "tree", "part")))
            values = batch.column("fp").to_numpy().view(np.uint64).tolist()
            marks = [int.from_bytes(m) for m in batch.column("marks").to_pylist()]
            links = []
            for key, node, value, mark, member in zip(keys, batch.column("node").to_pylist(), values, marks, batch.column("member").to_pylist()):
                if key != at:
                    links += cell.links if cell else []
                    cell, at = _Cell(radius, most), key
                cell.add(node, value, mark, member, key[1] == key[2])
            links += cell.links if cell else []
            if cell:
                cell.links = []
            ends = np.array(links, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return batches


def _shards(fp: Column) -> Column:
    keys = []
    for block in range(4):
        turned = F.shiftleft(fp, 16 * block).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * block)) if block else fp
        high = F.shiftleft(F.shiftrightunsigned(turned, 48), 12)
        for part in range(4):
            low = F.shiftrightunsigned(turned, 36 - 12 * part).bitwiseAND(F.lit(0xFFF))
            keys.append(high.bitwiseOR(low).bitwiseOR(F.lit((4 * block + part) << 28)))
    return F.array(*keys)


def links(known: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, most: int | None = None) -> DataFrame:
    """Links (a, b) between nodes, enough of them to connect what is linked.

    ``known`` has node and fps, a list of fingerprints, and with ``most`` marks, a binary column. Nodes are linked if
    their fingerprints at one place of the list are within the radius and their marks differ in ``most`` bits at most.
    """
    if not 0 <= radius <= 3:
        raise ValueError("shards are built for a radius of at most 3")
    rows = known.select("node", F.posexplode("fps").alias("place", "fp"))
    shard = F.explode(_shards(F.col("fp"))).alias("shard")
    rows = rows.select("node", "fp", "place", shard).withColumn("shard", F.col("shard") + F.col("place").cast("long") * (1 << 32)).drop("place")
    counts = rows.groupBy("shard").count().where("count > 1")
    counts = counts.select(F.col("shard").bitwiseXOR(F.lit(_TURN)).alias("turned"), F.ceil(F.col("count") / tree_size).cast("int").alias("trees"))
    rows = rows.withColumn("turned", F.col("shard").bitwiseXOR(F.lit(_TURN))).join(counts, "turned").drop("turned")
    if most is None:
        rows = rows.withColumn("marks", F.lit(b""))
    else:
        rows = rows.join(known.select("node", "marks"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("trees")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    rows = rows.select(
        "shard", "node", "fp", "marks", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("part"), (F.col("own") <= F.col("other")).alias("member")
    )
    # cells (tree, part): members of the tree first, then the values of the other part
    cells = rows.repartition("shard", "tree", "part").sortWithinPartitions("shard", "tree", "part", F.desc("member"))
    return mapped(cells, _linked(radius, most), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text; more columns are ignored).

    Words are taken from the whole text with A-Z in lower case. A text of fewer words than a shingle is one shingle; a
    null text or one without words has fingerprint 0, linked like any other. ``component_id`` is the smallest
    doc_id that can be reached over links of at most ``radius`` bits; rows without doc_id link others but give no id,
    and a component of such rows only has a null one. Repeated rows have equal results.
    """
    known = checkpointed(fingerprints(docs, shingle)).withColumnRenamed("fp", "node")
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    found = links(nodes.select("node", F.array("node").alias("fps")), radius, tree_size)
    found = _with_component(known, nodes, components(found))
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


class _Sketches:
    """BK-trees of the sketches of a cell, one for each length; nodes come with ascending sizes of their sets."""

    def __init__(self, share: int):
        self.share, self.rows, self.stays = share, [], []
        self.trees: dict[int, tuple[BKTree, list[int]]] = {}

    def add(self, cell: int, node: int, n: int, sketch: bytes) -> None:
        """Look for the others a node may be similar to, and put it into the tree of its length.

        The sketch of a similar set that is smaller has the same length or half of it; a sketch is folded to that.
        """
        at, value, apart, both = len(self.rows), int.from_bytes(sketch, "little"), 100 - self.share, 100 + self.share
        self.rows.append((cell, node, n))
        self.stays.append(False)
        for length in (len(sketch), len(sketch) // 2):
            if length not in self.trees:
                continue
            tree, places = self.trees[length]
            asked = value if length == len(sketch) else (value ^ (value >> 8 * length)) & ((1 << 8 * length) - 1)
            for x in tree.within(asked, 2 * apart * n // both):
                size = self.rows[places[x]][2]
                if 100 * size >= self.share * n and both * (tree.values[x] ^ asked).bit_count() <= apart * (n + size):
                    self.stays[at] = self.stays[places[x]] = True
        tree, places = self.trees.setdefault(len(sketch), (BKTree(), []))
        tree.add(value)
        places.append(at)

    def staying(self) -> list[tuple]:
        return [row for row, stays in zip(self.rows, self.stays) if stays]


def _in_trees(share: int):
    """Rows (cell, node, n) of nodes that have another one in their cell within the radius that ``share`` hundredths of the union need."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = _Sketches(share), None
        for batch in rows:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "n", "sketch"))):
                if row[0] != at:
                    found += held.staying()
                    held, at = _Sketches(share), row[0]
                held.add(*row)
            yield members(found)
        yield members(held.staying())

    return batches


def _with_component(known: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``known`` (doc_id, node) with the least doc_id of the component of its node."""
    nodes = nodes.select("node", "doc_id").join(roots, "node", "left")
    nodes = nodes.select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = least.select(F.col("root").bitwiseXOR(F.lit(_TURN)).alias("turned"), "component_id")
    nodes = nodes.select("node", F.col("root").bitwiseXOR(F.lit(_TURN)).alias("turned")).join(least, "turned")
    return known.join(nodes.select("node", "component_id"), "node")


def similar_documents(docs: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, component_id) of each row of ``docs``: groups of texts linked by a similarity of 0.8 or more.

    The similarity is the exact share of different shingles of ``WORDS_TOGETHER`` words that two texts have in common
    (Jaccard), on 64-bit hashes. Texts meet in the cells of :mod:`adtally.llm.jaccard_join`, which leave no pair out; BK-trees of a cell of
    ``tree_size`` nodes at most find those near enough, all nodes of a larger one go on, and the exact search follows. Equal
    sets, empty ones too, are one node. A part of a cell has ``tree_size`` texts of ``USUAL_SIZE`` shingles at most. Rows without
    doc_id give no id, as in ``near_duplicates``.
    """
    known, roots = connected(docs, WORDS_TOGETHER, SIMILAR, tree_size * USUAL_SIZE, _in_trees, tree_size)
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    return _with_component(known.select("doc_id", "node"), nodes, roots).select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group, that with the smallest (doc_id, hash of text); rows without doc_id are not compared and stay.

    The groups are those of ``similar_documents``: BK-trees in the cells, then exact similarities.
    Different texts of one doc_id are rows of their own; rows that repeat both are one.
    """
    placed = docs.where("doc_id IS NOT NULL")
    known, roots = connected(placed, WORDS_TOGETHER, SIMILAR, near=_in_trees, compared_nodes=TREE_SIZE)
    groups = stored(known.select("doc_id", "same", "node").join(roots, "node", "left").select("doc_id", "same", F.coalesce("root", "node").alias("root")))
    least = groups.groupBy("root").agg(F.min(F.struct("doc_id", "same")).alias("least"), F.count("*").alias("rows"))
    several = least.where("rows > 1").select(F.col("root").bitwiseXOR(F.lit(_TURN)).alias("turned"))
    # rows that share a bucket with none of these are alone in their group, and their texts are not shuffled
    bucket = F.pmod(F.xxhash64("doc_id", "same"), F.lit(BUCKETS)).alias("bucket")
    buckets = groups.withColumn("turned", F.col("root").bitwiseXOR(F.lit(_TURN))).join(several, "turned", "left_semi").select(bucket).distinct()
    buckets = F.broadcast(stored(buckets))
    rows = placed.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("same"), F.struct(*docs.columns).alias("row")).select("*", bucket)
    alone = rows.join(buckets, "bucket", "left_anti").select("row.*")
    rows = rows.join(buckets, "bucket", "left_semi").join(least.select("least.*"), ["doc_id", "same"], "left_semi")
    rows = rows.dropDuplicates(["doc_id", "same"]).select("row.*")
    return alone.unionByName(rows).unionByName(docs.where("doc_id IS NULL"))
