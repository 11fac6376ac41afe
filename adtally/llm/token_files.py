"""Token ids in files of separately compressed documents that share a zstandard dictionary.

A shard file holds the compressed ids of a range of documents, one frame per document, in ascending order. Beside it lies an
index: the hash of the dictionary and, for each document, doc_id, place and bytes of its frame, and number of ids, in row groups of
bounded size. So one short document is read with a row group of the index and its frame, and the dictionary gives short
documents the ratio of long ones. The dictionary is trained on a bounded sample of serialized id lists and stored once as
``<sha256>.dict``; readers check its hash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adtally.llm.shared import folder_of, mapped
from adtally.llm.tokenizing import TOGETHER_BYTES, encoded, load
from adtally.llm.words import chunks

END_ID = 2
DICTIONARY_BYTES = 64 << 10
#: Bound of the sample that the dictionary is trained on: documents, and ids of each.
SAMPLE_DOCUMENTS, SAMPLE_IDS = 2000, 1024
#: Characters of a text that so many ids are looked for in.
SAMPLE_CHARS = 8 * SAMPLE_IDS
#: Bytes of texts that a file is planned for, and documents of a row group of its index.
FILE_BYTES, INDEX_ROWS = 256 << 20, 4096
LEVEL = 3

MANIFEST = "shard int, path string, documents long, ids long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


def _write(folder: str, name: str, content: bytes) -> None:
    """Write a file under another name and rename it, so that none is seen half written."""
    files, path = folder_of(folder)
    files.create_dir(path)
    part = f"{path}/_{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(content)
    files.move(part, f"{path}/{name}")


def _dictionary(ids: list[bytes], size: int) -> bytes:
    """A dictionary for such id lists; the lists themselves where they are too few or too short to train one."""
    total = sum(map(len, ids))
    try:
        return zstandard.train_dictionary(min(size, total // 8), ids).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(ids)[-size:]


def _compression(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def train(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, size: int = DICTIONARY_BYTES) -> str:
    """Train the dictionary on ids from at most ``SAMPLE_DOCUMENTS`` documents, chosen by hash, and store it; its hash.

    A long text gives ids from a place in it that is chosen by hash too.
    """
    given = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    picked = given.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).distinct()
    # at most SAMPLE_DOCUMENTS ids, and a bounded part of each text
    places = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    part = F.substr("text", F.pmod(F.xxhash64("doc_id", F.lit(SAMPLE_CHARS)), places).cast("int") + 1, F.lit(SAMPLE_CHARS))
    parts = given.join(F.broadcast(picked), "doc_id").select("doc_id", part.alias("text"))
    texts = [r.text for r in parts.orderBy("doc_id", "text").limit(SAMPLE_DOCUMENTS).collect()]
    ids = encoded(load(tokenizer), texts, end_id)
    rest = [max(len(x) // 4 - SAMPLE_IDS, 0) for x in ids]
    starts = [4 * (zlib.crc32(x) % (n + 1)) for x, n in zip(ids, rest)]
    ids = [x[at : at + 4 * SAMPLE_IDS] for x, at in zip(ids, starts)]
    content = _dictionary(ids, size)
    name = hashlib.sha256(content).hexdigest()
    _write(folder, f"{name}.dict", content)
    return name


def _load_dictionary(folder: str, name: str) -> zstandard.ZstdCompressionDict | None:
    files, path = folder_of(folder)
    with files.open_input_stream(f"{path}/{name}.dict") as source:
        content = source.read()
    if hashlib.sha256(content).hexdigest() != name:
        raise ValueError(f"the dictionary in {folder} is not {name}")
    return _compression(content)


def write(docs: DataFrame, folder: str, tokenizer: str, partitions: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) and return the stored manifest, a row for each shard file in order.

    Documents are sorted by doc_id over the cluster, null first, and rows of one doc_id by a hash of their text. A task that runs
    again writes files of another name; the manifest names those of the task that counted. ``partitions`` is the number of files;
    unless it is given, that of a shuffle or as many as texts of ``FILE_BYTES`` each need, whichever is more.
    """
    dictionary = train(docs, folder, tokenizer, end_id)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, name = TaskContext.get().partitionId(), None
        library, packer = load(tokenizer), zstandard.ZstdCompressor(level=LEVEL, dict_data=_load_dictionary(folder, dictionary))
        files, path = folder_of(folder)
        doc_ids, places, sizes, counts, place, out = [], [], [], [], 0, None
        for batch in rows:
            if out is None:
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
                out = files.open_output_stream(f"{path}/{name}.ids")
            for part in chunks(batch, TOGETHER_BYTES):
                for ids in encoded(library, part.column("text"), end_id):
                    frame = packer.compress(ids)
                    out.write(frame)
                    places.append(place)
                    sizes.append(len(frame))
                    counts.append(len(ids) // 4)
                    place += len(frame)
                doc_ids += part.column("doc_id").to_pylist()
        if out is not None:
            out.close()
            columns = {"doc_id": doc_ids, "place": places, "bytes": sizes, "count": counts}
            index = pa.table({column: pa.array(values, pa.int64()) for column, values in columns.items()})
            index = index.replace_schema_metadata({"dictionary": dictionary})
            with files.open_output_stream(f"{path}/{name}.index") as stream:
                pq.write_table(index, stream, row_group_size=INDEX_ROWS)
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": f"{folder}/{name}", "documents": len(doc_ids), "ids": sum(counts)}],
                schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]),
            )

    if partitions is None:
        content = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-content // FILE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("order"))
    rows = rows.repartitionByRange(partitions, "doc_id", "order").sortWithinPartitions("doc_id", "order").drop("order")
    mapped(rows, batches, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _index(path: str, doc_id: int | None = None) -> tuple[pa.Table, zstandard.ZstdDecompressor]:
    """The index of a shard file, or its rows of one document, read from the row groups that may have it."""
    files, at = folder_of(path)
    with files.open_input_file(f"{at}.index") as source:
        index = pq.read_table(source, filters=None if doc_id is None else [("doc_id", "==", doc_id)])
    dictionary = index.schema.metadata[b"dictionary"].decode()
    return index, zstandard.ZstdDecompressor(dict_data=_load_dictionary(path.rpartition("/")[0], dictionary))


def read_one(path: str, doc_id: int) -> list[int] | None:
    """Ids of one document of a shard file, the first of that id; None if it is not there.

    Read are the footer and a row group of the index, the dictionary, and the document's frame.
    """
    index, unpack = _index(path, doc_id)
    if not len(index):
        return None
    found = index.slice(0, 1).to_pylist()[0]
    files, name = folder_of(path)
    with files.open_input_file(f"{name}.ids") as source:
        frame = source.read_at(found["bytes"], found["place"])
    return np.frombuffer(unpack.decompress(frame), dtype="<u4").tolist()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the files; ``ids`` is little-endian 32-bit, in file order.

    ``start`` is the number of ids of all documents before it. Only the manifest, a row for each file, is put in order
    in one task.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.parquet(f"{folder}/manifest")
    manifest = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for shard in batch.to_pylist():
                index, unpack = _index(shard["path"])
                lengths = index.column("bytes").to_numpy()
                counts = index.column("count").to_numpy()
                starts = shard["start"] + np.cumsum(counts) - counts
                files, path = folder_of(shard["path"])
                with files.open_input_stream(f"{path}.ids") as source:
                    for at in range(0, len(index), 256):
                        sizes = lengths[at : at + 256].tolist()
                        ids = [unpack.decompress(source.read(size)) for size in sizes]
                        end = at + len(sizes)
                        yield pa.RecordBatch.from_arrays(
                            [index.column("doc_id").slice(at, len(sizes)).combine_chunks(), pa.array(starts[at:end]), pa.array(counts[at:end]), pa.array(ids, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    # a given number of partitions, as Spark would put the few short rows into one
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = manifest.select("path", "start").repartition(partitions, "path")
    return mapped(shards, batches, DOCUMENT)


def crc32(ids: DataFrame) -> DataFrame:
    """``ids`` with ``ids_crc32`` of the id bytes in their place."""
    return ids.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
