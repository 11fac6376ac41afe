"""WARC archives: a Spark data source that reads and writes them, and the records of a table of pages.

Reading plans one partition per file. Predicates on the record type and on header columns are pushed down: a record's
headers are parsed first, and where they rule it out its block is skipped, by seeking over it in a plain file and without
keeping it in a compressed one. With option ``payload`` set to false no payload is decoded at all.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from adtally.llm.shared import folder_of, ship

SCHEMA = (
    "warc_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "page_id long, payload_bytes long, payload binary"
)
#: Columns and the record headers they come from.
HEADERS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
#: Fixed values of the format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 128 << 20
BATCH_BYTES = 4 << 20


def page_urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def _page(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn and urn.startswith("<urn:page:") else None


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(kind: str, page_id: int | None, uri: str | None, sha1: str, refers_to: int | None, length: int, payload: bytes | None) -> bytes:
    """One record; a revisit has the HTTP headers of its response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else page_urn(page_id)),
        ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"),
        ("WARC-Refers-To", None if refers_to is None else page_urn(refers_to)), ("WARC-Profile", SAME_PAYLOAD if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines if v is not None).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class WarcFile(InputPartition):
    path: str


def _headers(source: io.BufferedIOBase) -> dict[str, str] | None:
    """Headers of the next record by lower-case name, or None at the end."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record but {line[:40]!r}")
    found, last = {}, None
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            found[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def _skip(source: io.BufferedIOBase, length: int) -> None:
    if isinstance(source, gzip.GzipFile):
        while length and (got := len(source.read(min(length, 1 << 20)))):
            length -= got
    else:
        source.seek(length, io.SEEK_CUR)


def records(source: io.BufferedIOBase, wanted, payload: bool = True) -> Iterator[dict]:
    """Records of an open archive for whose headers ``wanted`` is true."""
    while (head := _headers(source)) is not None:
        length = int(head.get("content-length", "0"))
        row = {column: head.get(name) for column, name in HEADERS.items()}
        row["page_id"] = _page(row["record_id"])
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if not wanted(row):
            _skip(source, length)
            continue
        http, size, left = "application/http" in head.get("content-type", ""), None, length
        if http:
            while left and (line := source.readline(left)):
                left -= len(line)
                if line in (b"\r\n", b"\n"):
                    break
                if line[:15].lower() == b"content-length:":
                    size = int(line[15:])
        row["payload_bytes"] = left if size is None else size
        row["payload"] = None
        if payload and row["warc_type"] != "revisit":
            row["payload"] = source.read(left)
            digest = base32(hashlib.sha1(row["payload"]).hexdigest())
            if row["payload_digest"] and row["payload_digest"] != digest:
                raise ValueError(f"the payload of {row['record_id']} does not have its digest")
        else:
            _skip(source, left)
        yield row


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        """Take over equality, membership and presence of header columns; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, tuple(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, ()))
            else:
                yield f

    def partitions(self):
        files, path = folder_of(self.path)
        found = files.get_file_info(pafs.FileSelector(path, recursive=True))
        names = sorted(x.path for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and not x.base_name.startswith("_"))
        return [WarcFile(x) for x in names] or [WarcFile("")]

    def _wanted(self, row: dict) -> bool:
        return all(row[c] in values if values else row[c] is not None for c, values in self.tests)

    def read(self, partition):
        if not partition.path:
            return
        files, _ = folder_of(self.path)
        names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])
        with files.open_input_file(partition.path) as raw:
            source = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else io.BufferedReader(raw)
            held, size = [], 0
            for row in records(source, self._wanted, self.payload):
                held.append(row)
                size += len(row["payload"] or b"") + 500
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of ``records_of`` into files of about ``FILE_BYTES``, which get their final names at the commit."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = ".warc.gz" if str(options.get("compress", "true")).lower() != "false" else ".warc"

    def write(self, iterator):
        files, path = folder_of(self.path)
        files.create_dir(path)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}{self.suffix}")
                        out, size = files.open_output_stream(f"{path}/_{names[-1]}", compression=None), 0
                    content = record(**row)
                    content = gzip.compress(content, 1, mtime=0) if self.suffix.endswith(".gz") else content
                    out.write(content)
                    size += len(content)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        files, path = folder_of(self.path)
        files.create_dir(path)
        for name in (n for m in messages if m for n in m.files):
            files.move(f"{path}/_{name}", f"{path}/{name}")

    def abort(self, messages):
        files, path = folder_of(self.path)
        for name in (n for m in messages if m for n in m.files):
            files.delete_file(f"{path}/_{name}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)
    spark.dataSource.register(WarcSource)


def records_of(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A row for each record to write, from ``pages`` (page_id, url, html; more columns are ignored).

    Of rows with equal payloads of at least ``least_bytes`` those with the largest page_id are responses, and the others
    revisits that refer to it, without a payload. A null html is an empty payload. A null page_id is below all others; if
    a payload has no other, all its records are responses. Rows that repeat a page_id repeat its record. A null url
    gives a record without one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    latest = rows.where(F.col("length") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    latest = latest.where("n > 1").select(F.concat(F.lit("="), "sha1").alias("key"), "latest")
    rows = rows.withColumn("key", F.concat(F.lit("="), "sha1")).join(latest, "key", "left")
    again = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("kind"), "page_id", "uri", "sha1",
        F.when(again, F.col("latest")).alias("refers_to"), "length", F.when(~again, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    records_of(pages, least_bytes).write.format("warc").mode("append").save(folder)


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each response and revisit in a folder.

    Responses are read with their payload, which must have its digest; of revisits only headers are parsed.
    """
    responses = read(spark, folder).where("warc_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    revisits = read(spark, folder, payload=False).where("warc_type = 'revisit'")
    page = F.regexp_extract("refers_to", "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    both = responses.drop("payload").unionByName(revisits.drop("payload"))
    return both.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page.alias("refers_to"))
