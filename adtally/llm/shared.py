"""The shared folder of the cluster, the one place where lineage is cut, and code for Python workers."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset, as in tests, a
    folder of the warehouse is taken, which is shared too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/adtally-checkpoints"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep its rows in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Spark removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most rows that Spark sends to a Python worker at once. It keeps them outside the heap, in buffers of the next power of two.
_ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
_UNSET = {_CLEANUP: "false", _ROWS_AT_ONCE: "10000"}
#: That number for rows with whole texts.
TEXTS_AT_ONCE = 1000


@contextmanager
def step(spark: SparkSession, at_once: int | None = None) -> Iterator[None]:
    """Settings for a query that ends within: its shuffle files go with it, and ``at_once`` bounds the rows that a Python worker is sent together."""
    before = {name: spark.conf.get(name, value) for name, value in _UNSET.items()}
    wanted = {_CLEANUP: "true"}
    if at_once is not None and not 0 < int(before[_ROWS_AT_ONCE]) < at_once:
        wanted[_ROWS_AT_ONCE] = str(at_once)
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in wanted:
            spark.conf.set(name, before[name])


def stored(df: DataFrame, at_once: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The table takes the place of the shuffle files of the query, which are removed, so a chain of such steps
    needs disk for its largest step only. ``at_once`` bounds the rows that a Python worker is sent together meanwhile.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "table")
    with step(spark, at_once):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget(df: DataFrame) -> None:
    """Delete the files of a table of ``stored`` that is not read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        files, path = folder_of(folder)
        files.delete_dir(path)


def folder_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that Spark names ``file:/x``, ``/x`` or by another scheme."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def ship(spark: SparkSession) -> None:
    """Send the modules of this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package, content = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, str(file.relative_to(package.parent)))
    folder = new_folder(spark, "code")
    files, path = folder_of(folder)
    files.create_dir(path)
    with files.open_output_stream(f"{path}/adtally_code.zip") as out:
        out.write(content.getvalue())
    context.addPyFile(f"{folder}/adtally_code.zip")
    _shipped.add(context.applicationId)


def mapped(df: DataFrame, batches: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with functions of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(batches, schema)
