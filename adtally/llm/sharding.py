"""Sharding by extendible hashing: a directory of hash prefixes, split until every shard fits its byte limit.

A row's hash is the MD5 of its id, 128 bits, of which a shard knows a prefix. The directory starts with one shard. Only
one that is too large, and holds more than one hash, is split on another bit. Sums are made for prefixes of ``STEP`` bits at once, ``2 ** STEP`` rows
below each shard that is split further, and the depth of each shard is worked out from them; so rows are read once for
every ``STEP`` bits of depth, and only rows of shards that are still too large are summed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.shared import checkpointed

LIMIT_BYTES = 64 << 20
STEP = 12
HASH_BITS = 128


def hash_bits(key: Column) -> Column:
    """The MD5 of a key's text as 128 binary digits; a null key has the hash of the empty text."""
    digits = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)]
    return F.concat(*parts)


def _split(cells: DataFrame, limit: int, step: int) -> DataFrame:
    """The depth in bits, up to ``step``, at which each cell's shard is settled; null where it is not.

    ``cells`` has (prefix, cell, bytes, low, high): the next ``step`` bits below the prefix, and the least and greatest hash.
    """
    ways = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("more"))
    ways = ways.withColumn("part", F.expr("substring(cell, 1, more)"))
    sums = ways.groupBy("prefix", "more", "part").agg(
        F.sum("bytes").alias("shard_bytes"), (F.min("low") == F.max("high")).alias("single")
    )
    settled = sums.where((F.col("shard_bytes") <= limit) | F.col("single"))
    fits = ways.join(settled, ["prefix", "more", "part"])
    return fits.groupBy("prefix", "cell").agg(F.min(F.struct("more", "part", "shard_bytes", "single")).alias("best"))


def _levels(rows: DataFrame, limit: int, step: int) -> list[tuple[int, DataFrame]]:
    """Depth and (cell, shard, shard_bytes, single) of each pass; ``shard`` is null where the next pass goes on."""
    found, depth = [], 0
    while True:
        at = [F.substring("hash", 1, depth).alias("prefix"), F.substring("hash", depth + 1, step).alias("cell")]
        cells = rows.groupBy(*at).agg(F.sum("bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        best = cells.join(_split(cells, limit, step), ["prefix", "cell"], "left")
        level = best.select(F.concat("prefix", "cell").alias("cell"), F.concat("prefix", "best.part").alias("shard"), "best.shard_bytes", "best.single")
        level = checkpointed(level)
        depth = min(depth + step, HASH_BITS)
        found.append((depth, level))
        large = level.where("shard IS NULL").select("cell")
        if large.isEmpty():
            return found
        rows = rows.withColumn("cell", F.substring("hash", 1, depth)).join(large, "cell", "left_semi").drop("cell")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of shards of a single hash that are too large, dealt out over shards that fit.

    Each input partition deals out its own rows by running bytes, so no group of equal ids meets in one task.
    """
    own = Window.partitionBy("shard", "at")
    order = own.orderBy("bytes", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(limit) - F.max("bytes").over(own)
    part = F.when(room > 0, F.floor(F.coalesce(F.sum("bytes").over(order), F.lit(0)) / room))
    part = F.coalesce(part, F.row_number().over(own.orderBy("bytes", "doc_id")))
    rows = rows.withColumn("at", F.spark_partition_id()).withColumn("part", part)
    rows = rows.withColumn("shard", F.concat_ws("-", "shard", "at", "part"))
    sums = rows.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return rows.drop("shard_bytes", "at", "part").join(sums, "shard")


def sharded(docs: DataFrame, limit: int = LIMIT_BYTES, step: int = STEP) -> DataFrame:
    """``doc_id, bytes, shard, depth, shard_bytes`` for each row of ``docs`` (doc_id, text; more columns are ignored).

    ``bytes`` is the length of the text in UTF-8, 0 for null. ``shard`` is a prefix of the hash of doc_id in binary
    digits, empty if everything fits one shard. Rows with equal or null doc_id share a hash and thus a shard; if these
    alone are too large, the shard is followed by numbers that divide it. Only a single row that is larger than the limit
    has a shard that does not fit, and is alone in it. An empty table gives no rows.
    """
    return _sharded(docs, limit, step).select("doc_id", "bytes", "shard", "depth", "shard_bytes")


def _sharded(docs: DataFrame, limit: int, step: int) -> DataFrame:
    """The columns of ``sharded`` and ``row``, the whole row, which costs nothing unless it is used."""
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), hash_bits(F.col("doc_id")).alias("hash")
    )
    known = rows.withColumns({"shard": F.lit(None).cast("string"), "shard_bytes": F.lit(0).cast("long"), "single": F.lit(False)})
    for depth, level in _levels(rows.drop("row"), limit, step):
        level = level.select("cell", *(F.col(c).alias(f"new_{c}") for c in ("shard", "shard_bytes", "single")))
        # the first directory has at most 2 ** step rows; the later ones grow with the corpus
        level = F.broadcast(level) if depth <= step else level
        rest = known.where("shard IS NULL").withColumn("cell", F.substring("hash", 1, depth)).join(level, "cell")
        rest = rest.select(*rows.columns, *(F.col(f"new_{c}").alias(c) for c in ("shard", "shard_bytes", "single")))
        known = rest if depth <= step else known.where("shard IS NOT NULL").unionByName(rest)
    large = F.col("single") & (F.col("shard_bytes") > limit)
    known = known.where(~large).unionByName(_overflow(known.where(large), limit))
    return known.withColumn("depth", F.length(F.substring_index("shard", "-", 1)))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write ``docs`` as Parquet below ``path``, a folder for each shard; each row goes to its own shard."""
    rows = _sharded(docs, limit, STEP).select("row.*", "shard")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
