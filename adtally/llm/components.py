"""Connected components of a graph given by its links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.shared import checkpointed

#: Makes a key that is equal for equal nodes but not the one summed on before, so that Spark deals out both sides
#: of the join anew and can split the partition of a node with very many links.
_TURN = 0x5DEECE66D


def _with_least(links: DataFrame) -> DataFrame:
    """Links (a, b) with the least of a and all its neighbours."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").bitwiseXOR(F.lit(_TURN)).alias("turned"), F.least("a", "m").alias("m"))
    return links.withColumn("turned", F.col("a").bitwiseXOR(F.lit(_TURN))).join(least, "turned").select("a", "b", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = _with_least(down)
    others = found.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionAll(found.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the least node of its component.

    Each round is two joins whose result is written to the shared folder; the driver sees two numbers of it. The
    number of rounds grows with the logarithm of the component size. Links of a node to itself and repeated links
    change nothing; a null on either side makes no link.
    """
    links = checkpointed(links.where("a <> b").select("a", "b").distinct())
    state = None
    while True:
        links = checkpointed(_small_star(_large_star(links)).where("a <> b").distinct())
        before, state = state, _state(links)
        if before == state:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
