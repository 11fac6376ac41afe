"""Mixing of sources to target weights by weighted fair queueing.

Each source is a flow: its documents in shuffled order, the whole order as often as its target asks for. A document
starts at the virtual time (words of its source before it) / (target of its source) and ends one size later, so at any
virtual time all sources have given words in proportion to their targets. A document is divided where its source
reaches its target, at time 1. All turns are sorted by virtual finish time and the order is cut where its words
reach the budget, the sum of the targets.

Everything is DataFrame and SQL expressions. Neither order gathers a source, or all rows, in one task: a source is dealt out over
ranges of its shuffle hash and the turns over ranges of their finish time. Sums of the ranges are made before they
meet, and only rows of one range are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MOST_REPEATS = 2
#: Ranges of the shuffle hash by its first hexadecimal digits.
RANGE_DIGITS = 3
#: Ranges of finish times, half of them up to time 1.
FINISH_RANGES = 8192
SEED = "mix"


def size_of(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(doc_id: Column, text: Column) -> Column:
    """Hash that a source is shuffled by; the text is in it so that rows of one doc_id, or none, are spread."""
    parts = F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(parts.cast("binary"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget_share: float = BUDGET_SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from ``sizes`` (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. The budget is shared by weight, a source stops at
    ``repeats`` times its size, and what it leaves is shared among the others in the same way: with the sources in the
    order in which they fill up, that is one level of words per weight for all that do not. All sources meet in
    one task, a row for each.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))).cast("int") + 1))
    full = (F.lit(repeats) * F.col("source_size")).cast("double")
    rows = rows.withColumn("most", full).withColumn("fills", F.col("most") / F.col("weight"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("fills", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget_share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    heavier = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left / heavier)
    # the first source, in this order, that the level does not fill gives the level of all that follow
    open_ = F.when(F.col("level") < F.col("fills"), F.struct(F.row_number().over(order).alias("place"), "level"))
    rows = rows.withColumn("open", open_)
    level = F.coalesce(F.min("open").over(everything)["level"], F.lit(float("inf")))
    target = F.least("most", level * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mixed(
    docs: DataFrame, weights: tuple = WEIGHTS, budget_share: float = BUDGET_SHARE, repeats: int = MOST_REPEATS, row: Column | None = None
) -> DataFrame:
    """``row, doc_id, source, size, source_size, weight, target, budget, before, taken`` for each row of ``docs``.

    ``docs`` has doc_id, text and source; ``row`` is what is to be carried along, the whole row unless it is given.

    ``before`` is the number of words of the source before the row in its shuffled order, ``taken`` the words that the
    schedule has of it before the budget is spent, repeats counted. The order is that of a hash of doc_id and text, so reruns
    agree; equal rows may stand in for each other. A null source is a source; a null or empty text has size 0 and is taken
    not at all; a null doc_id is hashed as an empty one. An empty table gives no rows.
    """
    rows = _placed(docs, F.struct(*docs.columns) if row is None else row, weights, budget_share, repeats)
    turns = scheduled(rows, repeats)
    same = ("source", "range", "number")
    once = ("row", "doc_id", "size", "source_size", "weight", "target", "budget", "before")
    found = turns.groupBy(*same).agg(*(F.first(c).alias(c) for c in once), F.sum("words").alias("taken"))
    return found.select("row", "doc_id", "source", *once[2:], "taken")


def _placed(docs: DataFrame, row: Column, weights: tuple = WEIGHTS, budget_share: float = BUDGET_SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """Rows with their place in the order of their source; texts are measured once."""
    text = F.col("text")
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long"), "source", size_of(text).alias("size"), shuffled(F.col("doc_id"), text).alias("shuffle"))
    rows = stored(rows.withColumn("range", F.substring("shuffle", 1, RANGE_DIGITS)))
    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    shares = targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget_share, repeats)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = shares.withColumn("budget", F.sum(F.round("target").cast("long")).over(everything))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    starts = starts.alias("a").join(shares.alias("b"), same).select("a.source", "range", "start", "source_size", "weight", "target", "budget")

    order = Window.partitionBy("source", "range").orderBy("shuffle", "doc_id", "size")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"number": F.row_number().over(order), "inside": F.coalesce(inside, F.lit(0))})
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.range") == F.col("b.range"))
    rows = rows.alias("a").join(starts.alias("b"), same).withColumn("before", F.col("start") + F.col("inside"))
    return rows.select("row", "doc_id", "a.source", "size", "source_size", "weight", "target", "budget", "before", "a.range", "number")


def scheduled(rows: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """``rows`` with ``turn``, ``virtual_finish`` and the ``words`` of the turn that the budget has room for.

    A turn that its source reaches its target in is two, one that ends at time 1 and one after it. A row without words has one
    turn without words. The order is by finish time, source, turn and ``before``; its running total is worked out
    within ranges of finish times, on top of the sums of the ranges before.
    """
    goal = F.round("target").cast("long")

    def parts(turn: Column) -> Column:
        start = turn * F.col("source_size") + F.col("before")
        end = start + F.col("size")
        until, after = F.struct(turn.alias("turn"), start.alias("start"), F.least(end, goal).alias("end")), F.struct(turn.alias("turn"), F.greatest(start, goal).alias("start"), end.alias("end"))
        return F.filter(F.array(until, after), lambda x: x["end"] > x["start"])

    turns = rows.withColumn("part", F.explode_outer(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), parts))))
    finish = F.when(goal > 0, F.col("part.end") / goal).otherwise(F.lit(float("inf")))
    # rises with the finish time and stays below the number of ranges; turns without words are dealt out
    place = F.floor((1 - 1 / (1 + F.col("virtual_finish"))) * FINISH_RANGES)
    apart = -1 - F.pmod(F.xxhash64("range", "number"), F.lit(FINISH_RANGES))
    turns = turns.select(
        *rows.columns,
        F.col("part.turn").alias("turn"),
        F.coalesce(F.col("part.end") - F.col("part.start"), F.lit(0)).alias("offered"),
        F.when(F.col("part").isNotNull(), finish).alias("virtual_finish"),
    )
    turns = stored(turns.withColumn("finish_range", F.coalesce(place, apart)))
    by_range = turns.groupBy("finish_range").agg(F.sum("offered").alias("offered"))
    earlier = Window.orderBy("finish_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select("finish_range", F.coalesce(F.sum("offered").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy("finish_range").orderBy("virtual_finish", F.col("source").asc_nulls_last(), "turn", "before")
    inside = F.coalesce(F.sum("offered").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("inside", inside).join(starts, "finish_range")
    room = F.col("budget") - F.col("start") - F.col("inside")
    return turns.select(*rows.columns, "turn", "virtual_finish", F.greatest(F.lit(0), F.least("offered", room)).alias("words"))


def in_order(turns: DataFrame) -> DataFrame:
    """Turns of ``scheduled`` in the order of the mix, sorted by ranges over the cluster."""
    return turns.orderBy("virtual_finish", F.col("source").asc_nulls_last(), "turn", "before")


def schedule(rows: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """Each turn of each row that the mix takes, with ``turn``, ``words`` and ``virtual_finish``, sorted by it.

    ``rows`` is the result of ``mixed``. The turn in which a source reaches its target has fewer words than its document
    and finishes at time 1.
    """
    placed = rows.withColumns({"range": F.lit(""), "number": F.col("before")}) if "range" not in rows.columns else rows
    return in_order(scheduled(placed, repeats).where("words > 0"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix in its order, with the columns of ``docs`` (doc_id, text, source, and any more).

    A document that is taken twice is there twice; of one that the budget cuts the first words are there,
    joined by one space. ``n_chars``, if there is one, is that of the text. Rows that repeat all columns are one to the
    schedule's eyes, each with its own turns. Texts are shuffled twice: to meet their turns, and into the order of the mix.
    """
    others = [F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text", "source"))))] if len(docs.columns) > 3 else []
    key = F.xxhash64("doc_id", "text", "source", *others)
    turns = scheduled(_placed(docs, key)).where("words > 0").withColumnRenamed("row", "key")
    texts = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row")).dropDuplicates(["key"])
    turns = in_order(turns.join(texts, "key"))
    words = F.filter(F.split("row.text", SEPARATORS), lambda w: w != "")
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")
    )
    rows = turns.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "text"), text.alias("text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows
    return rows.select(*docs.columns)
