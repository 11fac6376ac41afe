"""Search for a part of a text with an inverted index on runs of three letters.

The index has a posting (gram, id) for each different run of three letters of a text, in small letters. A text that contains what
is searched for has all of its runs, so the postings of those are intersected, and only the candidates that are left
are looked at. Texts of fewer than three letters are indexed whole, and parts of fewer than three letters are looked for in the grams
themselves, so short ones are found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def _grams(text: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - SIZE + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, SIZE)))


def postings(table: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, id): the index of a text column. Rows without key or text are not in it."""
    rows = table.select(F.col(key).alias("id"), F.lower(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.select(F.explode(_grams(F.col("text"))).alias("gram"), "id").distinct()


def write(index: DataFrame, folder: str) -> None:
    """Store an index in the order of its grams, so that a search reads the files and row groups of its own grams only.

    The postings of a frequent gram are spread over several ranges by id.
    """
    index.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(folder)


def runs_of(part: str) -> list[str]:
    """Grams that a text with ``part`` in it has; none for a part that is too short."""
    part = part.lower()
    return list(dict.fromkeys(part[at : at + SIZE] for at in range(len(part) - SIZE + 1)))


def candidates(index: DataFrame, part: str) -> DataFrame:
    """(id) of texts that may contain ``part``: those in the postings of all its runs.

    Postings are counted by id inside the scan's tasks first. A part of fewer than three letters is in a text if it is in one of its grams.
    """
    runs = runs_of(part)
    if not runs:
        return index.where(F.contains("gram", F.lit(part.lower()))).select("id").distinct()
    found = index.where(F.col("gram").isin(runs))
    return found.groupBy("id").agg(F.count("*").alias("runs")).where(F.col("runs") == len(runs)).select("id")


def containing(table: DataFrame, key: str, text: str, index: DataFrame, part: str) -> DataFrame:
    """Rows of ``table`` whose text contains ``part`` in any case; only candidates are compared letter by letter."""
    near = candidates(index, part).withColumnRenamed("id", key)
    return table.join(near, key, "left_semi").where(F.contains(F.lower(text), F.lit(part.lower())))
