"""A dictionary of abbreviations that is looked for in texts with an Aho-Corasick automaton."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that rows and entries travel with.
ENTRY, TASK = "_entry", "_task"
_JOINERS = "\u200c\u200d"


def folded(text: str) -> str:
    """A text without case, letter by letter, so that places stay what they are."""
    found = text.upper().lower()
    return found if len(found) == len(text) else "".join(map(_folded_letter, text))


@lru_cache(maxsize=1 << 16)
def _folded_letter(letter: str) -> str:
    for change in (str.upper, str.lower):
        changed = change(letter)
        letter = changed if len(changed) == 1 else letter
    return letter


@lru_cache(maxsize=1 << 16)
def _in_word(letter: str) -> bool:
    return letter.isalnum() or letter == "_" or letter in _JOINERS or unicodedata.category(letter) in ("Mn", "Mc", "Me", "Pc")


def _edge(text: str, at: int) -> bool:
    """Whether a word starts or ends between two letters."""
    before = at > 0 and _in_word(text[at - 1])
    return before != (at < len(text) and _in_word(text[at]))


def automaton(entries: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for entry in entries:
        found.add_word(folded(entry), entry)
    if len(found):
        found.make_automaton()
    return found


def in_capitals(text: str, search: ahocorasick.Automaton) -> str:
    """A text with each entry in it as the dictionary writes it, also where entries overlap.

    An entry counts where a word starts or ends at both of its ends. Occurrences of one entry that overlap each other count
    from the left, as they do when it is replaced.
    """
    result, ends = None, {}
    if not len(search):
        return text
    for last, entry in search.iter(folded(text)):
        start, end = last + 1 - len(entry), last + 1
        if ends.get(entry, 0) <= start and _edge(text, start) and _edge(text, end):
            ends[entry] = end
            result = list(text) if result is None else result
            result[start:end] = entry
    return text if result is None else "".join(result)


def _marked(column: str):
    """Rows with entries in the text ``column`` in capitals; the rows that bring the entries come first and go."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, search = set(), None
        for batch in rows:
            brought = batch.column(batch.schema.get_field_index(ENTRY))
            entries.update(entry for entry in brought.to_pylist() if entry is not None)
            batch = batch.filter(brought.is_null()).drop_columns([ENTRY])
            if not len(batch):
                continue
            if search is None:
                search = automaton(entries)
            at = batch.schema.get_field_index(column)
            texts = [None if text is None else in_capitals(text, search) for text in batch.column(at).to_pylist()]
            yield batch.set_column(at, column, pa.array(texts, pa.string()))

    return batches


def with_entries_in_capitals(df: DataFrame, column: str, dictionary: DataFrame, parts: int = 1) -> DataFrame:
    """``df`` with all entries of a dictionary in a text column in capitals, in any case and overlapping ones too.

    The entries are the first column of ``dictionary``, trimmed; those without a letter, digit or underscore are ignored. Rows are
    dealt out in turn, and each task is sent the entries before its rows and builds one automaton of them. A dictionary too
    large for the memory of a task (some 50 bytes for each letter) is divided into ``parts``, which pass over the rows one after the other.
    """
    schema, tasks = df.schema, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entry = F.upper(F.trim(F.col(dictionary.columns[0]))).alias(ENTRY)
    entries = dictionary.select(entry).where(F.col(ENTRY).rlike(r"(?U)\w")).distinct()
    for part in range(parts):
        own = entries.where(F.pmod(F.xxhash64(ENTRY), F.lit(parts)) == part)
        own = own.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias(TASK), ENTRY)
        rows = df.withColumn(TASK, F.pmod(F.monotonically_increasing_id(), F.lit(tasks)).cast("int"))
        both = rows.unionByName(own, allowMissingColumns=True).repartitionById(tasks, F.col(TASK)).drop(TASK)
        both = both.sortWithinPartitions(F.col(ENTRY).isNull())
        df = both.mapInArrow(_marked(column), schema)
    return df
