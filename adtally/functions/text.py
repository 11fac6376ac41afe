"""Cleaning of titles, tags, e-mails and other texts as column expressions."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable
from html.entities import name2codepoint

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.functions.abbreviations import with_entries_in_capitals
from adtally.functions.numbers import BLANKS

# Latin spelling of the Russian letters, then of the blank. Letters with a
# longer spelling are listed apart, as their case depends on the neighbours.
SINGLE_LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "з": "z", "и": "i", "й": "j",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "h", "ц": "c", "ъ": '"', "ы": "y", "ь": "'",
}
LONG_LETTERS = {
    "ё": "jo", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "э": "eh", "ю": "yu", "я": "ya",
}

#: Characters of text that are worked on at once; a longer text is worked on alone.
_TOGETHER = 1 << 18
# Kinds of letters: other ones, capitals, and capitals with a longer spelling.
_OTHER, _CAPITAL, _LONG_CAPITAL = range(3)

# Phrases a title keeps as written here, whatever their case and dots were.
KEPT_PHRASES = {
    "кв. м.": "кв. м.",
    "кв.м.": "кв.м.",
    "леди ю": "Леди Ю",
    "мин. от": "мин. от",
    "СПБ": "СПб",
    "СПбГУ": "СПбГУ",
}
_DOT_ENTITY = "&dote;"
# An exclamation mark behind the first one, with the text since the one before it.
_LATER_EXCLAMATION = r"((?:^[^!]*!|(?!^)\G)[^!]*)!"
# Dots at both edges of a text that does not end in an ellipsis.
_EDGE_DOTS = r"(?s)^(?!.*\.\.\z)\.+|(?<!\.)\.\z"
_TWO_CAPS = r"[А-ЯЁ-]{2}"
_CAPS_WORD = r"(?U)\b[А-ЯЁ-]{2,}+\b"


def _spellings() -> tuple[dict[str, str], dict[str, str]]:
    """The spelling of each letter that is not dropped, and those of capitals written all in capitals."""
    found = {letter: letter for letter in string.ascii_letters + string.digits + "_."} | {" ": "_"}
    for letter, spelling in (SINGLE_LETTERS | LONG_LETTERS).items():
        if spelling.isalpha():
            found |= {letter: spelling, letter.upper(): spelling.capitalize()}
    return found, {letter.upper(): spelling.upper() for letter, spelling in LONG_LETTERS.items()}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point its kind, spelling and length of that; the last ones are for dropped letters and long capitals in capitals."""
    usual, capitals = _spellings()
    last = max(map(ord, usual)) + 1
    kinds = np.full(last + 1, _OTHER, dtype=np.uint8)
    shown = [usual.get(chr(i), "") for i in range(last + 1)]
    for letter, spelling in usual.items():
        if letter in capitals:
            kinds[ord(letter)] = _LONG_CAPITAL
        elif spelling.isupper():
            kinds[ord(letter)] = _CAPITAL
    shown += [capitals.get(chr(i), "") for i in range(last + 1)]
    letters = np.array([list(s.encode().ljust(4, b"\0")) for s in shown], dtype=np.uint8)
    return kinds, letters.view("<u4").reshape(-1), np.array([len(s) for s in shown], dtype=np.uint8)


def transliterate(text: Column) -> Column:
    """Russian text in Latin letters; everything but ``a-z A-Z 0-9 _ .`` is dropped.

    A capital with a longer spelling is written all in capitals after a capital or before
    one, else only its first letter is. In a run of such letters a capital before the run
    decides for all of them, and one behind it only for the last. The letters of many texts
    are looked up together, in Arrow batches; executors get the code with the task.
    """
    kinds, spellings, lengths = _tables()

    def in_latin(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The Latin forms of some texts one after the other, and the length of each."""
        whole = "\0".join(["", *texts, ""])  # a dropped letter before, between and behind texts
        letter = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        letter = np.minimum(letter, len(kinds) - 1).astype(np.int64)
        kind = kinds[letter]
        long = np.flatnonzero(kind == _LONG_CAPITAL)
        if len(long):
            first = np.diff(long, prepend=-1) != 1
            before = kind[long[first] - 1] == _CAPITAL
            in_capitals = before[np.cumsum(first) - 1] | (kind[long + 1] == _CAPITAL)
            letter[long[in_capitals]] += len(kinds)
        length = lengths[letter]
        found = spellings[letter].view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
        behind = np.cumsum([len(text) + 1 for text in texts], dtype=np.int64)
        return found, np.diff(np.cumsum(length, dtype=np.int64)[behind], prepend=0)

    def batch(texts: pa.Array) -> pa.Array:
        rows = [b"" if row is None else row for row in texts.cast(pa.binary()).to_pylist()]
        group = np.cumsum([len(row) for row in rows], dtype=np.int64) // _TOGETHER
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(rows)]
        parts = [in_latin([row.decode(errors="replace") for row in rows[a:b]]) for a, b in zip(bounds, bounds[1:])]
        ends = np.cumsum(np.concatenate([[0], *(sizes for _, sizes in parts)]), dtype=np.int64)
        content = np.concatenate([found for found, _ in parts])
        latin = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(content)])
        return pc.if_else(texts.is_valid(), latin, pa.scalar(None, pa.large_string())).cast(pa.string())

    return F.arrow_udf(batch, "string")(text)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with_matches(text: Column, pattern: Column, change: Callable[[Column], Column]) -> Column:
    """The text with every match of ``pattern`` replaced by ``change(match)``."""

    def replaced(whole: Column) -> Column:
        changed = F.transform(F.regexp_extract_all(whole, pattern, F.lit(0)), change)
        pairs = F.zip_with(
            F.split(whole, pattern, -1),
            changed,
            lambda gap, match: F.concat(gap, F.coalesce(match, F.lit(""))),
        )
        return F.array_join(pairs, "")

    return _once(text, replaced)


def _any_case(phrase: str) -> str:
    return "(?iu)" + re.escape(phrase)


def clean_title(title: Column, abbreviations: Iterable[str]) -> Column:
    """A title without excess punctuation and words in capitals.

    Runs of blanks become one, the first exclamation mark stays and further ones become
    dots, single dots at the edges go, words in capitals become lower case except the
    ``abbreviations`` (given in capitals), which become upper case, and the first letter is
    a capital. A few phrases are kept as they are. A dictionary that is a table goes to
    :func:`with_clean_titles`.
    """
    return _finished(_with_abbreviations(_lowered(title), abbreviations))


def with_clean_titles(df: DataFrame, title: str, abbreviations: DataFrame, output: str = "title", parts: int = 1) -> DataFrame:
    """``df`` with the clean form of a text column, with the abbreviations in a one-column frame.

    All entries in a title count, overlapping ones too. They are found in one pass by an automaton, or in several of a
    dictionary in ``parts`` (see :func:`~adtally.functions.abbreviations.with_entries_in_capitals`).
    """
    lowered = df.withColumn(output, _lowered(F.col(title)))
    return with_entries_in_capitals(lowered, output, abbreviations, parts).withColumn(output, _finished(F.col(output)))


def _lowered(title: Column) -> Column:
    """A title up to the point where abbreviations are looked up."""
    result = F.regexp_replace(title, r"(?U)\s\s+", " ")
    result = _where(
        result,
        lambda text: F.contains(text, F.lit("!")),
        lambda text: F.regexp_replace(text, _LATER_EXCLAMATION, "$1."),
    )
    guarded = {phrase: phrase.replace(".", _DOT_ENTITY) for phrase in KEPT_PHRASES}
    result = _with_phrases(result, guarded)
    result = F.btrim(result, F.lit(" \t\n\r\x00"))
    result = _where(
        result,
        lambda text: F.startswith(text, F.lit(".")) | F.endswith(text, F.lit(".")),
        lambda text: F.regexp_replace(text, _EDGE_DOTS, ""),
    )
    return _where(
        result,
        lambda text: text.rlike(_TWO_CAPS),
        lambda text: _with_matches(text, F.lit(_CAPS_WORD), F.lower),
    )


def _finished(title: Column) -> Column:
    shown = {phrase.replace(".", _DOT_ENTITY): shown for phrase, shown in KEPT_PHRASES.items()}
    return _with_phrases(_once(title, _with_first_capital), shown)


def _where(text: Column, applies: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` applied only to texts a cheap test finds worth it; others stay as they are."""
    return _once(text, lambda value: F.when(applies(value), change(value)).otherwise(value))


def _with_phrases(text: Column, replacements: dict[str, str]) -> Column:
    """Phrases replaced one after the other in any case, in texts that have one at all."""

    def replaced(value: Column) -> Column:
        for phrase, replacement in replacements.items():
            value = F.regexp_replace(value, _any_case(phrase), replacement)
        return value

    any_phrase = "(?iu)" + "|".join(re.escape(phrase) for phrase in replacements)
    return _where(text, lambda value: value.rlike(any_phrase), replaced)


def _with_first_capital(text: Column) -> Column:
    """The first letter, also behind an opening quotation mark, in upper case."""
    first = F.regexp_extract(text, r'^["«]?[^\n]', 0)
    return F.concat(F.upper(first), F.substr(text, F.length(first) + 1))


def _with_abbreviations(text: Column, abbreviations: Iterable[str]) -> Column:
    """Texts that have an entry at all, with entries in capitals; entries that may overlap are looked for one after the other."""
    entries = list(dict.fromkeys(entry for entry in abbreviations if entry))
    words = [entry for entry in entries if re.fullmatch(r"\w+", entry)]
    patterns = [_any_of(words)] if words else []
    for apart in _without_overlaps([entry for entry in entries if entry not in set(words)]):
        longest = sorted(apart, key=lambda entry: (-len(entry), entry))
        patterns.append(f"(?:{'|'.join(re.escape(entry) for entry in longest)})")
    for pattern in (rf"(?iuU)\b{pattern}\b" for pattern in patterns):
        text = _where(
            text, lambda value: value.rlike(pattern), lambda value: _with_matches(value, F.lit(pattern), F.upper)
        )
    return text


def _without_overlaps(entries: list[str]) -> list[list[str]]:
    """Entries in groups in which no entry ends, from a word's edge on, as another one starts."""
    groups: list[tuple[list[str], set[str], set[str]]] = []
    for entry in entries:
        edges = [m.start() for m in re.finditer(r"\b", entry) if 0 < m.start() < len(entry)]
        starts, ends = {entry[:at] for at in edges}, {entry[at:] for at in edges}
        for group, other_starts, other_ends in groups:
            if not (starts & other_ends or ends & other_starts):
                break
        else:
            groups.append((group := [], other_starts := set(), other_ends := set()))
        group.append(entry)
        other_starts |= starts
        other_ends |= ends
    return [group for group, _, _ in groups]


def _any_of(words: Iterable[str]) -> str:
    """A pattern for one of the words that looks at each common beginning once."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[:1], []).append(word[1:])
    ends = by_first.pop("", None) is not None
    ways = [re.escape(first) + (_any_of(rest) if rest != [""] else "") for first, rest in sorted(by_first.items())]
    return ("(?:" + "|".join(ways) + ")" + "?" * ends) if ways else ""


def without_prefix(text: Column, prefix: str) -> Column:
    rest = F.substr(text, F.lit(len(prefix) + 1))
    return F.when(F.startswith(text, F.lit(prefix)), rest).otherwise(text)


def without_suffix(text: Column, suffix: str) -> Column:
    rest = F.substr(text, F.lit(1), F.length(text) - len(suffix))
    return F.when(F.endswith(text, F.lit(suffix)), rest).otherwise(text)


def tag_without_site(tag: Column) -> Column:
    """Main part of a traffic tag ``tag_SITEID``; other tags are left as they are."""
    return F.regexp_replace(tag, r"^([a-zA-Z0-9_]+)_([0-9]+)\n?\z", "$1")


def squeezed(text: Column) -> Column:
    """Runs of blanks, control characters and no-break spaces become one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"[\x00-\x20\xA0]+", " "))


# The names of entities of HTML 4.01, and numbers up to the last code point.
_ENTITY_NAMES = "|".join(sorted(name2codepoint))
_LAST_DECIMAL = "[0-9]{1,6}|10[0-9]{5}|110[0-9]{4}|111[0-3][0-9]{3}|11140[0-9]{2}|111410[0-9]|111411[01]"
_ENTITY = f"(?:{_ENTITY_NAMES}|#0*(?:{_LAST_DECIMAL})|#[xX]0*(?:[0-9a-fA-F]{{1,5}}|10[0-9a-fA-F]{{4}}));"


def escape_html(text: Column) -> Column:
    """Markup characters as entities; ampersands that already start an entity are kept."""
    result = F.regexp_replace(text, f"&(?!{_ENTITY})", "&amp;")
    for character, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        result = F.replace(result, F.lit(character), F.lit(entity))
    return result
