"""Single values of the column functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from adtally.functions import abbreviations, numbers, text, urls

ABBREVIATIONS = ["МЧС", "МВД", "МКАД", "Т-72", "ОУН", "ОУН-УПА", "Т50"]


def results(spark, function, values, kind="string"):
    rows = [(number, value) for number, value in enumerate(values)]
    df = spark.createDataFrame(rows, f"n int, x {kind}").select("n", function(F.col("x")).alias("y"))
    return [row.y for row in sorted(df.collect())]


CASES = {
    "lenient_float": (
        numbers.lenient_float,
        [(" 1 234,5 ", 1234.5), ("12abc", 12.0), ("abc", 0.0), ("", 0.0), (None, 0.0), ("-.5e1x", -5.0)],
    ),
    "lenient_int": (
        numbers.lenient_int,
        [
            ("1 234", 1234),
            ("1,5", 1),
            ("", 0),
            (None, 0),
            ("-1.9", -1),
            ("9223372036854775806", 9223372036854775806),
            ("99999999999999999999", 9223372036854775807),
            ("-99999999999999999999", -9223372036854775808),
        ],
    ),
    "lenient_boolean": (
        numbers.lenient_boolean,
        [(None, None), (" false ", False), ("", False), ("0", False), ("0.0", True), ("no", True)],
    ),
    "clean_url": (
        urls.clean_url,
        [
            ("example.com", "http://example.com"),
            ("HTTPS://Example.com/A", "https://Example.com/A"),
            ("http://http://example.com", "http://example.com"),
            ("https://httpbin.org", "http://httpbin.org"),
            ("https://http://httpbin.org", "http://httpbin.org"),
            ("example.com?url=http://test.com", "http://example.com?url=http://test.com"),
            ("ftp://e.com", "http://ftp://e.com"),
            ("http://", None),
            (" \t", None),
            ("0", None),
            (None, None),
        ],
    ),
    "transliterate": (
        text.transliterate,
        [
            ("Жук", "Zhuk"),
            ("ЩУКА", "SHCHUKA"),
            ("АЖЖ", "AZHZH"),
            ("ЖЖ", "ZhZh"),
            ("ЖЖА", "ZhZHA"),
            ("АЪЖа", "AZha"),
            ("Ящик ЯЩИК", "Yashchik_YaSHCHIK"),
            ("объём №1.5", "objom_1.5"),
            ("ЁЖ Ёж ёж", "JoZh_Jozh_jozh"),
            ("А\x01Ж", "AZh"),
            ("", ""),
            (None, None),
        ],
    ),
    "clean_title": (
        lambda column: text.clean_title(column, ABBREVIATIONS),
        [
            ("ВНЕЗАПНО  приехали мчс и мвд!!", "Внезапно приехали МЧС и МВД!"),
            ("Ура!!!", "Ура!.."),
            ("Ждём..", "Ждём.."),
            (".привет.", "Привет"),
            ("...", "..."),
            (".", ""),
            ("квартира 10 кв. м.", "Квартира 10 кв. м."),
            ("кв. м. по цене", "кв. м. по цене"),
            ("леди юга", "Леди Юга"),
            ("учёба в СПБГУ", "Учёба в СПбГУ"),
            ("ИВАН и МКАДе", "Иван и МКАДе"),
            ("АБ- вг", "АБ- вг"),
            ("АБ-вг", "Аб-вг"),
            ("«привет» сказал", "«Привет» сказал"),
            ("танк т-72, т-72м, т50", "Танк Т-72, т-72м, Т50"),
            ("оун-упа и оун", "ОУН-УПА и ОУН"),
            ("раз! два! три!", "Раз! два. три"),
            ("", ""),
            (None, None),
        ],
    ),
    "without_prefix": (
        lambda column: text.without_prefix(column, "@pre@"),
        [("@pre@a@b.c", "a@b.c"), ("a@b.c", "a@b.c"), ("@pre@", "")],
    ),
    "without_suffix": (
        lambda column: text.without_suffix(column, "@suffix"),
        [("a@suffix", "a"), ("a", "a")],
    ),
    "without_empty_suffix": (lambda column: text.without_suffix(column, ""), [("a", "a"), ("", "")]),
    "tag_without_site": (
        text.tag_without_site,
        [("news_15\n", "news"), ("news_15", "news"), ("news_15_7", "news_15"), ("news", "news"), ("_5", "_5"), ("15_", "15_"), ("a-b_5", "a-b_5")],
    ),
    "smart_encode": (
        urls.smart_encode,
        [
            ("http://example.com/привет", "http://example.com/%D0%BF%D1%80%D0%B8%D0%B2%D0%B5%D1%82"),
            ("a b*/c", "a+b%2A/c"),
            ("http://e.com/a?x=1&y=2", "http://e.com/a?x=1&y=2"),
            ("http://e.com/?q=я&z=1", "http://e.com/?q%3D%D1%8F%26z%3D1"),
            ("http://u:p@пример.рф:80/a?b#я", "http://xn--e1afmkfd.xn--p1ai:80/a?b#я"),
            ("http://[::1]:80/é", "http://[::1]:80/%C3%A9"),
            ("http://straße.de/é", "http://xn--strae-oqa.de/%C3%A9"),
            (None, None),
        ],
    ),
    "smart_decode": (
        urls.smart_decode,
        [
            ("a+b%2A/c", "a b*/c"),
            ("http://xn--e1afmkfd.xn--p1ai/%D1%8F", "http://пример.рф/я"),
            ("100%zz%", "100%zz%"),
            ("http://xn--strae-oqa.de/", "http://straße.de/"),
            ("xn--", "xn--"),
            (None, None),
        ],
    ),
    "squeezed": (text.squeezed, [("a \t b ", "a b"), ("\x00\n", "")]),
    "escape_html": (
        text.escape_html,
        [("<b>\"x\" &amp; 'y'", "&lt;b&gt;&quot;x&quot; &amp; &#039;y&#039;"), ("a & b &#12; &#x1F;", "a &amp; b &#12; &#x1F;"),
            ("&foo; &apos; &copy; &#x110000; &#1114112;", "&amp;foo; &amp;apos; &copy; &amp;#x110000; &amp;#1114112;"),
            ("&#x10FFFF; &#01114111; &#; &amp", "&#x10FFFF; &#01114111; &amp;#; &amp;amp"),
        ],
    ),
    "script_name": (urls.script_name, [("/a/b?x=1?y", "/a/b"), ("/a", "/a"), ("/a?b\rc\u2028d", "/a"), ("?a", "?a")]),
}


@pytest.mark.parametrize("name", list(CASES))
def test_value(spark, name):
    function, cases = CASES[name]
    got = results(spark, function, [given for given, _ in cases])
    assert dict(zip([c[0] for c in cases], got)) == dict(cases)


def test_human_bytes(spark):
    cases = {0: "0", 1: "1 B", 1023: "1023 B", 1024: "1 KB", 1536: "1.5 KB", 123456789: "117.74 MB"}
    cases |= {1024**5 - 1: "1 PB", -5: None}
    assert dict(zip(cases, results(spark, numbers.human_bytes, list(cases), "long"))) == cases


def test_visitor_ip(spark):
    rows = [
        ("unknown, 10.0.0.1, 8.8.8.8", True, "10.0.0.1/1.2.3.4"),
        ("::1", True, "1.2.3.4"),
        ("256.1.1.1, 01.2.3.4", True, "1.2.3.4"),
        ("10.0.0.1", False, "1.2.3.4"),
        ("10.0.0.1", None, "1.2.3.4"),
        (None, True, "1.2.3.4"),
    ]
    df = spark.createDataFrame(rows, "forwarded string, trusted boolean, expected string")
    address = urls.visitor_ip(F.lit("1.2.3.4"), F.col("forwarded"), F.col("trusted"))
    assert df.where(~address.eqNullSafe(F.col("expected"))).count() == 0


def titles_with(spark, entries, titles):
    words = spark.createDataFrame([(e,) for e in entries], "word string")
    given = spark.createDataFrame([(t,) for t in titles], "given string")
    return {r.given: r.title for r in text.with_clean_titles(given, "given", words).collect()}


def test_abbreviations_from_a_table(spark):
    entries = ["мчс", " МЧС ", "", None, "т-72", "т50", "а.б$в", "а.б", "$", "оун", "оун-упа"]
    cases = {
        "танк т-72, т-72м, т50": "Танк Т-72, т-72м, Т50",
        "оун-упа и оун": "ОУН-УПА и ОУН",
        "вот мчс и а.б$в, а.б и а.бв": "Вот МЧС и А.Б$В, А.Б и а.бв",
        "МЧС ЕДЕТ": "МЧС едет",
        "без слов": "Без слов",
        "": "",
        None: None,
    }
    assert titles_with(spark, entries, [*cases, "без слов"]) == cases
    listed = [e.strip().upper() for e in entries if e and e.strip() not in ("", "$")]
    frame = spark.createDataFrame([(t,) for t in cases], "given string")
    assert {r.given: r.t for r in frame.select("given", text.clean_title(F.col("given"), listed).alias("t")).collect()} == cases


def test_a_large_dictionary_runs(spark):
    entries = [f"s{i}-t{i}" for i in range(5000)]
    assert titles_with(spark, entries, ["x s7-t7 s7-t8 s4999-t4999"]) == {"x s7-t7 s7-t8 s4999-t4999": "X S7-T7 s7-t8 S4999-T4999"}
    frame = spark.createDataFrame([("x s7-t7 s7-t8",)], "t string")
    assert frame.select(text.clean_title(F.col("t"), [e.upper() for e in entries])).first()[0] == "X S7-T7 s7-t8"


def one_by_one(title, entries):
    """The rule itself: entry after entry is replaced, in any case, where words start or end."""
    for entry in entries:
        title = re.sub(rf"\b{re.escape(entry)}\b", lambda _: entry, title, flags=re.I)
    return title


def test_overlapping_entries_and_entries_with_odd_characters(spark):
    cases = {
        "xx аб-вг-де yy": "Xx АБ-ВГ-ДЕ yy",
        "аб-вг и вг-де, аб-де": "АБ-ВГ и ВГ-ДЕ, аб-де",
        "a\\eb и a+b, [c]d": "A\\EB и A+B, [C]d",
        "й-й-й й-й": "Й-Й-й Й-Й",
    }
    entries = ["АБ-ВГ", "ВГ-ДЕ", "A\\EB", "A+B", "A\\Q", "C]D", "C", "Й-Й"]
    cases["a\\eb и a+b, [c]d"] = "A\\EB и A+B, [C]D"
    assert titles_with(spark, entries, [*cases]) == cases
    frame = spark.createDataFrame([(t,) for t in cases], "given string")
    assert {r.given: r.t for r in frame.select("given", text.clean_title(F.col("given"), entries).alias("t")).collect()} == cases


def test_the_automaton_replaces_as_entry_after_entry_does():
    rng = random.Random(4)
    letters = "абЁйñİx1_-. +$"
    for _ in range(3000):
        entries = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))).upper() for _ in range(6)})
        entries = [e for e in entries if re.search(r"\w", e) and "İ" not in e]
        title = "".join(rng.choice(letters) for _ in range(rng.randrange(25)))
        assert abbreviations.in_capitals(title, abbreviations.automaton(entries)) == one_by_one(title, entries), (title, entries)


def test_a_dictionary_of_a_hundred_thousand_entries(spark):
    words = spark.range(100_000).selectExpr("concat('e', id, '-f', id % 7) AS word")
    titles = spark.range(20_000).selectExpr("id", "concat('0 e', id, '-f', id % 7, '-f', id % 3, ' e', id, '-f8') AS given")
    found = text.with_clean_titles(titles, "given", words, parts=3)
    wrong = found.where("title <> concat('0 E', id, '-F', id % 7, '-f', id % 3, ' e', id, '-f8')")
    assert wrong.count() == 0 and found.count() == 20_000


def spelled_one_by_one(given):
    """The Latin form letter by letter, from the rules as written."""
    usual = text.SINGLE_LETTERS | {k.upper(): v.upper() for k, v in text.SINGLE_LETTERS.items()} | text.LONG_LETTERS | {" ": "_"}
    shown, long, chained = [usual.get(c, c) for c in given], "".join(text.LONG_LETTERS).upper(), False
    is_capital = [len(s) == 1 and "A" <= s <= "Z" for s in shown] + [False]
    for i, c in enumerate(given):
        if c in long:
            chained = chained if i and given[i - 1] in long else i > 0 and is_capital[i - 1]
            spelling = text.LONG_LETTERS[c.lower()]
            shown[i] = spelling.upper() if chained or is_capital[i + 1] else spelling.capitalize()
    return re.sub("[^a-zA-Z0-9_.]", "", "".join(shown))


def test_transliteration_looks_up_many_texts_together(spark):
    """one look-up in Arrow batches instead of chains of replacements and expressions over each text."""
    letters, pick = "аАбБёЁжЖщЩъЪяЯzZ .-\x00\x01ß\u0301😀", random.Random(3)
    given = ["".join(pick.choices(letters, k=pick.randrange(30))) for _ in range(3000)] + ["ЖА" * 300_000, None, "", "Ж"]
    rows = spark.createDataFrame(list(enumerate(given)), "id int, given string").coalesce(2)
    found = rows.select("id", text.transliterate(F.col("given")).alias("latin"))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.latin for r in found.collect()} == {i: None if t is None else spelled_one_by_one(t) for i, t in enumerate(given)}
    assert rows.where("id < 0").select(text.transliterate(F.col("given"))).collect() == []
