"""Quality rules as weak supervision: rules vote or abstain, and EM weighs them by how they agree.

Everything is a DataFrame or SQL expression. The rules of a document depend on its own text only. The corpus meets
in the table of vote patterns, which has at most ``3 ** len(RULES)`` rows however large the corpus is; EM runs on it.

Model: a document is good or poor, and each rule votes against it, for it or abstains with rates of its own in
either class. These rates are the rule's accuracy: a rule that many poor documents pass says little by voting for one.
Votes are independent given the class, so the log odds of quality are those of its share plus one term for each vote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.llm.shared import checkpointed

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ROUNDS = 25

@dataclass(frozen=True)
class Rule:
    """Votes against a document whose ``part / whole`` is beyond ``against``, for it if it is beyond ``favour``.

    The larger bound is the upper one. Between them, where a bound is missing or the whole is 0, the rule abstains.
    """

    name: str
    part: str
    whole: str
    against: float
    favour: float | None = None

    def vote(self) -> Column:
        value = F.try_divide(F.col(self.part), F.col(self.whole))
        falling = self.favour is not None and self.favour > self.against
        bad = value <= self.against if falling else value >= self.against
        good = F.lit(False) if self.favour is None else value >= self.favour if falling else value <= self.favour
        return F.when(bad, -1).when(good, 1).otherwise(0)


#: Signs of poor text say nothing when they are missing, so most rules only vote against a document.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.2),
    Rule("marks", "n_marks", "n_words", 0.3, 0.1),
    Rule("plain_words", "n_plain", "n_words", 0.6, 0.75),
    Rule("shouting", "n_upper", "word_chars", 0.4, 0.15),
    Rule("exclaims", "n_exclaims", "n_words", 0.2),
    Rule("repeats", "n_repeat_words", "n_words", 0.1),
    Rule("lines", "n_dup_lines", "n_lines", 0.4),
)

#: Rates that EM starts from, which also enter as one document of either class; the share of good documents.
AGAINST_GOOD, FAVOUR_GOOD, AGAINST_POOR, FAVOUR_POOR = 0.02, 0.6, 0.5, 0.3
FIRST_SHARE = 0.8


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more; ``hashes`` are those of all windows in order."""

    def repeated(pairs: Column) -> Column:
        same = lambda x, i: F.get(pairs, i)["h"] == x["h"]
        twice = F.filter(pairs, lambda x, i: F.coalesce(same(x, i + 1), F.lit(False)) | F.coalesce(same(x, i - 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["at"]))

    def words(places: Column) -> Column:
        new = lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - x, F.lit(WINDOW)))
        return F.aggregate(F.transform(places, new), F.lit(0), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, _once(_once(pairs, repeated), words)).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts of each document's words, symbols and lines, and the whole row as ``row``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long"), text.alias("text"))
    rows = rows.select(
        "row", "doc_id", "text", F.filter(F.split("text", SEPARATORS), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    windows = _once(
        F.col("hashes"),
        lambda h: F.when(
            F.size(h) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    rows = rows.select("*", windows.alias("windows"))
    rows = rows.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("windows")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit(r"!!")).alias("n_exclaims"),
        F.size(F.filter("words", lambda w: F.rlike(w, F.lit(r"^\p{L}+[.,;:!?]?$")))).alias("n_plain"),
        F.size(F.filter("words", lambda w: ~F.rlike(w, F.lit(r"[\p{L}\p{N}]")))).alias("n_marks"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _posterior(votes: Column, state: Column) -> Column:
    def evidence(vote: Column, r: Column) -> Column:
        against, favour = F.log(r["against_good"] / r["against_poor"]), F.log(r["favour_good"] / r["favour_poor"])
        silent = F.log((1 - r["against_good"] - r["favour_good"]) / (1 - r["against_poor"] - r["favour_poor"]))
        return F.when(vote < 0, against).when(vote > 0, favour).otherwise(silent)

    odds = _total(F.zip_with(votes, state["rates"], evidence)) + F.log(state["share"] / (1 - state["share"]))
    return 1 / (1 + F.exp(-odds))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _round(patterns: Column, rules: int):
    """One round of EM: posteriors of the patterns under the state, then the state under the posteriors."""

    def again(posteriors: Column) -> Column:
        good = _total(F.zip_with(patterns, posteriors, lambda x, p: p * x["n"]))
        poor = _total(F.zip_with(patterns, posteriors, lambda x, p: (1 - p) * x["n"]))

        def rates(rule: Column) -> Column:
            def rate(vote: int, weight, total: Column, first: float) -> Column:
                of = lambda x, p: F.when(F.get(x["votes"], rule) == vote, weight(p) * x["n"]).otherwise(0.0)
                return (_total(F.zip_with(patterns, posteriors, of)) + first) / (total + 1)

            is_good, is_poor = lambda p: p, lambda p: 1 - p
            against, favour = rate(-1, is_good, good, AGAINST_GOOD), rate(1, is_poor, poor, FAVOUR_POOR)
            return F.struct(
                against.alias("against_good"),
                F.greatest(rate(1, is_good, good, FAVOUR_GOOD), favour).alias("favour_good"),
                F.greatest(rate(-1, is_poor, poor, AGAINST_POOR), against).alias("against_poor"),
                favour.alias("favour_poor"),
            )

        share = (good + FIRST_SHARE) / (good + poor + 1)
        return F.struct(share.alias("share"), F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), rates).alias("rates"))

    return lambda state, _: _once(F.transform(patterns, lambda x: _posterior(x["votes"], state)), again)


def estimated(patterns: DataFrame, rules: int = len(RULES), rounds: int = ROUNDS) -> DataFrame:
    """One row: share of good documents, rates of the rules, and ``patterns`` (votes, n) as a list.

    ``patterns`` has a row for each combination of votes, ``3 ** rules`` at most. Documents enter as counts.
    """
    rows = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    one = F.struct(
        F.lit(AGAINST_GOOD).alias("against_good"), F.lit(FAVOUR_GOOD).alias("favour_good"),
        F.lit(AGAINST_POOR).alias("against_poor"), F.lit(FAVOUR_POOR).alias("favour_poor"),
    )
    first = F.struct(F.lit(FIRST_SHARE).alias("share"), F.array_repeat(one, rules).alias("rates"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, _round(F.col("patterns"), rules))
    return rows.select("patterns", state.alias("state"))


def posteriors(rows: DataFrame) -> DataFrame:
    """(votes, quality): the probability that documents with these votes are good.

    Rates come from all documents that pass the base rules; the others are settled without them.
    """
    found = estimated(rows.where("NOT base_failed").groupBy("votes").agg(F.count("*").alias("n")))
    found = found.select("state", F.explode("patterns").alias("x"))
    return found.select(F.col("x.votes").alias("votes"), _posterior(F.col("x.votes"), F.col("state")).alias("quality"))


def quality_rules(docs: DataFrame, least_quality: float = 0.5) -> DataFrame:
    """Counts, votes, ``quality`` (posterior probability) and ``kept`` for each row of ``docs`` (doc_id, text).

    ``kept`` is false for rows that fail the base rules (their quality may be null) and else tells whether the quality is at least
    ``least_quality``. A null or empty text has no words and so fails; a null doc_id and repeated rows change
    nothing, each row has its result. More columns are ignored. An empty table gives no rows.
    """
    return judged(checkpointed(voted(docs).drop("row")), least_quality)


def voted(docs: DataFrame) -> DataFrame:
    return measured(docs).withColumn("votes", F.array(*(rule.vote() for rule in RULES)))


def judged(rows: DataFrame, least_quality: float = 0.5) -> DataFrame:
    # at most 3 ** len(RULES) rows, whatever the size of the corpus
    found = rows.join(F.broadcast(posteriors(rows)), "votes", "left")
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("quality") >= least_quality, F.lit(False)))


def kept_documents(docs: DataFrame, least_quality: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Texts are measured twice, for the rates and to choose rows, and neither shuffled nor written. Rows are chosen by their
    votes alone, those that fail the base rules being marked as such in the key, so nothing else of a text is looked at again.
    """
    key = F.array_append("votes", F.col("base_failed").cast("int")).alias("key")
    found = posteriors(checkpointed(voted(docs).select("votes", "base_failed"))).where(F.col("quality") >= least_quality)
    # at most 3 ** len(RULES) rows, whatever the size of the corpus
    kept = F.broadcast(found.select(F.array_append("votes", F.lit(0)).alias("key")))
    return voted(docs).select("row", key).join(kept, "key", "left_semi").select("row.*")
