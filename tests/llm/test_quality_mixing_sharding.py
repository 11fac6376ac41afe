"""Quality rules, mixing and sharding against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest

from adtally.llm.quality_rules import RULES, kept_documents, posteriors, quality_rules
from adtally.llm.sharding import sharded, write_shards
from adtally.llm.source_mixing import mixed, mixed_documents, schedule, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = [False] * len(words)
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered[i : i + 5] = [True] * 5
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(covered)


def test_base_counts(spark, documents):
    more = [(900, "x # y\nx # y\n\n \nz||<b>", "en", "s0"), (901, "a b c d e a b c d e f " * 5, "en", "s0"), (902, "one", "en", "s0")]
    docs = documents.select("doc_id", "text", "lang", "source").unionAll(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    found = {r.doc_id: r for r in quality_rules(docs).collect()}
    for doc_id, text in rows_of(docs):
        r, wanted = found[doc_id], counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        assert r.base_failed == (wanted[0] < 10 or 100 * wanted[4] > 20 * wanted[0])
        assert not (r.kept and r.base_failed)
    assert quality_rules(documents).count() == documents.count() == kept_documents(documents).count() + quality_rules(documents).where("NOT kept").count()
    assert kept_documents(documents).columns == documents.columns


def plain_em(patterns, rounds=25):
    """The same model in plain Python."""
    share, n_rules = 0.8, len(next(iter(patterns)))
    rates = [{"g": (0.02, 0.6), "p": (0.5, 0.3)} for _ in range(n_rules)]

    def posterior(votes):
        odds = math.log(share / (1 - share))
        for v, r in zip(votes, rates):
            pick = {-1: lambda x: x[0], 1: lambda x: x[1], 0: lambda x: 1 - x[0] - x[1]}[v]
            odds += math.log(pick(r["g"]) / pick(r["p"]))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        p = {v: posterior(v) for v in patterns}
        good = sum(p[v] * n for v, n in patterns.items())
        poor = sum((1 - p[v]) * n for v, n in patterns.items())
        new = []
        for j in range(n_rules):
            def rate(vote, weight, total, first):
                return (sum(weight(p[v]) * n for v, n in patterns.items() if v[j] == vote) + first) / (total + 1)

            ga, pf = rate(-1, lambda x: x, good, 0.02), rate(1, lambda x: 1 - x, poor, 0.3)
            gf = max(rate(1, lambda x: x, good, 0.6), pf)
            pa = max(rate(-1, lambda x: 1 - x, poor, 0.5), ga)
            new.append({"g": (ga, gf), "p": (pa, pf)})
        share, rates = (good + 0.8) / (good + poor + 1), new
    return {v: posterior(v) for v in patterns}


def test_em_is_that_of_plain_python(spark):
    patterns = {(-1, 0, 1): 30, (0, 1, 1): 400, (-1, -1, 0): 25, (0, 0, 0): 60, (0, 1, 0): 200, (0, -1, -1): 9}
    patterns = {v + (0,) * (len(RULES) - 3): n for v, n in patterns.items()}
    rows = [(list(v), False) for v, n in patterns.items() for _ in range(n)]
    found = posteriors(spark.createDataFrame(rows, "votes array<int>, base_failed boolean")).collect()
    wanted = plain_em(patterns)
    assert {tuple(r.votes): pytest.approx(r.quality, rel=1e-9) for r in found} == wanted


def test_quality_follows_the_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("quality", "probability").join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    poor = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.995 * len(good) and sum(poor) <= 0.05 * len(poor)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, found = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            return found | {s: left * weight[s] / total for s in open_}
        found |= {s: most * sizes[s] for s in full}
        left, open_ = left - sum(found[s] for s in full), open_ - full
    return found


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 400}, {"a": 0, "b": 0}, {"x": 7}, {f"s{i}": (i * 37) % 50 + 1 for i in range(23)}])
def test_targets_are_those_of_sharing_again_and_again(spark, sizes):
    found = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: pytest.approx(r.target, abs=1e-6) for r in found} == plain_targets(sizes)


def test_mix_takes_the_targets(documents, nothing):
    rows = mixed(documents).collect()
    assert len(rows) == documents.count()
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.size == len(WORD.findall(r.row.text or ""))
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    wanted = plain_targets(size)
    for source in size:
        assert target[source] == pytest.approx(wanted[source]) and abs(taken[source] - target[source]) <= 1
    order = schedule(mixed(documents)).collect()
    finish = [r.virtual_finish for r in order]
    assert finish == sorted(finish) and finish[-1] == 1.0
    assert sum(r.words for r in order) == sum(taken.values())
    half = defaultdict(int)
    for r in order:
        if r.virtual_finish <= 0.5:
            half[r.source] += r.words
    assert all(abs(half[s] - target[s] / 2) <= max(r.size for r in rows if r.source == s) for s in target)
    assert mixed(nothing).count() == 0 and mixed_documents(nothing).count() == 0


def test_mixed_documents_are_whole_or_cut_at_the_budget(documents):
    texts = {d: t for d, t in rows_of(documents)}
    found = mixed_documents(documents)
    assert found.columns == documents.columns
    assert sum(len(WORD.findall(r.text)) for r in found.collect()) == sum(r.taken for r in mixed(documents).collect())
    cut = [r for r in found.collect() if r.text != texts[r.doc_id]]
    assert 0 < len(cut) <= 5
    assert all(r.text.split(" ") == WORD.findall(texts[r.doc_id])[: len(r.text.split(" "))] for r in cut)
    again = mixed(documents.repartition(3, "text"))
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in mixed(documents).collect())


def plain_shards(items, limit):
    import hashlib

    bits = {d: "".join(f"{int(c, 16):04b}" for c in hashlib.md5(str(d if d is not None else "").encode()).hexdigest()) for d, _ in items}
    done, open_ = {}, {"": list(items)}
    while open_:
        prefix, held = open_.popitem()
        if sum(n for _, n in held) <= limit or len({bits[d] for d, _ in held}) == 1:
            done[prefix] = held
            continue
        for bit in "01":
            below = [x for x in held if bits[x[0]][len(prefix)] == bit]
            if below:
                open_[prefix + bit] = below
    return {d: prefix for prefix, held in done.items() for d, _ in held}


@pytest.mark.parametrize("limit, step", [(1 << 20, 12), (4000, 2), (900, 3), (500, 6)])
def test_shards_are_those_of_splitting_bit_by_bit(documents, limit, step):
    items = [(d, len((t or "").encode())) for d, t in rows_of(documents)]
    wanted = plain_shards(items, limit)
    rows = sharded(documents, limit, step).collect()
    total, number = Counter(), Counter(r.shard for r in rows)
    for r in rows:
        total[r.shard] += r.bytes
        assert r.shard.split("-")[0] == wanted[r.doc_id] and r.depth == len(wanted[r.doc_id])
    assert len(rows) == len(items)
    assert all(r.shard_bytes == total[r.shard] for r in rows)
    assert all(total[s] <= limit or number[s] == 1 for s in total)


def test_one_id_with_many_rows_is_divided(spark, nothing, tmp_path):
    docs = spark.createDataFrame([(7, "x" * 50) for _ in range(100)] + [(None, "y" * 30) for _ in range(40)] + [(8, "z" * 500)], "doc_id long, text string")
    rows = sharded(docs, 200, 4).collect()
    total, number = Counter(), Counter(r.shard for r in rows)
    for r in rows:
        total[r.shard] += r.bytes
    assert len(rows) == 141 and all(total[s] <= 200 or number[s] == 1 for s in total)
    assert sharded(nothing).count() == 0
    write_shards(docs.where("doc_id = 8"), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 1


def test_divided_ids_are_written_once_and_within_the_limit(spark, tmp_path):
    given = [(7, f"{i:03d}" + "x" * 47) for i in range(100)] + [(None, f"{i:02d}" + "y" * 28) for i in range(40)] + [(8, "z" * 500)] + [(9 + i, "v") for i in range(30)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    write_shards(docs, str(tmp_path / "shards"), 200)
    rows = spark.read.parquet(str(tmp_path / "shards")).selectExpr("doc_id", "text", "regexp_extract(input_file_name(), 'shard=([^/]*)', 1) AS place").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(given)
    total, number = Counter(), Counter(r.place for r in rows)
    for r in rows:
        total[r.place] += len(r.text)
    assert all(total[s] <= 200 or number[s] == 1 for s in total)


def test_the_budget_cuts_the_order_of_finish_times(spark):
    """Rows without doc_id, one source with nearly all rows, one without words; the order is worked out again in plain Python."""
    rows = [(None if i % 3 else i, " ".join(f"w{i}_{j}" for j in range(1 + i % 7)), "big" if i % 10 else None) for i in range(300)]
    rows += [(None, None, "none"), (None, "", "none"), (None, "", "none"), (5, "x " * 5000, "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixed(docs).collect()
    assert len(found) == len(rows)
    turns = []
    for n, r in enumerate(found):
        goal = math.floor(r.target + 0.5)
        for turn in range(2):
            start = turn * r.source_size + r.before
            end = start + r.size
            for a, b in ((start, min(end, goal)), (max(start, goal), end)):
                if a < b:
                    turns.append((b / goal if goal else math.inf, r.source is None, r.source or "", turn, r.before, b - a, n))
    left, taken = found[0].budget, Counter()
    for *_, words, n in sorted(turns):
        taken[n] += min(words, left)
        left -= min(words, left)
    assert left == 0 and [r.taken for r in found] == [taken[n] for n in range(len(found))]
    for source in {r.source for r in found}:
        assert abs(sum(r.taken for r in found if r.source == source) - next(r.target for r in found if r.source == source)) <= 1
    places = Counter((r.source, r.before) for r in found if r.size)
    assert max(places.values()) == 1
