"""Hard negatives, the Jaccard join and phrases against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adtally.llm import phrases
from adtally.llm.hard_negatives import Rows, hard_negatives, primes, products
from adtally.llm.jaccard_join import InvertedIndex, similar_sets
from adtally.llm.phrases import LONGEST, Subtree, collocations
from adtally.llm.shared import mapped

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# hard negatives


def exact(vector, scale=256):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return tuple(math.floor(x * scale) for x in vector)


def brute_negatives(rows, positives, negatives, asks):
    known = [(i, label, exact(v)) for i, v, label in rows if i is not None and label is not None and exact(v) is not None]
    found = []
    for i, label, v in sorted({r for r in known if asks(r[0])}):
        scored = [(-sum(map(int.__mul__, v, w)), j, other) for j, other, w in known if len(w) == len(v)]
        for score, positive, _ in sorted(s for s in scored if s[2] == label and s[1] != i)[:positives]:
            inside = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score]
            found += [(i, positive, rank, s[1], -score, -s[0]) for rank, s in enumerate(sorted(inside)[:negatives], 1)]
    return sorted(found)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) + 0.2 for _ in range(6)], rng.randrange(3)) for i in range(150)]
    rows += [(i, rows[i - 200][1], rng.randrange(3)) for i in range(200, 230)]  # ties
    rows += [rows[5], rows[5], rows[10], (None, rows[1][1], 1), (300, None, 1), (301, [0.1, None, 0.3, 0.1, 0.1, 0.1], 1), (302, rows[2][1], None)]
    rows += [(303, [float("nan")] * 6, 2), (304, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 2), (305, [0.5, 0.5], 1), (310, [0.4, 0.5], 1), (306, [0.3, 0.3], 2), (320, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("anchor", "rank", "rb", "dims", "vector", "score"):
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame.repartition(3), rows


@pytest.mark.parametrize("anchor_block, row_block", [(2048, 8192), (7, 20)])
def test_negatives_are_those_of_all_scores(vectors, anchor_block, row_block):
    frame, rows = vectors
    found = hard_negatives(frame, F.col("vec_id") % 10 == 0, 4, 3, anchor_block=anchor_block, row_block=row_block)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, 4, 3, lambda i: i % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_no_vectors_no_negatives(vectors):
    assert hard_negatives(vectors[0].limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("dims, most", [(1, 3), (64, 200), (300, 90), (1000, 1 << 20), (5, 1 << 29), (3, (1 << 31) - 5)])
def test_products_in_residues_are_exact(dims, most):
    rng = np.random.default_rng(dims)
    a, b = (rng.integers(-most, most, (n, dims), endpoint=True) for n in (300, 7))
    wanted = a.astype(object) @ b.astype(object).T
    if max(abs(x) for x in wanted.ravel()) >= 1 << 63:
        with pytest.raises(OverflowError):
            list(products(Rows(a.astype(float)), Rows(b.astype(float))))
        return
    found = np.concatenate([scores for _, scores in products(Rows(a.astype(float)), Rows(b.astype(float)))])
    assert (found.astype(object) == wanted).all()


def test_residues_fit_float32():
    for dims in (1, 2, 64, 256, 5000):
        for p in primes(dims, 1 << 40):
            assert min(dims, 256) * (p // 2) ** 2 < 1 << 24
            assert all(p % k for k in range(2, math.isqrt(p) + 1))
    assert math.prod(primes(64, 1 << 40)) > 1 << 41


# the Jaccard join


def shingle_set(text, size):
    words = WORD.findall(lowered(text))
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset()


def brute_components(rows, size, share):
    sets = [shingle_set(t, size) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= share * len(a | b):
                above[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(rng, n, length, changed, first):
    """Texts that differ from one in some words or in a block at the end."""
    base = [f"v{rng.randrange(5000)}" for _ in range(length)]
    found = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(changed + 1)):
            words[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
        if i % 3 == 0:
            words += [f"e{rng.randrange(10**6)}" for _ in range(rng.randrange(length // 9))]
        found.append((first + i, " ".join(words)))
    return found


@pytest.mark.parametrize("size, share, part", [(3, 90, 1 << 20), (3, 90, 400), (3, 70, 250), (2, 51, 900), (5, 100, 300)])
def test_components_are_those_of_all_pairs(spark, documents, size, share, part):
    rng = random.Random(8)
    rows = near_copies(rng, 40, 90, 4, 1000) + near_copies(rng, 25, 40, 5, 2000) + near_copies(rng, 12, 300, 12, 3000)
    rows += [(4000 + i, f"Some Words {i % 3}") for i in range(9)] + [(4100, "two words"), (4101, "TWO  words"), (4102, "a"), (4103, "a"), (4104, "a a a a"), (4105, "a a a")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = [c for c in documents.columns if c not in ("doc_id", "text")]
    docs = documents.unionByName(more.selectExpr("*", *(f"'x' AS `{c}`" for c in clashing)))
    docs = docs.selectExpr("*", "'clash' AS node", "'clash' AS n", "'clash' AS key", "'clash' AS cell", "'clash' AS bucket")
    found = similar_sets(docs, size, share, part)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    everything = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(everything, size, share)


def test_rows_without_doc_id_link_and_empty_tables_stay_empty(spark, nothing):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (7, text + " x"), (5, text + " x y"), (None, "alone here now"), (None, None), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, similar_sets(docs).collect()), key=repr)
    assert found == sorted([(None, 58, 5), (7, 59, 5), (5, 60, 5), (None, 1, None), (None, 0, None), (9, 0, 9), (9, 0, 9)], key=repr)
    assert similar_sets(nothing).count() == 0


@pytest.mark.parametrize("share", [55, 80, 90, 100])
def test_search_finds_all_sets_that_overlap_enough(share):
    rng = np.random.default_rng(share)
    base = np.unique(rng.integers(0, 500, 120))
    sets = [np.unique(np.where(rng.random(len(base)) < rng.choice([0, 0.02, 0.1, 0.3]), rng.integers(500, 900, len(base)), base)) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 900, 30)) for _ in range(20)] + [np.array([5]), np.array([5, 6])]
    index = InvertedIndex(sets)
    for s in sets:
        found = sorted(index.search(s, share, lambda at: np.ones(len(at), bool)))
        assert found == [i for i, x in enumerate(sets) if 100 * len(np.intersect1d(s, x)) >= share * len(np.union1d(s, x))]
    assert list(InvertedIndex([]).search(sets[0], share, lambda at: at >= 0)) == []


# phrases


def brute_phrases(rows, least, first):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, LONGEST + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = []
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = {(lang, p[i:j]): 0 for (lang, p) in candidates for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p)}
    for (lang, p), a in candidates.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], a)
    for (lang, p), a in candidates.items():
        if inside.get((lang, p), 0) >= a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], totals[lang]))
    result, rank = [], Counter()
    for lang, score, a, phrase, l, r, n in sorted(found):
        rank[lang] += 1
        if rank[lang] <= first:
            result.append((lang, rank[lang], phrase.decode(), -a, l, r, n, -score))
    return sorted(result)


@pytest.mark.parametrize("least, first, budget", [(3, 2000, 1 << 18), (2, 2000, 40), (4, 25, 10)])
def test_phrases_are_those_of_all_runs(spark, documents, least, first, budget):
    rng = random.Random(2)
    letters = ["a", "B", "ß", "É", "the", "of", "zu", "x-y", "#", "q"]

    def text(n):
        return "".join(rng.choice(letters) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for _ in range(n))

    rows = [(None if i % 7 == 0 else ("en", "de", "fr")[i % 3], text(rng.randrange(1, 120))) for i in range(60)]
    rows += [("en", "a a a a a a a a " * 20), ("en", "new york city of the of the"), ("en", "new york city; new york city, NEW YORK city")]
    rows += [("es", None), ("es", ""), (None, ",;.\n"), ("it", "uno due tre"), ("it", "uno due tre"), ("it", "uno due tre"), ("it", "uno due tre")]
    more = spark.createDataFrame(rows, "lang string, text string")
    docs = documents.unionByName(more, allowMissingColumns=True).selectExpr("*", "'clash' AS h", "'clash' AS n", "'clash' AS `group`", "'clash' AS w1")
    found = collocations(docs.repartition(3), least, first, budget)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    everything = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert sorted(map(tuple, found.collect())) == brute_phrases(everything, least, first)


def test_no_texts_no_phrases(nothing):
    assert collocations(nothing).count() == 0


def test_workers_get_few_texts_at_once(spark, monkeypatch):
    def watched(df, batches, schema):
        def few(rows):
            for batch in rows:
                if len(batch) > 1000:
                    raise ValueError(f"{len(batch)} rows at once")
                yield batch

        return mapped(df, lambda rows: batches(few(rows)), schema)

    monkeypatch.setattr(phrases, "mapped", watched)
    docs = spark.range(0, 2500, 1, 1).selectExpr("'a b c' AS text", "'en' AS lang")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(map(tuple, collocations(docs).collect())) == [("en", 1, "a b c", 2500, 2500, 2500, 7500, 3000)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_suffixes_are_put_out_in_small_batches(nothing, monkeypatch):
    monkeypatch.setattr(phrases, "mapped", lambda df, batches, schema: batches)
    frequent = np.full(phrases.BITS // 8, 255, np.uint8)
    texts = [" ".join(f"w{row}-{i % 90_000}" for i in range(100_000)) for row in range(6)]
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts))], names=["text", "lang"])
    batches = list(phrases.suffixes(nothing, frequent, frequent)(iter([rows])))
    assert max(b.column("content").nbytes for b in batches) < 4 << 20
    suffixes = phrases._suffixes([x for b in batches for x in b.column("content").to_pylist()])
    assert sum(b.column("suffixes").to_numpy().sum() for b in batches) == len(suffixes)
    assert suffixes[:, -1].sum() == 6 * 99_999


def test_fragments_are_divided_together():
    rng = np.random.default_rng(7)
    suffix = np.zeros((20_000, LONGEST + 2), np.uint64)
    suffix[:, 0], suffix[:, 1], suffix[:, 2] = 9, rng.integers(1, 51, 20_000), rng.integers(1, 1 << 40, 20_000)
    suffix[:, -2:] = 3, 1
    content = [x.tobytes() for x in np.split(suffix, 200)]
    found = list(phrases._longer(2)(iter(pa.RecordBatch.from_arrays([pa.array(content[a : a + 50])], names=["content"]) for a in range(0, 200, 50))))
    assert sum(map(len, found)) <= 50
    after = phrases._suffixes([x for b in found for x in b.column("content").to_pylist()])
    assert sorted(map(tuple, after.tolist())) == sorted(map(tuple, suffix.tolist()))
    assert list(phrases._longer(2)(iter([]))) == []


def test_few_hashes_are_held():
    rng = np.random.default_rng(6)
    held, most, total = phrases._Counts(), 0, 0
    for last in [False] * 20 + [True]:
        held.add(rng.integers(0, 1 << 40, 1 << 16).astype(np.uint64))
        most = max(most, held.rows)
        if held.full() or last:
            total += held.taken()[1].sum()
    assert total == 21 << 16 and most < 1 << 19


def test_subtree_reads_counts_from_its_leaves():
    leaves = [((1, 2), 3), ((1, 2, 3), 4), ((1, 2, 3, 4), 5), ((1, 2, 5), 1), ((1, 3, 3), 2), ((2, 2, 3), 7), ((2, 2, 3), 1)]
    suffix = np.array([list(p) + [0] * (4 - len(p)) for p, _ in leaves], dtype=np.uint64)
    tree = Subtree(suffix, np.array([len(p) for p, _ in leaves]), np.array([n for _, n in leaves]))
    for level in range(1, 5):
        wanted = Counter()
        for p, n in leaves:
            if len(p) >= level:
                wanted[p[:level]] += n
        found, totals = tree.nodes(level)
        assert dict(zip(map(tuple, found.tolist()), totals.tolist())) == wanted
