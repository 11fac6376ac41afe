"""Substring and near-duplicate removal against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from adtally.llm import jaccard_join, simhash_dedup
from adtally.llm.components import components
from adtally.llm.simhash_dedup import BKTree, links, near_duplicates, similar_documents, without_near_duplicates
from adtally.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def repeated(docs, threshold):
    """(doc_id, text) to the words of repeated windows, by looking at every window."""
    seen, found = set(), {}
    for doc_id, text in sorted(set(docs), key=lambda x: (x[0], x[1] or "")):
        words = WORD.findall(text or "")
        covered = [False] * len(words)
        for at in range(len(words) - threshold + 1):
            window = tuple(words[at : at + threshold])
            if window in seen:
                covered[at : at + threshold] = [True] * threshold
            seen.add(window)
        kept = " ".join(w for w, gone in zip(words, covered) if not gone)
        found[doc_id] = (len(words), sum(covered), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return found


@pytest.mark.parametrize("threshold, gram", [(20, 8), (12, 5), (9, 9)])
def test_substring_dedup_is_that_of_all_windows(documents, threshold, gram):
    docs = documents.where("doc_id IS NOT NULL")
    wanted = repeated(rows_of(docs), threshold)
    result = substring_dedup(documents, threshold, gram, texts=True).collect()
    assert len(result) == documents.count()
    for r in result:
        assert (r.n_words, r.n_removed, r.kept_sha256) == wanted[r.doc_id][:3]
        if r.n_removed:
            assert r.kept == wanted[r.doc_id][3]


def test_rows_without_id_neither_lose_nor_remove(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (None, text), (1, text), (2, text), (2, text)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup(docs).collect())
    assert found == [(0, 0), (0, 0), (1, 0), (2, 30), (2, 30)]


def test_empty_tables(nothing):
    assert substring_dedup(nothing).count() == 0
    assert near_duplicates(nothing).count() == 0
    assert without_near_duplicates(nothing).count() == 0


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def grouped(nodes, radius):
    above = {n: n for n in nodes}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= radius:
                above[top(b)] = top(a)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("tree_size", [1, 3, 4096])
def test_near_duplicates_are_the_components_of_all_pairs(documents, tree_size):
    prints = {(d, t): fingerprint(t) for d, t in rows_of(documents)}
    roots = grouped(set(prints.values()), 3)
    least = {}
    for (doc_id, _), value in prints.items():
        least[roots[value]] = min(doc_id, least.get(roots[value], doc_id))
    wanted = sorted((d, f"{v:016x}", least[roots[v]]) for (d, _), v in prints.items())
    found = near_duplicates(documents, tree_size=tree_size)
    assert sorted(set(map(tuple, found.collect()))) == wanted
    assert found.count() == documents.count()


def test_links_connect_a_dense_group(spark):
    values = sorted({0} | {1 << a for a in range(64)} | {1 << a | 1 << (a + 1) % 64 for a in range(64)} | {0xFFFF << 20})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    known = spark.createDataFrame([(v, [v]) for v in signed], "node long, fps array<long>")
    for size in (5, 4096):
        if size > len(values):
            assert links(known, tree_size=size).count() < 16 * len(values)
        above = grouped(values, 3)
        mine = {r.node % (1 << 64): r.root for r in components(links(known, tree_size=size)).collect()}
        groups = {}
        for v in values:
            groups.setdefault(above[v], set()).add(mine.get(v, ("alone", v)))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({next(iter(g)) for g in groups.values()})


def test_bk_tree_finds_what_a_scan_finds():
    values = [i * 0x9E3779B97F4A7C15 % (1 << 12) for i in range(300)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in range(0, 1 << 12, 97):
        assert sorted(tree.within(v, 3)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 3]


def test_components_of_a_path_a_star_and_nulls(spark):
    edges = [(i + 1, i) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (None, 7), (3, 2), (3, 2)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(30)}


def test_one_row_of_each_group_stays(documents):
    least = {r.component_id for r in similar_documents(documents).collect()}
    kept = without_near_duplicates(documents)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least)
    assert kept.columns == documents.columns


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_similar_texts_are_grouped_and_others_left_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    group = {r.doc_id: r.component_id for r in similar_documents(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    holders = {}
    for doc_id, found in sets.items():
        for x in found:
            holders.setdefault(x, []).append(doc_id)
    shared = {}
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    likeness = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
    alike = [pair for pair, x in likeness.items() if x >= 0.8]
    assert all(group[a] == group[b] for a, b in alike)
    near = {x for pair, like in likeness.items() if like >= 0.6 for x in pair}
    assert all(group[d] == d for d in sets if d not in near)


def test_changed_copies_of_one_text_are_one_group(spark):
    import random

    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(w if k != 7 * i else f"x{i}" for k, w in enumerate(words))) for i in range(40)]
    rows += [(100 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))) for i in range(40)]
    for size in (4, 4096):
        found = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), tree_size=size).collect()}
        assert found == {i: 0 for i in range(40)} | {100 + i: 100 + i for i in range(40)}


def grouped_by_likeness(texts):
    """doc_id to the least doc_id that is reached over pairs of a similarity of 0.8, by looking at every pair."""
    sets, above = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and (5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                low, high = sorted((top(a), top(b)))
                above[high] = low
    return {d: top(d) for d in texts}


@pytest.mark.parametrize("tree_size", [2, 4096])
def test_copies_with_blocks_added_or_replaced_are_grouped(spark, tree_size):
    import random

    rng = random.Random(2)

    def block(n):
        return [f"w{int(rng.paretovariate(0.6))}" for _ in range(n)]

    texts, passage = {}, block(30)
    for base in range(40):
        words = block((20, 60, 300, 1000)[base % 4])
        words = words if base % 3 else passage + words
        n = len(words)
        for k, share in enumerate((0.05, 0.1, 0.15, 0.18, 0.2, 0.22, 0.25)):
            more = block(max(round(share * n), 1))
            at, kind = rng.randrange(n - len(more)), (base + k) % 4
            changed = (words + more, more + words, words[:at] + more + words[at:], words[:at] + more[: len(more) // 2] + words[at + len(more) // 2 :])[kind]
            texts[100 * base + 1 + k] = " ".join(changed)
        texts[100 * base] = " ".join(words)
        texts[100 * base + 50] = " ".join(words).upper()
    wanted = grouped_by_likeness(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar_documents(docs, tree_size=tree_size).collect()} == wanted
    assert 40 < len(set(wanted.values())) < 300


def test_groups_are_those_of_all_pairs(documents):
    texts = {d: t for d, t in rows_of(documents)}
    assert {r.doc_id: r.component_id for r in similar_documents(documents).collect()} == grouped_by_likeness(texts) | {d: 300 for d, t in texts.items() if not (t or "").strip()}


def test_rows_without_id_stay_beside_groups(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in without_near_duplicates(docs).collect()) == [0, 0, 3]
    assert {r.component_id for r in near_duplicates(docs).collect()} == {3}
    assert {r.component_id for r in near_duplicates(docs.where(F.col("doc_id").isNull())).collect()} == {None}


def test_texts_that_share_an_id_are_told_apart(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))

    rows = [(1, text("a")), (1, text("b")), (2, text("a")), (3, text("b")), (4, text("c")), (4, text("c"))]
    kept = without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [(1, text("a")), (1, text("b")), (4, text("c"))]


def test_trees_of_a_cell_find_what_comparing_all_sketches_finds():
    """sets of cells, near ones and others, of sizes on both sides of a change of the sketch's length."""
    rng, rows = np.random.default_rng(4), []
    for cell in range(6):
        for size in (3, 30, 34, 60, 66, 300):
            first = rng.integers(0, 1 << 62, size, dtype=np.uint64)
            for changed in (0, 1, size // 12, size // 9, size // 8, size // 3)[: cell + 1]:
                sets = [np.concatenate([first[changed:], rng.integers(0, 1 << 62, new, dtype=np.uint64)]) for new in (changed, 0)]
                sets.append(rng.integers(0, 1 << 62, size + 5, dtype=np.uint64))
                rows += [(cell, len(rows) + i, len(s), jaccard_join._sketches(s, np.array([len(s)]))[0].as_py()) for i, s in enumerate(sets) if len(s)]
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["cell", "node", "n", "sketch"]) for part in (rows[:40], rows[40:])]
    for share in (60, 80, 95):
        found, wanted = (
            [r for b in near(share)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))] for near in (simhash_dedup._in_trees, jaccard_join._near)
        )
        assert found == wanted and 0 < len(found) < len(rows)


def test_the_stage_searches_cells_with_trees(documents, monkeypatch):
    """the stage of the pipeline goes through BK-trees and keeps one row of each group."""
    asked, in_trees = [], simhash_dedup._in_trees
    monkeypatch.setattr(simhash_dedup, "_in_trees", lambda share: asked.append(share) or in_trees(share))
    kept = without_near_duplicates(documents).select("doc_id").collect()
    assert asked == [simhash_dedup.SIMILAR]
    assert {r.doc_id for r in kept} == {r.component_id for r in similar_documents(documents).collect()}
