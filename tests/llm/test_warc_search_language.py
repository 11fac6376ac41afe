"""WARC archives, exact search and language identification."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adtally.llm import language_id, topk_search, warc
from adtally.llm.queries import held_out
from adtally.llm.topk_search import top_k
from adtally.llm.words import words


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}é</p>" * (i % 7)) for i in range(30)]
    rows += [(40, None, None), (41, "http://x/41", ""), (42, "u", "long " * 60_000), (None, "v", "alone"), (None, "w", "long " * 60_000), rows[3], rows[3]]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))


@pytest.mark.parametrize("compress", [True, False])
def test_captures(spark, pages, tmp_path, compress):
    folder = str(tmp_path / "warc")
    warc.register(spark)
    warc.records_of(pages).repartition(3).write.format("warc").option("compress", str(compress)).mode("append").save(folder)
    found = sorted(map(tuple, warc.captures(spark, folder).collect()), key=repr)
    held = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    latest = {}
    for page, payload in held:
        latest[payload] = max((x for x in (latest.get(payload), page) if x is not None), default=None)
    wanted = []
    for page, payload in held:
        last = latest[payload]
        again = last is not None and page != last
        wanted.append((page, len(payload), digest(payload), "revisit" if again else "response", last if again else None))
    assert found == sorted(wanted, key=repr)


def test_headers_are_pushed_down_and_payloads_skipped(spark, pages, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write(pages, folder)
    rows = warc.read(spark, folder)
    assert rows.where("warc_type = 'revisit'").where("payload IS NOT NULL").count() == 0
    assert rows.where("target_uri = 'http://x/29'").select("page_id").first().page_id == 29
    assert rows.where("warc_type IN ('response', 'revisit') AND refers_to IS NULL").where("warc_type = 'revisit'").count() == 0
    assert warc.read(spark, folder, payload=False).where("payload IS NOT NULL").count() == 0
    plan = rows.where("warc_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]


def test_records_are_read_by_headers_first():
    blocks = [warc.record("response", i, f"u{i}", hashlib.sha1(b"x" * i).hexdigest(), None, i, b"x" * i) for i in range(3)]
    damaged = blocks[1].replace(b"\r\n\r\nx\r\n\r\n", b"\r\n\r\ny\r\n\r\n")
    for source in (io.BufferedReader(io.BytesIO(b"".join(blocks))), gzip.GzipFile(fileobj=io.BytesIO(b"".join(map(gzip.compress, blocks))))):
        got = list(warc.records(source, lambda row: row["target_uri"] != "u1"))
        assert [(r["page_id"], r["payload"]) for r in got] == [(0, b""), (2, b"xx")]
    assert len(list(warc.records(io.BytesIO(blocks[0] + damaged + blocks[2]), lambda row: row["page_id"] != 1))) == 2
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(damaged), lambda row: True))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"HTTP/1.1 200 OK\r\n"), lambda row: True))


def test_least_bytes_and_empty_tables(spark, pages, tmp_path):
    kinds = {r.page_id: r.kind for r in warc.records_of(pages, 100).collect()}
    assert kinds[7] == kinds[14] == "response"
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.captures(spark, str(tmp_path / "none")).count() == 0


def best(rows, k):
    usable = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    found = []
    for q, x in usable:
        if q % 5 == 0:
            scores = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q and len(x) == len(y)]
            found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(found)


@pytest.mark.parametrize("block, slices, k", [(4096, 4, 3), (7, 2, 10), (16, 5, 1), (9, 1, 4)])
def test_search_is_that_of_all_scores(spark, block, slices, k):
    rng = random.Random(block)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.126, -0.001]) for _ in range(6)]) for i in range(60)]
    rows += [(70, None), (75, [None] + [0.1] * 5), (80, [float("nan")] * 6), (85, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (90, [0.5, 0.5]), (91, [0.1, -0.5])]
    rows += [(95, [-0.9] * 6), rows[5], rows[6], (96, [1e9] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("clash"))
    found = top_k(frame.repartition(3), F.col("vec_id") % 5 == 0, k, slices, block)
    assert sorted(map(tuple, found.collect())) == best(rows, k)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [8e5, 0.001]), (2, [8e5, 0.002]), (3, [-8e5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(frame, F.col("vec_id") == 0, 2).collect()
    big = 1024 * 10**6 * 1024 * 8 * 10**5
    assert [(r.vec_id, r.score) for r in found] == [(2, big + 2 * 1024), (1, big + 1024)]
    assert top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_local_scores_are_worked_out_a_slice_of_queries_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    shapes, whole = [], topk_search._local
    monkeypatch.setattr(topk_search, "_local", lambda q, r, n: shapes.append((len(q), len(r))) or whole(q, r, n))
    numbers = rng.integers(-1000, 1000, (600, 8)).astype(float)
    tables = [pa.table({"vector": pa.array(list(m))}) for m in (numbers, numbers[:50])]
    found = list(topk_search._asked(*tables, 3))
    assert [at for at, _ in found] == list(range(600))
    assert max(q for q, _ in shapes) == topk_search.TOGETHER and sum(q for q, _ in shapes) == 600
    assert (np.stack([x.sum(axis=0) for _, x in found]) == numbers @ numbers[:50].T).all()


def test_messages_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 3, 7, 8])
    scores, moves = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    found = language_id.posteriors(*language_id.messages(scores, moves, first))
    for a, b in zip(first, first[1:]):
        paths = np.stack(np.meshgrid(*[range(3)] * (b - a), indexing="ij"), -1).reshape(-1, b - a) if b > a else np.zeros((0, 0), int)
        weight = np.zeros(len(paths))
        for n, path in enumerate(paths):
            start = np.exp(moves)[:, path[0]].mean()
            weight[n] = start * np.exp(sum(scores[a + t, s] for t, s in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
        for t in range(b - a):
            wanted = np.array([weight[paths[:, t] == s].sum() for s in range(3)]) / weight.sum()
            assert np.allclose(found[a + t], wanted)


@pytest.mark.parametrize("length", [1, 63, 64, 65, 500])
def test_segments_change_nothing(monkeypatch, length):
    rng = np.random.default_rng(length)
    first = np.array([0, length, length + 5])
    scores, moves = 3 * rng.normal(size=(length + 5, 4)), rng.normal(size=(4, 4))
    found = language_id.posteriors(*language_id.messages(scores, moves, first))
    monkeypatch.setattr(language_id, "SEGMENT", 10_000)
    assert np.allclose(found, language_id.posteriors(*language_id.messages(scores, moves, first)))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert docs.where(held_out(F.col("doc_id"))).count() == sum(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs.select("doc_id").collect())
    model = language_id.fit(language_id.sample(docs.where(~held_out(F.col("doc_id"))), documents=60))
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "12 34 !!"), (-2, "12 34 !!"), (-3, "the and of " * 9000)], "doc_id long, text string")
    found = language_id.identify(docs.select("doc_id", "text").unionAll(odd), model).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    tested = [r for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.98 * len(tested)
    assert [(r.lang_pred, r.score) for r in found if r.doc_id in (None, -1, -2)] == [("und", 0.0)] * 4
    assert next(r for r in found if r.doc_id == -3).lang_pred == "en" and all(0 <= r.score <= 1 for r in found)

    parts = {lang: next(r.text.split()[:30] for r in docs.collect() if r.lang == lang and r.text and len(r.text.split()) > 40) for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, " ".join(parts["en"] + parts["de"])), (2, None)], "doc_id long, text string")
    runs = sorted(map(tuple, language_id.switches(mixed, model).collect()))
    assert runs[0][1] == 0 and runs[-1][2] == 59 and {r[3] for r in runs} >= {"en", "de"}
    right = sum(("en" if i < 30 else "de") == r[3] for r in runs for i in range(r[1], r[2] + 1))
    assert right >= 54


def test_no_labels_no_language(spark, nothing):
    model = language_id.fit(language_id.sample(nothing))
    assert model is None
    assert language_id.identify(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), None).first().lang_pred == "und"


def test_words_of_bytes():
    import pyarrow as pa

    found = words(pa.array(["a  bé\x0bc", None, "", " x", "y"]))
    assert [found.data.tobytes()[a:b].decode() for a, b in zip(found.starts, found.ends)] == ["a", "bé", "c", "x", "y"]
    assert found.row.tolist() == [0, 0, 0, 3, 4] and found.first.tolist() == [0, 3, 3, 3, 4, 5]
