"""The pipeline against its stages in plain Python, and the registered queries."""

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from adtally.llm.packing import pack
from adtally.llm.quality_rules import quality_rules
from adtally.llm.queries import oracle_sql, queries
from adtally.llm.shared import stored
from adtally.llm.simhash_dedup import similar_documents
from adtally.llm.source_mixing import mixed
from adtally.llm.substring_dedup import substring_dedup

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_works_on_what_the_one_before_kept(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "mixing", "sequences"]

    kept = stages["quality"](spark, given, sf_dir).cache()
    assert kept.columns == DOCUMENT
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules(given).where("kept").collect()}

    single = stages["near_duplicates"](spark, kept, sf_dir).cache()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in similar_documents(kept).collect()}

    unique = stages["repeated_passages"](spark, single, sf_dir).cache()
    wanted = {r.doc_id: r.kept for r in substring_dedup(single, texts=True).collect() if r.n_removed < r.n_words or not r.n_words}
    assert {r.doc_id: r.text for r in unique.collect()} == wanted
    assert all(r.n_chars == len(r.text) for r in unique.collect())

    mix = stages["mixing"](spark, unique, sf_dir).cache()
    assert mix.columns == DOCUMENT
    assert sum(len(r.text.split()) for r in mix.collect()) == sum(r.taken for r in mixed(unique).collect())

    pieces = stages["sequences"](spark, mix, sf_dir).collect()
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in pieces) == sorted((r.doc_id, r.start, r.ids_crc32) for r in pack(mix, tokenizer).collect())
    lengths = {}
    for r in pieces:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert max(lengths.values()) <= 2048 and len(lengths) <= 1.03 * sum(lengths.values()) / 2048 + 1

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in pieces)


def test_queries_are_registered_once_for_each_operator():
    import __spark_entry__

    names = list(queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(oracle_sql()) <= set(names) and set(names) | {"pipeline"} <= set(__spark_entry__.queries())


def test_rows_with_texts_go_to_python_in_small_parts(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(name), spark.range(100, numPartitions=1).mapInArrow(sizes, "n long")
    assert max(r.n for r in stored(rows, 7).collect()) == 7 and spark.conf.get(name) == before
    assert [r.n for r in stored(rows).collect()] == [100]
    spark.conf.set(name, "3")
    try:
        assert max(r.n for r in stored(rows, 7).collect()) == 3 and spark.conf.get(name) == "3"
        spark.conf.set(name, "0")  # no limit
        assert max(r.n for r in stored(rows, 7).collect()) == 7 and spark.conf.get(name) == "0"
    finally:
        spark.conf.set(name, before)
    with pytest.raises(Exception):
        stored(rows.selectExpr("raise_error('no')"), 7)
    assert spark.conf.get(name) == before


def test_repeated_passages_carries_each_text_once(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(1, f"a {passage}", 0, "x", 5), (2, f"{passage} b c", 0, "y", 6), (3, passage, 0, "z", 7), (4, "", 0, "u", 8), (None, passage, 0, "v", 9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, odd string, row long")
    seen = []
    monkeypatch.setattr(corpus_pipeline, "substring_dedup", lambda rows, **more: seen.append(rows.schema) or substring_dedup(rows, **more))
    found = corpus_pipeline.repeated_passages(spark, docs, "")
    assert seen[0].names == ["doc_id", "text", "row"] and seen[0]["row"].dataType.names == ["doc_id", "odd", "row"]
    assert found.columns == docs.columns
    wanted = [(None, passage, len(passage), "v", 9), (1, f"a {passage}", len(passage) + 2, "x", 5), (2, "b c", 3, "y", 6), (4, "", 0, "u", 8)]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0] or 0) == wanted
