"""Token files and packing: exact round trips and invariants."""

import hashlib
import os
import random
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adtally.llm import packing, token_files, tokenizing
from adtally.llm.tokenizing import encoded, load

WORD_BPE, BYTE_BPE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


def ids_of(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def checksum(ids):
    return zlib.crc32(array("I", ids).tobytes())


ODD = [
    "", " ", "\n", "a", " a", "a ", "a\n\nb", "a  b", "x\t y", "x \ty", "don't   stop'll", "Ünï çödé　x", "é e", "<|endoftext|> a<|endoftext|>",
    "1 234  5\n 6", "\x1cA\x1f b", "a b", "\r\n x\r\n", "a" * 700 + " b", "ß İ Σ σς ﬁ", "a ́b", "日本語 テキスト 日本", "🙂 🙂🙂\n🙂",
]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_ids_are_those_of_the_whole_text(path):
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    texts = ODD + ["".join(rng.choice(list("ab'st1. \n\t É")) for _ in range(60)) for _ in range(200)] + [" ".join(ODD), "\n".join(ODD)]
    for _ in range(2):  # the second time words are known
        for text, found in zip(texts, encoded(load(path), texts, 9)):
            assert array("I", found).tolist() == library.encode(text, add_special_tokens=False).ids + [9], repr(text)


def test_packing(documents, nothing):
    rows = packing.pack(documents, WORD_BPE, capacity=100).collect()
    wanted = []
    for r in documents.collect():
        ids = ids_of(WORD_BPE, r.text, 0)
        wanted += [(r.doc_id, at // 100, at, len(ids[at : at + 100]), checksum(ids[at : at + 100])) for at in range(0, len(ids), 100)]
    assert sorted(wanted) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 100
    assert len(sequences) <= 1.1 * sum(r.length for r in rows) / 100 + 1
    assert packing.pack(nothing, WORD_BPE).count() == 0


def test_residual_bins_are_merged_over_rounds(spark):
    lengths = spark.range(4000, numPartitions=20).select("id", (F.pmod(F.xxhash64("id"), F.lit(37)) + 1).alias("length"))
    rows = packing.packed(lengths, 100, 0).collect()
    total = sum(r.length for r in rows)
    assert len(rows) == 4000 and len({r.sequence_id for r in rows}) <= total / 100 * 1.005 + 2
    alone = packing.packed(spark.range(50, numPartitions=9).select("id", F.lit(60).alias("length")), 100).collect()
    assert len({r.sequence_id for r in alone}) == 50


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([50, 70, 30, 45, 20]), 5, 100)
    assert bins.tolist() == [6, 5, 5, 6, 7] and offsets.tolist() == [0, 0, 70, 50, 0]


def test_token_files(spark, documents, nothing, tmp_path):
    docs = documents.select("doc_id", "text").unionAll(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    folder = str(tmp_path / "tokens")
    manifest = token_files.write(docs, folder, BYTE_BPE, partitions=5).collect()
    found = token_files.read(spark, folder).orderBy("start").collect()
    start = 0
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    assert len(found) == len(order)
    for r, wanted in zip(found, order):
        ids = ids_of(BYTE_BPE, wanted.text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (wanted.doc_id, start, len(ids), array("I", ids).tobytes())
        start += len(ids)
    one = next(r for r in order if r.doc_id == 104)
    hits = [x for x in (token_files.read_one(m.path, 104) for m in manifest) if x is not None]
    assert hits == [ids_of(BYTE_BPE, one.text, 2)]
    names = os.listdir(folder)
    dictionary = next(n for n in names if n.endswith(".dict"))
    assert hashlib.sha256((tmp_path / "tokens" / dictionary).read_bytes()).hexdigest() == dictionary.removesuffix(".dict")
    index = pq.read_schema(str(tmp_path / "tokens" / next(n for n in names if n.endswith(".index"))))
    assert index.metadata[b"dictionary"].decode() == dictionary.removesuffix(".dict")
    (tmp_path / "tokens" / dictionary).write_bytes(b"other")
    with pytest.raises(ValueError):
        token_files.read_one(manifest[0].path, 104)
    token_files.write(nothing, str(tmp_path / "none"), BYTE_BPE)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_dictionary_is_trained_and_used(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = str(tmp_path / "tokens")
    token_files.write(docs, folder, BYTE_BPE, partitions=3)
    dictionary = next(n for n in os.listdir(folder) if n.endswith(".dict"))
    assert (tmp_path / "tokens" / dictionary).stat().st_size > 10_000
    assert token_files.read(spark, folder).agg(F.sum(F.octet_length("ids") / 4)).first()[0] == docs.count() + sum(
        len(x) // 4 - 1 for x in encoded(load(BYTE_BPE), [r.text or "" for r in docs.select("text").collect()], 2)
    )


def test_small_corpora_have_a_dictionary_and_places_are_spread(spark, documents, tmp_path):
    assert token_files._dictionary([], 100) == b""
    few = token_files._dictionary([b"abcdefgh" * 9, b"abcd"], 1000)
    assert few == b"abcdefgh" * 9 + b"abcd"
    folder = str(tmp_path / "small")
    name = token_files.train(documents, folder, BYTE_BPE)
    assert os.path.getsize(f"{folder}/{name}.dict") > 0
    begins = {"text": " ".join(["begin"] * 9000 + ["end"] * 9000), "doc_id": 0}
    many = spark.createDataFrame([begins | {"doc_id": i} for i in range(20)], "doc_id long, text string")
    name = token_files.train(many, folder, BYTE_BPE)
    content = open(f"{folder}/{name}.dict", "rb").read()
    begin, end = (array("I", ids_of(BYTE_BPE, f" {w}", 0)[:1]).tobytes() for w in ("begin", "end"))
    assert content.count(begin) > 8 and content.count(end) > 8


def test_rows_of_one_doc_id_are_dealt_over_files(spark, tmp_path):
    docs = spark.range(4000).selectExpr("CAST(7 AS long) AS doc_id", "concat('text ', id) AS text")
    manifest = token_files.write(docs, str(tmp_path / "one"), BYTE_BPE, partitions=6).collect()
    assert len(manifest) == 6 and max(m.documents for m in manifest) < 1500
    assert token_files.read(spark, str(tmp_path / "one")).count() == 4000


def test_stretches_are_cut_without_reading_letters_twice():
    """op3: no part of the pattern gives letters back, and it cuts where the plain one does."""
    plain = re.compile(r"[ \n]*[A-Za-z0-9À-ÖØ-öø-ÿ]+(?=[.,;:!?])|[ \n]*[^ \n]+|[ \n]+")
    encoder, pick = load(BYTE_BPE), random.Random(5)
    assert "MAX_REPEAT" not in str(re._parser.parse(encoder.stretch.pattern))
    texts = ["".join(pick.choices("ab é.,!-\n '×", k=pick.randrange(14))) for _ in range(3000)]
    assert [encoder.stretch.findall(t) for t in texts] == [plain.findall(t) for t in texts]
    odd = ["a\tb c.", "a b", "a　b, c", "a\x85b", "a\x1cb", "", "\n a. "]
    found = encoder.encode(odd, 2)
    assert [array("I", x).tolist() for x in found] == [x.ids + [2] for x in encoder.library.encode_batch_fast(odd, add_special_tokens=False)]


def test_stretches_are_found_in_the_bytes_of_many_texts():
    """op3: texts of an Arrow column are cut together, without a string for each word, where the pattern cuts each alone."""
    encoder, pick = load(BYTE_BPE), random.Random(7)
    letters = [*"aB1 é×÷Àÿ.,#<|-'\n 日🙂", "  ", "\t", "<|endoftext|>", "<|", "word"]
    texts = ["".join(pick.choices(letters, k=pick.randrange(20))) for _ in range(3000)] + ODD
    column = pa.array(["outside ", None, *texts, "", None], pa.string()).slice(1, len(texts) + 2)
    ends = np.cumsum([0, *(len((t or "").encode()) for t in column.to_pylist())])
    data = np.frombuffer("".join(t or "" for t in column.to_pylist()).encode(), dtype=np.uint8)
    wanted = [int(a) + len(t[: m.start()].encode()) for t, a in zip(texts, ends[1:]) for m in encoder.stretch.finditer(t)]
    assert tokenizing._starts(data, ends).tolist() == wanted
    whole = [x.ids for x in encoder.library.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
    for _ in range(2):  # the second time stretches are known
        assert [array("I", x).tolist() for x in encoder.encode(column, 2)] == [ids + [2] for ids in whole]
    assert encoder.encode(column.slice(0, 0), 2) == [] and [len(x) for x in encoder.encode(pa.nulls(2, pa.string()), 2)] == [4, 4]
    for alone in ("abc", "é", "", ",", "\n", "a,"):
        assert array("I", encoder.encode(pa.array([alone]), 2)[0]).tolist() == ids_of(BYTE_BPE, alone, 2)
    assert encoder.stretch.findall(" word### next") == [" word", "###", " next"]
