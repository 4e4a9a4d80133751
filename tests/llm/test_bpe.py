from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylattice.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.vocabulary_text(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_equal_the_library(vocabulary, library):
    pick = random.Random(5)
    parts = [*"ab't  \n\t'sré1٣ⅷ²<|endoftext|>  \x1c\x85漢 é😀!?dml'", "<|endoftext|>", "aaaa", "    ", "'ll", "'re", "thth"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(0, 40))) for _ in range(4000)]
    encoder = bpe.Encoder(vocabulary)
    for half in (texts[:2000], texts[2000:]):
        ids, ends = encoder.encode(half)
        for k, text in enumerate(half):
            assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_long_runs_and_forgetting(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 0)
    encoder = bpe.Encoder(vocabulary)
    texts = ["a" * 50_001, "ab" * 20_000 + " ", None, "", "=" * 777]
    for _ in range(2):
        ids, ends = encoder.encode(texts)
        for k, text in enumerate(texts):
            expected = library.encode(text, add_special_tokens=False).ids if text else []
            assert ids[ends[k] : ends[k + 1]].tolist() == expected


def test_round_trip_through_spark(spark, library):
    rows = [(1, "The thing.\nIt's 12  here ", "x"), (2, None, "y"), (3, "", None), (4, "<|endoftext|> a", "z"), (4, "<|endoftext|> a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = bpe.decode(bpe.encode(df, PATH, decoded="back"), PATH, decoded="again").collect()
    assert len(got) == len(rows)
    for row in got:
        text = row.text or ""
        assert list(row.ids) == library.encode(text, add_special_tokens=False).ids
        assert row.back == text == row.again
    assert bpe.encode(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(df.withColumn("ids", F.lit(1)), PATH)


def test_decode_of_cut_characters(spark, vocabulary, library):
    ids = library.encode("é漢", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "k long, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got == {1: library.decode(ids[:1], skip_special_tokens=False), 2: "", 3: ""}


def test_halves_of_one_character_in_neighbouring_rows(spark, vocabulary):
    ids = {bytes(vocabulary.decode(np.array([k]), np.array([0, 1]))[0]): k for k in range(300)}
    df = spark.createDataFrame([(1, [ids[b"\xc3"]]), (2, [ids[b"\xa9"]]), (3, [ids[b"a"]])], "k long, ids array<int>").coalesce(1)
    got = {r.k: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got == {1: "\ufffd", 2: "\ufffd", 3: "a"}


def test_query_digests(spark, library, tmp_path):
    from skylattice.llm.queries import op1_bpe

    rows = [(k, "Some text, number %d. " % k * k) for k in range(30)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in op1_bpe(spark, str(tmp_path)).collect():
        text = dict(rows)[row.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_overlapping_pairs_merge_left_to_right(vocabulary, library):
    words = [b"a" * n for n in range(1, 40)] + [b"abab" * 3, b"\xc3"]
    ids, offsets = vocabulary.encode_words(words)
    flat, cuts = vocabulary.decode(ids, offsets)
    assert [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] == words
    for k in range(39):
        expected = library.encode("a" * (k + 1), add_special_tokens=False).ids
        assert np.array_equal(ids[offsets[k] : offsets[k + 1]], expected)
