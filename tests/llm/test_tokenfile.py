from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skylattice.llm import tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400), st.integers(1, 3))
def test_any_ids_come_back(ids, repeat):
    values = np.array(ids * repeat, np.uint64)
    words, block_words, escapes = tokenfile.pack(values)
    assert np.array_equal(tokenfile.unpack(words, block_words, escapes, len(values)), values)


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 4095, 4096, 4097, 9000])
def test_block_borders(n):
    for values in (np.zeros(n, np.uint64), np.arange(n).astype(np.uint64) % 7, np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint64)):
        words, block_words, escapes = tokenfile.pack(values)
        assert np.array_equal(tokenfile.unpack(words, block_words, escapes, n), values)
        assert len(words) <= n


def test_packing_is_greedy_and_small():
    words, _, _ = tokenfile.pack(np.ones(60, np.uint64))
    assert len(words) == 1
    words, _, _ = tokenfile.pack(np.full(30, 50_000, np.uint64))
    assert len(words) == 10


def test_payload_round_trip():
    ids = np.array([5, 6, 2, 2, 70_000, 2], np.uint32)
    raw = tokenfile.write_payload(pa.array([1, None, 3]), np.array([3, 4, 6]), ids)
    names, ends, back = tokenfile.read_payload(raw)
    assert names.to_pylist() == [1, None, 3]
    assert ends.tolist() == [0, 3, 4, 6]
    assert back.tolist() == ids.tolist()
    with pytest.raises(ValueError, match="token file"):
        tokenfile.read_payload(b"other" * 9)


def test_files_equal_the_library(spark, tmp_path, monkeypatch):
    library = Tokenizer.from_file(PATH)
    docs = [(k * 7 % 101, "Some text. " * (k % 13) + f"it's <|endoftext|> {k}  x") for k in range(101)] + [(500, None), (501, ""), (None, "no id"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int").repartition(4)
    tokenfile.write_token_files(df, PATH, f"{tmp_path}/f")
    got = sorted((tuple(r) for r in tokenfile.read_documents(spark.read.parquet(f"{tmp_path}/f")).collect()), key=lambda r: r[1])
    place = 0
    assert [r[0] for r in got] == sorted((d[0] for d in docs), key=lambda x: (x is not None, x or 0))
    texts = {}
    for key, text in docs:
        texts.setdefault(key, []).append(text)
    for key, start, n, crc in got:
        options = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[key]]
        assert (n, crc) in {(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in options}
        assert start == place
        place += n


def test_empty_table(spark, tmp_path):
    tokenfile.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, f"{tmp_path}/f")
    assert tokenfile.read_documents(spark.read.schema(tokenfile.FILES).parquet(f"{tmp_path}/f")).count() == 0


PIECES = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\u00a0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u2029", "\u202f", "\u205f",
          "\u3000", "\ufeff", "a", "Word", "it's", "'", "s", "9", "2024", ".", "?!", "é", "e\u0301", "中文", "😀", "\x00", "<|endoftext|>", "<|endo", "ftext|>"]


@pytest.fixture(scope="module")
def encoder():
    return tokenfile.LibraryEncoder(tokenfile.vocabulary_text(PATH))


def whole(encoder, texts):
    return [encoder._library.encode(t or "", add_special_tokens=False).ids for t in texts]


def rows(flat, ends):
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=6), forget=st.booleans())
def test_columns_get_the_ids_of_whole_texts(encoder, texts, forget):
    if forget:
        encoder._forget()
    assert rows(*encoder.encode_column(pa.array(texts, pa.string()))) == whole(encoder, texts)


def test_every_white_space_beside_a_cut(encoder):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = [t for s in spaces for t in (f"a {s}b c", f"a{s} b c", f"a b{s}", f"{s}a b", f"{s} a", f"a {s}", s, f"a b{s}c d", f"x{s}{s}y z")]
    encoder._forget()
    assert rows(*encoder.encode_column(pa.array(texts))) == whole(encoder, texts)


class Counted:
    def __init__(self, library):
        self.library, self.texts = library, []

    def encode_batch_fast(self, texts, **options):
        self.texts.extend(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_the_library_gets_few_texts_and_each_unit_once(monkeypatch):
    encoder = tokenfile.LibraryEncoder(tokenfile.vocabulary_text(PATH))
    counted = Counted(encoder._library)
    monkeypatch.setattr(encoder, "_library", counted)
    words = [f"u{k}, v.{k}" for k in range(3_200)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 3_200, 50)]
    got = rows(*encoder.encode_column(pa.array(texts)))
    assert len(counted.texts) <= 6_400 / tokenfile.JOINED + len(texts) + 2
    assert sum(map(len, counted.texts)) <= len(" ".join(words)) + sum(len(t.split(" ", 1)[0]) for t in texts) + 1
    seen = len(counted.texts)
    assert rows(*encoder.encode_column(pa.array(texts[::-1]))) == got[::-1]
    assert len(counted.texts) == seen
    assert got == [counted.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_units_go_one_by_one_where_tokens_are_not_their_bytes(monkeypatch):
    encoder = tokenfile.LibraryEncoder(tokenfile.vocabulary_text(PATH))
    counted = Counted(encoder._library)
    monkeypatch.setattr(encoder, "_library", counted)
    monkeypatch.setattr(encoder, "_token_sizes", encoder._token_sizes + 1)
    texts = ["one two three", "four  five\n six"]
    assert rows(*encoder.encode_column(pa.array(texts))) == [counted.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert {" two", " three"} <= set(counted.texts)


@pytest.mark.parametrize("n", [70_000, 65_537 + 4096])
def test_runs_of_small_ids_take_the_table(n):
    values = np.random.default_rng(n).integers(0, 1 << 16, n).astype(np.uint64)
    values[: n // 2] %= np.uint64(3)
    words, block_words, escapes = tokenfile.pack(values)
    assert np.array_equal(tokenfile.unpack(words, block_words, escapes, n), values)
    assert len(words) < n // 2 // 20 + n // 2 // 2
