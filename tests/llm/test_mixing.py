from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import mixing, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def stream(text):
    return (" ".join(words(text)) + "\n").encode()


def corpus(n, seed):
    pick = random.Random(seed)
    vocabulary = "sun moon star été tide WIND".split()
    return [" ".join(pick.choice(vocabulary) for _ in range(pick.randrange(0, 60))) for _ in range(n)]


def contexts(data, i):
    start = max(data.rfind(b" ", 0, i), data.rfind(b"\n", 0, i)) + 1
    return [(k, data[max(0, i - k) : i]) for k in mixing.ORDERS] + [("word", data[start:i])]


def halves(code, byte):
    """For every half byte of a byte's code: those before it, and its bits."""
    values = code.values.reshape(256, 3)[byte, : code.sizes[byte]].tolist()
    for k, value in enumerate(values):
        yield tuple(values[:k]), [(value >> (3 - j)) & 1 for j in range(4)]


def learn(texts, code):
    counts = Counter()
    for text in texts:
        data = stream(text)
        for i in range(len(data)):
            for name in contexts(data, i):
                for before, bits in halves(code, data[i]):
                    for j in range(4):
                        counts[name, before, tuple(bits[:j]), bits[j]] += 1
    return counts


def log_probability(text, counts, mixer, code):
    """Bit by bit, with the same weights, cells and block ends."""
    data = stream(text)
    gains, done, total = np.ones(mixing.INPUTS), 0, 0.0
    slopes, block, ends = np.zeros(mixing.INPUTS), 0, 256
    for i in range(len(data)):
        if i == ends:
            gains += slopes / (mixer.curvature * (done + 4000)) * mixing.CELL_SCALE / 2
            slopes, block, ends = np.zeros(mixing.INPUTS), block + 1, ends + min(256 << (block + 1), mixing.LONGEST_BLOCK)
        names = contexts(data, i)
        for before, bits in halves(code, data[i]):
            seen = [sum(s <= counts[name, before, (), 0] + counts[name, before, (), 1] for s in mixing.SEEN) for name in names]
            for j, bit in enumerate(bits):
                inputs = []
                for k, name in enumerate(names):
                    n0, n1 = (counts[name, before, tuple(bits[:j]), b] for b in (0, 1))
                    odds = max(-126, min(126, round(math.log((n1 + mixing.UNSEEN) / (n0 + mixing.UNSEEN)) * mixing.SCALE)))
                    weighted = odds * float(mixer.weights[k, seen[k], j]) * mixing.CELL_SCALE / mixing.SCALE
                    inputs.append(max(-127, min(127, round(weighted))) * (1 if bit else -1))
                value = float(np.dot(gains, inputs))
                cell = max(-(mixing.CELLS // 2), min(mixing.CELLS // 2, round(value)))
                chance = float(mixer.cells[4 * bool(before) + j, cell + mixing.CELLS // 2])
                total += math.log(chance)
                slopes += np.array(inputs) * (1 - chance)
                done += 1
    return total


def test_the_byte_code_is_complete():
    pick = random.Random(4)
    for counts in (np.zeros(256), np.array([pick.randrange(1000) for _ in range(256)])):
        code = mixing.byte_code(counts)
        codes = {tuple(code.values.reshape(256, 3)[b, : code.sizes[b]].tolist()) for b in range(256)}
        assert len(codes) == 256 and sum(16.0 ** -len(c) for c in codes) == 1
        order = sorted(range(256), key=lambda b: (-counts[b], b))
        assert [int(code.sizes[b]) for b in order] == [1] * 12 + [2] * 52 + [3] * 192


@pytest.fixture(scope="module")
def model(spark):
    texts = corpus(60, 1)
    return texts, mixing.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_scores_equal_a_model_bit_by_bit(spark, model):
    texts, fitted = model
    counts = learn(texts, fitted.code)
    tests = [*corpus(12, 2), None, "", " \t\n", "moon" * 300, " ".join(corpus(30, 3)), "zq ünseen Ω", texts[3]]
    rows = mixing.scored(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), fitted).orderBy("doc_id").collect()
    for row, text in zip(rows, tests, strict=True):
        expected = log_probability(text if text != "moon" * 300 else "", counts, fitted.mixer, fitted.code) / math.log(10)
        if text != "moon" * 300:  # such a word starts again in the model, which the loop does not know
            assert row["score"] == pytest.approx(expected, rel=2e-3, abs=2e-3), text
        assert row["n_bytes"] == len(stream(text))
        assert row["bits_per_byte"] == pytest.approx(-row["score"] * math.log2(10) / row["n_bytes"])


def test_the_bytes_of_any_context_share_one_probability(model):
    _, fitted = model
    scorer = mixing.Scorer(fitted.tables, fitted.mixer, fitted.code)
    for start in (b"", b"sun mo", b"\xc3"):
        # Two bytes of UTF-8 are cut, so all 256 values can follow; every row goes without its end.
        flat = np.frombuffer(b"".join(start + bytes([v]) for v in range(256)), np.uint8)
        size = len(start) + 1
        offsets = np.arange(257) * size
        tokens = np.unique(np.r_[offsets, offsets[:-1] + (4 if start == b"sun mo" else 0)])
        scorer.gains, scorer.coded_bits = np.ones((256, mixing.INPUTS), np.float32), np.zeros(256, np.float32)
        whole = scorer._window(mixing.Window(flat, offsets, tokens, np.zeros(0, np.uint8), 0))
        prefix = 0.0
        if start:
            first = offsets[:1]
            scorer.gains, scorer.coded_bits = np.ones((1, mixing.INPUTS), np.float32), np.zeros(1, np.float32)
            cut = np.array([0, len(start)])
            own = np.array([0, 4, 6]) if start == b"sun mo" else cut
            prefix = scorer._window(mixing.Window(flat[first[0] : len(start)], cut, own, np.zeros(0, np.uint8), 0))[0]
        assert np.exp(whole - prefix).sum() == pytest.approx(1, abs=1e-4)


def test_long_texts_in_parts_score_like_whole_ones(monkeypatch, model):
    _, fitted = model
    text = " ".join(corpus(400, 5))

    def score(limit):
        scorer = mixing.Scorer(fitted.tables, fitted.mixer, fitted.code)
        scorer.windows.limit = limit
        parts = list(mixing.runs(pa.array([text, "x"]), limit))
        return sum(scorer(run).sum() for run in parts), len(parts)

    whole, few = score(1 << 20)
    cut, many = score(2000)
    assert few == 1 and many > 5
    assert cut == pytest.approx(whole, rel=0.01)
    for limit in (500, 1 << 20):
        runs = list(mixing.runs(pa.array(["word " * 900 + "\n " * 4000 + "end", " " * 9000, None]), limit))
        assert b"".join(r.flat.tobytes() for r in runs) == b"word " * 900 + b"end\n\n\n"


def brute_base(rows):
    held = [zlib.crc32(str(key).encode()) % 10 == 0 for key, _ in rows]
    counts = Counter(w for (key, text), out in zip(rows, held, strict=True) if not out for w in [*words(text), None])
    n, below = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    for (key, text), out in zip(rows, held, strict=True):
        tokens = [*words(text), None]
        base = sum(math.log10((counts[w] + 0.1) / below) for w in tokens)
        yield key, out, len(tokens), sum(counts[w] > 0 for w in tokens), n, base


@pytest.mark.parametrize("frequent", [1 << 16, 3, 0])
def test_query_equals_brute_force_counts(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(mixing, "FREQUENT", frequent)
    texts = corpus(80, 7) + [None, "", "unique words HERE", "held only " * 5, "\x0b\x0c", "a" * 5000 + " moon"]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[4])]
    spark.createDataFrame([(k, t, "extra") for k, t in rows], "doc_id long, text string, words string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_lm_score(spark, str(tmp_path)).collect()
    key = lambda r: (r[0], r[2], r[5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    expected = sorted(brute_base(rows), key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [g[5] for g in got] == pytest.approx([e[5] for e in expected])


def test_no_documents_and_nothing_to_learn_from(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert queries.op11_lm_score(spark, f"{tmp_path}/a").count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    spark.createDataFrame([(held, "one two")], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    (row,) = queries.op11_lm_score(spark, f"{tmp_path}/b").collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    sizes = mixing.byte_code(np.zeros(256)).sizes[list(b"one two\n")]
    assert row["bits_per_byte"] == pytest.approx(4 * sizes.mean())


def test_held_out_text_is_told_better_than_by_words_alone(spark):
    found = queries.op11_lm_score(spark, "/root/testdata/sf0.01").filter("held_out")
    score, base = found.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base
