from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from skylattice.llm import toxicity

INSULTS = ["blockhead", "numskull", "nitwit"]


def texts(seed, n):
    pick = random.Random(seed)
    syllables = ["ta", "ren", "mo", "lis", "ker", "du", "an", "fo", "sel", "ing"]
    word = lambda: "".join(pick.choice(syllables) for _ in range(pick.randrange(1, 4)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(pick.randrange(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(2):
                insult = pick.choice(INSULTS)
                at = pick.randrange(1, len(insult))
                words.insert(pick.randrange(len(words)), pick.choice([insult, insult + ",", insult.upper(), insult[:at] + pick.choice("*.x") + insult[at:]]))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = texts(1, 400)
    docs = spark.createDataFrame([(k, t, "en") for k, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    return toxicity.train(docs, labels)


def scores(spark, model, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}


def test_held_out_texts(spark, model):
    rows = texts(2, 300)
    got = scores(spark, model, [(k, t) for k, t, _ in rows])
    right = sum((got[k] >= 0.3) == bool(y) for k, _, y in rows)
    assert right >= 285
    assert all(0 <= s <= 1 for s in got.values())


def test_gaps_and_inserted_characters(spark, model):
    got = scores(spark, model, [(1, "ta blo-ckhead numsk.ull"), (2, "ta rentamo lisker"), (3, "n_itwit nitw!it"), (4, None), (5, ""), (6, "!!! 123")])
    assert min(got[1], got[3]) > 0.3 > max(got[2], got[4], got[5], got[6])
    assert got[4] == got[5] == got[6]


def test_whole_text_counts(spark, model):
    clean = "ta ren " * 60_000
    long_word = "tarenmo" * 3_000
    got = scores(spark, model, [(1, clean + "nitwit numskull"), (2, clean), (3, long_word + " nitwit blockhead")])
    assert min(got[1], got[3]) > 0.3 > got[2]


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 0)], [(1, 1), (2, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        got = scores(spark, model, [(1, "a b"), (2, None)])
        assert got[1] == got[2] == pytest.approx((sum(y for _, y in rows) + 0.5) / (len(rows) + 1))
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_kernel_is_the_sum_over_subsequences():
    words = ["abcab", "a", "zebra"]
    matrix, lengths, _ = toxicity._features(words)
    weights = np.random.default_rng(0).normal(size=1 << 15)
    got = toxicity.window_values(weights, matrix, lengths)
    for k, word in enumerate(words):
        symbols = [0, *(ord(c) - 96 for c in word), 0]
        total = norm = 0.0
        for i, j, m in combinations(range(len(symbols)), 3):
            if m - i < toxicity.SPAN:
                decay = toxicity.DECAY ** (m - i + 1)
                total += decay * weights[symbols[i] << 10 | symbols[j] << 5 | symbols[m]]
                norm += decay**2
        assert got[k] == pytest.approx(total / norm**0.5)
    again = toxicity._explicit(matrix, lengths) @ weights
    assert np.allclose(again, got, atol=1e-4)
