from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, least, top):
    f = defaultdict(Counter)
    for text, lang in rows:
        for words in pieces(text):
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(v for k, v in counts.items() if len(k) == 1)
        kept = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            if len(phrase) == 2 and any(
                len(k) == 3 and v >= least and 100 * v >= 50 * a and phrase in (k[:2], k[1:]) for k, v in counts.items()
            ):
                continue
            cuts = [(1000000 * a * a // (counts[phrase[:k]] * counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed, n=150):
    pick = random.Random(seed)
    vocabulary = "a b c dé D ü x\x00y 日本 the".split(" ")
    fixed = ["the a b", "c dé ü", "日本 the a b c"]
    rows = []
    for _ in range(n):
        words = [pick.choice(vocabulary) if pick.random() < 0.7 else pick.choice(fixed) for _ in range(pick.randrange(0, 40))]
        text = "".join(w + pick.choice([" ", " ", "\t ", ". ", "\n", ", "]) for w in words)
        rows.append((text, pick.choice(["en", "fr", None, "und"])))
    return [*rows, (None, "en"), ("", None), (" .\n", "fr"), ("lone", "de"), rows[3], rows[3], (" ".join(pick.choices(vocabulary, k=3000)), "en")]


@pytest.mark.parametrize("seed, least, top", [(1, 10, 2000), (2, 3, 7), (3, 1, 2000)])
def test_phrases_equal_brute_force(spark, monkeypatch, seed, least, top):
    monkeypatch.setattr(collocations, "TRIGGER", 4)
    monkeypatch.setattr(collocations, "RANK_PARTS", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame([(t, x, 1, "s", 7) for t, x in rows], "text string, lang string, n long, phrase string, size int")
    found = collocations.collocations(docs.repartition(3), least=least, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, least, top)


@pytest.mark.parametrize("longest, trigger, limit", [(256, 16, 1 << 20), (3, 2, 40), (1, 1, 10), (2, 1000, 100)])
def test_every_ngram_lies_in_one_chunk(monkeypatch, longest, trigger, limit):
    monkeypatch.setattr(collocations, "LONGEST", longest)
    monkeypatch.setattr(collocations, "TRIGGER", trigger)
    texts = [t for t, _ in corpus(5, 30)]
    found = {size: Counter() for size in (1, 2, 3)}
    for first, end, data, starts, owned in collocations._texts(pa.array(texts), limit):
        of_row, chunks = collocations.parse(data, starts, owned)
        assert ((0 <= of_row) & (of_row < end - first)).all()
        for chunk in chunks.to_pylist():
            words = re.findall(r"[ \t][^ \t]+", chunk)
            for i, word in enumerate(words):
                for size in (1, 2, 3):
                    if word[0] == " " and i + size <= len(words):
                        found[size]["|".join(w[1:] for w in words[i : i + size])] += 1
    for size in found:
        expected = Counter("|".join(w[i : i + size]) for t in texts for w in pieces(t) for i in range(len(w) - size + 1))
        assert found[size] == expected


def test_copies_have_the_same_chunks():
    passage = " ".join(random.Random(1).choices("one two three four five six seven".split(), k=200))
    both = [f"some other words before {passage} and after", f"{passage} alone"]
    data = "".join(both).encode()
    starts = np.cumsum([0, *(len(t) for t in both)])
    of_row, chunks = collocations.parse(np.frombuffer(data, np.uint8), starts, len(data))
    first, second = (Counter(np.array(chunks.to_pylist(), object)[of_row == k].tolist()) for k in (0, 1))
    assert sum((first & second).values()) >= 0.7 * max(sum(second.values()), 1)


def test_scores_are_whole_numbers_beyond_64_bits(spark):
    rows = [(10**13 + 7, 10**13 + 9, 3 * 10**13), (999_999_937, 10**9 + 7, 10**9 + 9), (10, 10, 10), (10, 11, 12)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("*", collocations.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r["s"] for r in df.collect()] == [1000000 * a * a // (left * right) for a, left, right in rows]
    assert dict(df.dtypes)["s"] == "bigint"


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(empty).collect() == []
