from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from skylattice.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
    )


def characters(text):
    counts = [0] * 8
    for c in text or "":
        if "a" <= c <= "z":
            k = 0
        elif "A" <= c <= "Z":
            k = 1
        elif "0" <= c <= "9":
            k = 2
        elif c in " \t\n\v\f\r":
            k = 3
        elif c in ".,;:!?'\"()-":
            k = 4
        elif ord(c) < 32 or ord(c) == 127:
            k = 6
        else:
            k = 7 if ord(c) > 127 else 5
        counts[k] += 1
    return counts


def common(text):
    words = Q.common_words(Q.COMMON_WORDS)
    seen = Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or ""))
    own = [seen[w] for w in words]
    return [*own, sum(seen.values()) - sum(own)]


def shares(counts):
    return [c / sum(counts) if sum(counts) else 0.0 for c in counts]


def distance(p, q):
    part = lambda x, m: x * math.log2(x / m) if x else 0.0
    return math.sqrt(max(0.0, sum((part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2 for x, y in zip(p, q, strict=True))))


def brute(docs):
    measured = [(key, base(text), characters(text), common(text), lang) for key, text, lang in docs]
    failed = lambda b: b[0] < 50 or 100 * b[4] > 50 * b[0]
    language = lambda x: x if x in Q.COMMON_WORDS else Q.OTHER
    means = {}
    for name in {language(m[4]) for m in measured}:
        own = [m for m in measured if language(m[4]) == name and not failed(m[1])]
        if own:
            means[name] = [[sum(col) / len(own) for col in zip(*[shares(m[k]) for m in own], strict=True)] for k in (2, 3)]
    for key, b, c, w, lang in measured:
        ref = means.get(language(lang))
        dc, dw = (distance(shares(c), ref[0]), distance(shares(w), ref[1])) if ref else (0.0, 0.0)
        odd = (b[0] >= Q.CHARACTER_WORDS and dc > Q.CHARACTER_DISTANCE) or (b[0] >= Q.COMMON_WORD_WORDS and dw > Q.COMMON_WORD_DISTANCE)
        yield (key, *b, failed(b), not failed(b) and not odd, round(dc, 9), round(dw, 9))


@pytest.fixture(scope="module")
def docs():
    pick = random.Random(8)
    out = []
    for k in range(120):
        words = [pick.choice(["the", "of", "Die", "und", "thing", "été", "a", "x9", "running", f"w{pick.randrange(500)}"]) for _ in range(pick.randrange(0, 260))]
        if k % 9 == 0:
            words = [w + "###" for w in words]
        if k % 11 == 0:
            words = words[:7] * 12
        if k % 13 == 0:
            words = [f"q{pick.randrange(9999)}|" for _ in words]
        text = "".join(w + pick.choice([" ", " ", "\n", "\t", "\r\n", "  "]) for w in words)
        out.append((k, text, pick.choice(["en", "de", "fr", None, "xx"])))
    return [*out, (500, None, "en"), (501, "", None), (502, " \n\n ", "en"), (503, "a b\na b\n\na b", "en"), (3, *out[3][1:])]


def test_equals_brute_force(spark, docs, monkeypatch):
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, lang string, n_words double")
    rows = Q.judged(df).collect()
    got = sorted(
        (r.doc_id, *(r.counts[c] for c in Q.COUNTS), r.base_failed, r.kept, round(r.character_distance, 9), round(r.common_word_distance, 9))
        for r in rows
    )
    assert got == sorted(brute(docs))
    assert {r.kept for r in rows if not r.base_failed} == {True, False}
    assert all(r.n_words == 1.0 for r in rows)


def test_small_pieces_agree(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    whole = sorted(map(str, Q.counted(df).collect()))
    monkeypatch.setattr("skylattice.llm.flattext.PIECE_BYTES", 64)
    assert sorted(map(str, Q.counted(df).collect())) == whole


def test_empty_and_clashes(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert Q.judged(df).count() == 0
    with pytest.raises(ValueError, match="counts"):
        Q.counted(df.selectExpr("*", "1 AS counts"))
