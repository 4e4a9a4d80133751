from __future__ import annotations

import random
import re

import numpy as np
import pytest

from skylattice.llm import neardup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(docs):
    sets = [(key, shingles(text)) for key, text in docs]
    label = {key: key for key, _ in sets if key is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return sorted(
        ((key, len(s), key if key is None or not s else root(key)) for key, s in sets), key=repr
    )


def corpus(seed, copies=25):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("aBcdeé") for _ in range(pick.randrange(1, 5)))
    docs = []
    for base in range(6):
        text = [word() for _ in range(60 + 40 * base)]
        docs.append(text)
        for _ in range(copies):
            copy = list(text)
            for _ in range(pick.randrange(0, 1 + len(text) // 16)):
                copy[pick.randrange(len(copy))] = word()
            docs.append(copy)
    docs += [[word() for _ in range(n)] for n in (0, 1, 2, 4, 5, 6, 2000)]
    texts = [pick.choice([" ", "\n", " \t "]).join(d) for d in docs]
    pick.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, "one two"), (902, "ONE  two"), (None, "one two"), (3, texts[3])]


def found(spark, docs):
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, node string, label string")
    rows = neardup.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


@pytest.mark.parametrize(("short", "block"), [(64, 500_000), (2, 500_000), (2, 700)])
def test_components_equal_brute_force(spark, monkeypatch, short, block):
    monkeypatch.setattr(neardup, "SHORT_LIST", short)
    monkeypatch.setattr(neardup, "LEFT_BLOCK", block)
    monkeypatch.setattr(neardup, "RIGHT_BLOCK", block)
    docs = corpus(short + block)
    assert found(spark, docs) == brute(docs)


def test_empty_and_wordless(spark):
    assert found(spark, [(5, None), (4, ""), (3, " \n "), (None, None)]) == brute([(5, None), (4, ""), (3, " \n "), (None, None)])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(df).count() == 0
    assert neardup.one_of_each(df).count() == 0


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(8, text), (2, text + " end"), (5, "other words entirely here now"), (None, text), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in neardup.one_of_each(df).collect()), key=str) == [2, 5, 7, None]


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in neardup.connected(edges).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}


def test_sets_do_not_depend_on_neighbours():
    texts = [b"a b c d e f", b"", b"a b", b"A  b\nc d e f", b"x " * 30]
    data = np.frombuffer(b"".join(texts), np.uint8)
    values, offsets = neardup.shingle_sets(data, np.cumsum([0, *map(len, texts)]))
    assert np.diff(offsets).tolist() == [2, 0, 1, 2, 1]
    assert values[offsets[0] : offsets[1]].tolist() == values[offsets[3] : offsets[4]].tolist()
