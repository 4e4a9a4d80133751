from __future__ import annotations

import hashlib
import random
import re

import pytest

from skylattice.llm import phrases

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, window):
    for key, text in docs:
        own, hit, items = words(text), set(), set()
        for item, phrase in bench:
            w = words(phrase)
            size = min(window, len(w))
            for k in range(len(w) - size + 1 if w else 0):
                for at in range(len(own) - size + 1):
                    if own[at : at + size] == w[k : k + size]:
                        hit |= set(range(at, at + size))
                        items.add(str(item))
        yield (key, len(own), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(own))


def random_text(pick, n):
    return " ".join(pick.choice(["the", "Of", "a", "x1", "é", "b-c", "rare"]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    pick = random.Random(3)
    bench = [(k, random_text(pick, pick.randrange(1, 9))) for k in range(25)] + [(90, None), (91, ""), (92, "--"), (7, "rare rare")]
    docs = [(k, random_text(pick, pick.randrange(0, 60))) for k in range(60)] + [(70, None), (71, ""), (5, bench[0][1]), (5, bench[0][1])]
    return (
        docs,
        bench,
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"),
        spark.createDataFrame([(*b, "y") for b in bench], "item_id long, text string, doc_id string"),
    )


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_contamination_equals_brute_force(tables, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "WINDOW", 4)
    monkeypatch.setattr(phrases.search, "__kwdefaults__", phrases.search.__kwdefaults__ | {"window": 4})
    docs, bench, d, b = tables
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in phrases.contamination(d, b).collect())
    assert got == sorted(brute(docs, bench, 4))


def test_segments_of_any_size_agree(tables, monkeypatch):
    _, _, d, b = tables
    spans = []
    for size in (1 << 20, 200):
        monkeypatch.setattr(phrases, "SEGMENT_BYTES", size)
        index = phrases.build_index(d)
        named = phrases.search(index, b, window=3).join(phrases.indexed_documents(index), ["segment", "row"])
        spans.append(sorted((r.doc_id, r.item, r.begin, r.end) for r in named.collect()))
    assert spans[0] == spans[1]
    assert spans[0]


def test_proximity(spark):
    docs = [(1, "alpha one beta gamma"), (2, "alpha beta gamma"), (3, "gamma alpha x y z beta"), (4, "alpha beta"), (5, "beta alpha gamma")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = phrases.build_index(d)

    def found(slop):
        hits = phrases.search(index, b, slop=slop).join(phrases.indexed_documents(index), ["segment", "row"])
        return sorted({r.doc_id for r in hits.collect()})

    assert found(0) == [2]
    assert found(1) == [1, 2, 5]


def test_empty_tables(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    assert phrases.contamination(d, b).count() == 0
    rows = phrases.contamination(full, b).collect()
    assert {(r.doc_id, r.n_words, r.contaminated) for r in rows} == {(1, 2, False), (None, 1, False)}
    assert phrases.contamination(d, full.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_query_digest(spark, tmp_path):
    from skylattice.llm.queries import op3_decontamination

    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    spark.createDataFrame([(1, f"x {item} y"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, item), (9, "nine TEN")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op3_decontamination(spark, str(tmp_path)).collect()}
    assert got == {
        1: (16, 14, 2, hashlib.sha256(b"10,9").hexdigest(), True),
        2: (0, 0, 0, hashlib.sha256(b"").hexdigest(), False),
    }
