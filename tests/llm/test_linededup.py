from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skylattice.llm import linededup


def chunks(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(line.encode()).hexdigest()[:8], 16) for line in lines]
    long = [len(re.findall(r"[^\x20\x09-\x0D]+", line)) > 50 for line in lines]
    out, own = [], []
    for k, line in enumerate(lines):
        own.append(line)
        rolling = ((hashes[k - 1] if k else 0) * 31 + hashes[k]) % 4294967291
        if k + 1 == len(lines) or long[k] or long[k + 1] or rolling % 2 == 0:
            out.append((own, len(own) > 1 or long[k]))
            own = []
    return out


def brute(docs):
    seen, result = {}, {}
    for key, text in sorted({d for d in docs if d[0] is not None and d[1] is not None}):
        kept = []
        for place, (own, counts) in enumerate(chunks(text)):
            if not counts or seen.setdefault("\n".join(own), (key, place)) == (key, place):
                kept += own
        result[key] = "\n".join(kept)
    return sorted(((k, t if k is None or t is None else result[k]) for k, t in docs), key=repr)


def corpus(seed):
    pick = random.Random(seed)
    words = lambda n: " ".join(pick.choice("ab é cd\t ef".split(" ")) + str(pick.randrange(99)) for _ in range(n))
    passages = [[words(pick.randrange(1, 30)) for _ in range(6)] for _ in range(4)] + [[words(70)], [words(51)], [words(50)]]
    docs = []
    for k in range(80):
        own = [words(pick.randrange(0, 12)) for _ in range(pick.randrange(0, 8))]
        for _ in range(pick.randrange(0, 3)):
            at = pick.randrange(len(own) + 1)
            own[at:at] = pick.choice(passages)
        docs.append((k, "\n".join(own)))
    return [*docs, (81, docs[5][1]), (5, docs[5][1]), (82, None), (None, docs[5][1]), (83, ""), (84, "\n\n"), (85, "x\n" * 400 + "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "s", 3) for d in docs], "doc_id long, text string, chunk string, place int").repartition(5)
    got = linededup.deduplicated(df)
    assert got.columns == ["doc_id", "text", "chunk", "place", "n_chunks", "n_removed", "removed_chars"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == brute(docs)
    assert sum(r.n_removed for r in rows) > 20
    assert all(r.chunk == "s" and r.place == 3 for r in rows)


def test_passage_goes_wherever_it_stands(spark):
    passage = [f"line {k} of a passage" for k in range(30)]
    docs = [(1, "\n".join(["first start", *passage, "first end"])), (2, "\n".join(["a", "b", "c", *passage, "other"]))]
    got = {r.doc_id: r.text for r in linededup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1]
    left = got[2].split("\n")
    assert left[:3] == ["a", "b", "c"]
    assert left[-1] == "other"
    # What stays of the passage are its border lines and lines that are chunks of their own.
    assert sorted(got.items()) == brute(docs)
    assert len(left) < len(passage) / 2


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = linededup.deduplicated(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_and_clashes(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.deduplicated(df).count() == 0
    with pytest.raises(ValueError, match="n_removed"):
        linededup.deduplicated(df.withColumn("n_removed", F.lit(1)))
