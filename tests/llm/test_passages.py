from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from skylattice.llm import linededup


def brute(docs):
    """All runs of more than 50 words against all earlier ones; doc_id is unique."""
    first, units, gone = {}, {}, {}
    for key, text in sorted(d for d in docs if d[0] is not None and d[1] is not None):
        units[key] = re.split(r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])", text)
        lines = [(k, u.split("\n")[0], len(re.findall(r"[^\x20\x09-\x0D]+", u))) for k, u in enumerate(units[key])]
        lines = [x for x in lines if x[2]]
        gone[key] = set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(x[2] for x in lines[i : j + 1]) > 50:
                    d, end = first.setdefault(tuple(x[1] for x in lines[i : j + 1]), (key, lines[j][0]))
                    if d != key or lines[i][0] > end:
                        gone[key] |= set(range(lines[i][0], lines[j][0] + 1))
    left = {k: "\n".join(u for n, u in enumerate(units[k]) if n not in gone[k]) for k in units}
    return sorted(((k, t if k is None or t is None else left[k]) for k, t in docs), key=repr)


def corpus(seed):
    pick = random.Random(seed)
    words = lambda n: " ".join(pick.choice("ab é cd\t ef".split(" ")) + str(pick.randrange(99)) for _ in range(n))
    passages = [[words(pick.randrange(0, 25)) for _ in range(7)] for _ in range(4)] + [[words(70)], [words(51)], [words(50)], [words(40), words(20), words(20)]]
    docs = []
    for k in range(60):
        own = [words(pick.randrange(0, 12)) for _ in range(pick.randrange(0, 8))]
        for _ in range(pick.randrange(0, 3)):
            at = pick.randrange(len(own) + 1)
            own[at:at] = pick.choice(passages)[pick.randrange(2) :]
        docs.append((k, "\n".join(own)))
    return [*docs, (81, docs[5][1]), (82, None), (None, docs[5][1]), (83, ""), (84, "\n \n"), (85, "x\n" * 130 + "x"), (86, "\n \n" + "\n\n".join(passages[0]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "s") for d in [*docs, docs[5]]], "doc_id long, text string, place string").repartition(5)
    got = linededup.without_passages(df)
    assert got.columns == ["doc_id", "text", "place", "n_lines", "n_removed", "removed_chars"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == brute([*docs, docs[5]])
    assert sum(r.n_removed for r in rows) > 20
    assert all((r.removed_chars or 0) >= r.n_removed for r in rows)


def test_passage_of_short_lines_goes_whole(spark):
    for lines in (2, 3, 30):
        passage = [" ".join(f"w{k}x{n}" for n in range(60 // lines + 1)) for k in range(lines)]
        docs = [(1, "\n".join(["first start", *passage, "first end"])), (2, "\n".join(["a", "b", *passage, "other"]))]
        got = linededup.without_passages(spark.createDataFrame(docs, "doc_id long, text string"))
        assert {r.doc_id: r.text for r in got.collect()} == {1: docs[0][1], 2: "a\nb\nother"}


def test_versions_of_one_id_are_judged_by_their_own_text(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = [(1, passage), (2, f"{passage}\nmore"), (2, "another text")]
    got = linededup.without_passages(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, passage), (2, "another text"), (2, "more")]


def test_native_plan_and_clashes(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = linededup.without_passages(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert linededup.without_passages(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="n_lines"):
        linededup.without_passages(df.withColumn("n_lines", F.lit(1)))
