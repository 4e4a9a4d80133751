from __future__ import annotations

from skylattice.llm import neardup


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    text = lambda seed: " ".join(f"{seed}{k}" for k in range(60))
    a, b, c, d = (text(x) for x in "abcd")
    docs = [(1, a), (2, f"{a} end"), (2, b), (3, c), (3, f"{c} end"), (3, c), (4, f"{b} end"), (5, d), (6, None), (None, a)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = neardup.one_of_each(df)
    assert got.columns == df.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    # (2, b) is no copy of a smaller id; the two texts of 3 have the same id, not a smaller one.
    assert sorted(rows, key=repr) == sorted([(1, a), (2, b), (3, c), (3, f"{c} end"), (3, c), (5, d), (6, None), (None, a)], key=repr)
