from __future__ import annotations

import os
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

sys.path.insert(0, os.path.dirname(__file__))

import test_linededup as lines  # noqa: E402
import test_neardup as near  # noqa: E402
import test_phrases as phrase  # noqa: E402
import test_quality as quality  # noqa: E402


def brute(docs, bench):
    """The five stages one document at a time; docs: (doc_id, text, lang)."""
    verdict = {row[0]: row[7] for row in quality.brute(docs)}
    docs = [d for d in docs if verdict[d[0]]]
    cut = dict(lines.brute([(k, t) for k, t, _ in docs]))
    docs = [(k, cut[k], lang) for k, _, lang in docs]
    component = {k: c for k, _, c in near.brute([(k, t) for k, t, _ in docs])}
    docs = [d for d in docs if component[d[0]] == d[0]]
    dirty = {k for k, *_, bad in phrase.brute([(k, t) for k, t, _ in docs], bench, 13) if bad}
    return [d for d in docs if d[0] not in dirty]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    pick = random.Random(4)
    vocabulary = ["the", "of", "and", "to", "in", "is", *(f"thing{k}" for k in range(300))]
    words = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    bench = [(k, " ".join(words(20))) for k in range(5)] + [(9, None)]
    passage = "\n".join(" ".join(words(9)) for _ in range(12))
    texts = []
    for k in range(90):
        own = words(pick.randrange(10, 300))
        text = "".join(w + pick.choice([" ", " ", " ", "\n"]) for w in own)
        if k % 5 == 0:
            text = passage + "\n" + text
        if k % 7 == 0:
            text += "\n" + bench[k % 5][1]
        if k % 11 == 0:
            text = text.replace(" ", "### ")
        texts.append(text)
        if k % 4 == 0:
            copy = text.split(" ")
            copy[len(copy) // 2] = "changed"
            texts += [text, " ".join(copy)]
    docs = [(k, t, pick.choice(["en", "de", None])) for k, t in enumerate(texts)] + [(1000, None, "en"), (1001, "", None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, lang, "src", len(t or "")) for k, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bench, folder


def test_pipeline_equals_brute_force(spark, tables):
    docs, bench, folder = tables
    expected = brute(docs, bench)
    got = P.run(spark, folder).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((k, t) for k, t, _ in expected)
    assert 0 < len(got) < len(docs)
    library = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    for row in got:
        assert list(row.ids) == library.encode(row.text, add_special_tokens=False).ids
        assert row.n_tokens == len(row.ids)


def test_stages(spark, tables):
    _, _, folder = tables
    assert [name for name, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "encoding"]
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, documents, folder)
        assert out.columns == documents.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in documents.schema], name
        assert stage(spark, documents.limit(0), folder).count() == 0, name
    assert P.STAGES[-1][1](spark, documents.limit(0), folder).count() == 0


NAMES = """kept counts base_failed character_distance common_word_distance _language _characters _common chunks _lines _marks _ends _gone _doc
n_chunks n_removed removed_chars _id _version _node component_id class_id n_shingles words item_id contaminated n_hit items _text _gone_text segment row
decoded _decoded ids n_tokens h1 h2 place c0 there""".split()


def test_other_columns_pass_through_whatever_their_names(spark, tables):
    """Stages neither change nor choke on columns that are called like their own."""
    _, _, folder = tables
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    from pyspark.sql import functions as F

    crowded = plain.select("*", *[F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")).alias(name) for name in NAMES])
    for name, stage in P.STAGES:
        expected = stage(spark, plain, folder)
        out = stage(spark, crowded, folder)
        if name != "encoding":
            assert out.columns == crowded.columns, name
            for row in out.select("doc_id", *NAMES).collect():
                assert all(row[c] == f"{c} of {row.doc_id}" for c in NAMES), name
        columns = expected.columns
        rows = [sorted(map(repr, df.select(*columns).collect())) for df in (expected, out)]
        assert rows[0] == rows[1], name
