"""The training-data pipeline: five filters and transforms over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Stages work on whole texts of all documents their predecessor kept.

Stages need the columns doc_id, text and (the first) lang. Any others pass through as they are, whatever their
names: they travel as one column of a name of its own. Only line dedup sets another one, n_chars, if it is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import bpe, linededup, neardup, phrases, quality
from skylattice.session import shared_folder

VOCABULARY = "byte_bpe_50k.json"


def _packed(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all but the needed columns in one, and a function that unpacks what a stage made of it."""
    packed = f"row_{uuid.uuid4().hex}"
    others = [c for c in docs.columns if c not in needed]
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    narrow = docs.select(*needed, F.struct(*fields, F.lit(True).alias("there")).alias(packed))

    def unpacked(found: DataFrame, **changed: Column) -> DataFrame:
        own = {c: F.col(packed)[f"c{i}"] for i, c in enumerate(others)} | {c: F.col(c) for c in needed}
        return found.select(*[(changed[c] if c in changed else own[c]).alias(c) for c in docs.columns])

    return narrow, unpacked


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    narrow, unpacked = _packed(docs, "doc_id", "text", "lang")
    return unpacked(quality.judged(narrow).filter("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that an earlier document holds; n_chars follows the text."""
    narrow, unpacked = _packed(docs, "doc_id", "text")
    cut = linededup.deduplicated(narrow)
    return unpacked(cut, n_chars=F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    narrow, unpacked = _packed(docs, "doc_id", "text")
    return unpacked(neardup.one_of_each(narrow))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    narrow, unpacked = _packed(docs, "doc_id", "text")
    keyed = narrow.withColumn("_text", F.xxhash64("text"))
    found = phrases.contamination(keyed, benchmark, keys=("doc_id", "_text")).filter("contaminated")
    gone = found.select(F.col("doc_id").alias("_gone"), F.col("_text").alias("_gone_text")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.col("_text") == F.col("_gone_text"))
    return unpacked(keyed.join(gone, same, "left_anti"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their text, after a check that these decode to it."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY), decoded="_decoded")
    exact = F.assert_true(F.col("_decoded") == F.coalesce("text", F.lit("")), F.lit("ids do not decode to their text"))
    return coded.select(
        "doc_id", "lang", "source", "text", "ids", F.when(exact.isNull(), F.size("ids")).cast("long").alias("n_tokens")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: The verdicts by divergence from sums over all documents and the ids of the vocabulary are beyond SQL.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
