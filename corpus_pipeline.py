"""The training-data pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a table; all but the last give
the columns of ``documents``. A stage sees only what the one before it kept.
Which documents stay: those in which a language is found; of equal texts, the one
with the largest id; of each group of near copies (five-word shingles,
Jaccard similarity of 0.8 or more), the one with the smallest id;
those without a benchmark passage. Null texts are empty: they have no language,
so the first stage drops them; null ids are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bizfit.llm.common import table
from bizfit.llm.decontaminate import keep_clean
from bizfit.llm.exact_dedup import keep_exact
from bizfit.llm.language_id import keep_identified, learn
from bizfit.llm.near_copies import keep_near
from bizfit.llm.packing import pack_documents
from bizfit.operators.shared import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Language identification, fingerprints and packing have no SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
