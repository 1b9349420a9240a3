"""From raw documents to packed training sequences.

Each stage gets what the one before kept. Documents in no known language go, one document of each
group of near duplicates stays, documents that hold benchmark passages go, personal data is
replaced, and what is left is packed. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import termloom.llm.queries  # noqa: F401  (it registers the operators' queries)
from termloom.llm import decontaminate, language_id, near_duplicates, packing, pii
from termloom.llm.registry import query, read
from termloom.session import scratch_path


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1; models are learned from the given languages of three quarters of the documents."""
    return language_id.keep_known_languages(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 from similarity 0.8 on; the document with the smallest number stays."""
    return near_duplicates.drop_near_duplicates(docs, least=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; a document with any item's window goes."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; spans are replaced by their kind."""
    return pii.redact(docs, *pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; where each document goes."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_languages),
    ("near_duplicates", one_of_each),
    ("decontaminate", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
#: Neither models nor connected components nor best fit can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


query("pipeline", ORACLE_SQL)(run)
