"""The corpus pipeline: stages over `documents`, each reading what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, near_dedup, packing, pii, toxicity
from barloom.llm.common import staged, table

#: A deployment passes its own secret; surrogates can't be traced without it.
PII_KEY = "public demonstration key"


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the threshold go."""
    return toxicity.harmless(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id stays of each group of near-duplicates (five-word shingles)."""
    return near_dedup.one_of_each(docs)


def contaminated_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts get surrogates for personal data; no document goes."""
    return pii.replace_entities(docs, key=PII_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near-duplicates", near_duplicates_go),
    ("decontamination", contaminated_documents_go),
    ("personal-data", personal_data_replaced),
    ("packing", packed),
]

#: The stages hash, compress and tokenise in ways SQL has no functions for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
