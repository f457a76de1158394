"""The corpus pipeline: each stage works on all documents that the one before it kept.

Toxic documents go, of each group of near duplicates one stays, documents with benchmark passages go,
personal data is masked, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelens.llm import decontam, jaccard, packing, pii, toxicity
from pagelens.llm.common import stored, table
from pagelens.llm.queries import toxicity_model

#: Words of a shingle, and the share of shingles in common from which documents are near duplicates.
SHINGLE, PERCENT = 5, 80


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learned from the labels that aren't held out, doesn't reject."""
    return toxicity.keep_clean(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs, width=SHINGLE, percent=PERCENT)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece with its token ids; sequences are put together from them by ``packing.sequences``."""
    return packing.digest(packing.pack(docs), "ids")


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", one_of_each_group),
    ("decontamination", clean_of_benchmarks),
    ("personal_data", masked),
    ("packing", packed),
]

#: SQL can't express the classifier or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again by the next.

    Null and empty texts go through all stages and are packed as a separator alone; null and repeated ids stay
    apart as each stage states. Other columns of ``documents`` stay up to the last stage. Empty table: no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
