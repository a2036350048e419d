"""A training corpus from documents: five stages, each on all that the one before it kept.

language ID -> n-gram Jaccard join -> benchmark decontamination -> secret scans -> packing.
Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents,
further columns and those with the operators' own names included, with the values they had.
An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, langid, packing, secret_scan
from tidemark.llm.common import table, written

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language models, learned from all labelled documents, don't accept: null
    texts, those without a letter, and those far from every language. Equal texts are judged
    alike; without any labelled text all documents stay."""
    models = langid.train(docs)
    return docs if models is None else langid.accepted_only(docs, models)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of similar documents. Rows without an id, empty
    and null texts have no group and stay; of rows with equal id and text one stays."""
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window; null and empty texts hold none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and brings n_chars up to date; every document stays, null
    and empty texts as they are."""
    detector = secret_scan.train(secret_scan.planted_findings(docs), secret_scan.common_words(docs))
    return secret_scan.redact(docs, detector)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of at most 1024 tokens; a null or
    empty text is one piece with the end token, equal documents are pieces each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
