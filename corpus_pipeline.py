"""A corpus made ready for training: five operators one after the other over the documents of a table folder.

Every stage takes the documents that its predecessor kept, as they were written, and returns documents again; the last one
returns the packing of their tokens. A null text is scored and packed like an empty one and is never a copy; a null id is an
id like any other; of repeated rows with words one stays. Columns other than those of documents are dropped. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm import decontamination, ngram_join, packing_ga, pseudonyms, quality_gam
from rackpulse.llm.queries import PSEUDONYM_KEY, QUALITY_AT_LEAST, SEQUENCE_LENGTH, not_held_out, table
from rackpulse.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality model rejects."""
    model = quality_gam.fit_on(docs, table(spark, sf_dir, "labels"), "quality", not_held_out(5, 0))
    return quality_gam.score_documents(docs.select(*COLUMNS), model).filter(F.col("score") >= QUALITY_AT_LEAST).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts, and drops documents that have no other words."""
    windows = materialise(decontamination.benchmark_windows(table(spark, sf_dir, "benchmark")), "windows")
    found = decontamination.find_passages(docs.select(*COLUMNS), windows)
    return _documents(decontamination.remove_spans(found.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format."""
    return _documents(pseudonyms.pseudonymise(docs.select(*COLUMNS), PSEUDONYM_KEY))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token pieces into training sequences."""
    pieces = packing_ga.token_pieces(docs, SEQUENCE_LENGTH, end_id=1)
    return packing_ga.pack(pieces, SEQUENCE_LENGTH, ["doc_id", "piece"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no counterpart of the trained classifier; the tests compare every stage, and the chain, with plain Python.
ORACLE_SQL = None
