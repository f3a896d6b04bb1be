"""From documents to training rows: five stages over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs. Nulls, empty texts, repeated rows and empty tables go through every stage as its operator
defines: texts without letters are rejected by the first stage; of rows that repeat a doc_id one stays in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, language, pieces, secrets
from tidemark.llm.queries import table, tokenizer_file
from tidemark.llm.texts import kept

#: Documents more of whose words than this are benchmark text go; from others the passages are cut.
MAX_COVERAGE = 0.5
#: Least probability of the predicted language.
MIN_LANGUAGE_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach, told with enough certainty."""
    model = language.train(docs, training=~language.held_out())
    return language.accepted(docs, model, min_score=MIN_LANGUAGE_SCORE)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group of near copies."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    items = table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(docs, items, max_coverage=MAX_COVERAGE, n_chars="n_chars")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return secrets.redact(docs, n_chars="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids (32-bit, little-endian), and the text that these decode to."""
    model = tokenizer_file("piece_bpe_32k.model")
    found = pieces.decode(pieces.encode(docs, model, keep=("lang", "source", "n_chars")), model)
    return found.select("doc_id", F.col("decoded").alias("text"), "lang", "source", "n_chars", "n_pieces", "ids")


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("sentence_pieces", encoded),
]

#: The first and fourth stage are trained models, which SQL does not express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
