"""The corpus pipeline: toxicity, exact and near deduplication, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terralocus.llm import bpe, jaccard, mixing, patricia, toxicity
from terralocus.llm.tables import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the toxicity operator rejects go; null and empty texts, repeated rows and rows without id are judged alike."""
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per text, that of the smallest id; null counts as the empty text."""
    return patricia.unique_rows(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per group of texts whose sets of five-word shingles are alike at 0.8 or more; texts without words are alike.

    SimHash fingerprints link texts first, and whole sets confirm; as fingerprints differ in too many bits at 0.8 to find all
    such pairs, whole sets are compared for what they leave apart.
    """
    return jaccard.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of a document are whole rows of their own, with its id; rows without source are a source."""
    return mixing.mixed(docs).select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ids, their number, and whether they decode to the text's bytes (null: empty, no ids).

    These three names are the stage's own: columns of documents that have them are replaced.
    """
    tokens = bpe.encode(docs, checked="round_trip")
    return tokens.withColumn("n_tokens", F.size("ids").cast("bigint")).select(
        *[c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")], "ids", "n_tokens", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", encode_texts),
]

# fitted weights, hashes and merges: tested against a plain version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
