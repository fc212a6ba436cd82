"""From raw documents to token ids: five stages, each the next one's input.

Every stage reads what its predecessor kept and returns the columns of
documents; the last returns ids and the digest of what they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, minmax, mixing, quality, secrets
from shelfmark.llm.common import documents, folded, stored, unfolded
from shelfmark.llm.queries import vocabulary_file
from shelfmark.session import tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules together find good; the others go."""
    return unfolded(quality.good(folded(docs)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return minmax.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets blotted out and its length measured anew."""
    rows = unfolded(secrets.redacted(folded(docs)), docs.columns)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each use, in training order."""
    return unfolded(mixing.training_order(folded(docs)), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their count, and the digest of the text decoded from them."""
    out = bpe.encoded(docs.select("doc_id", "source", "text"), vocabulary_file())
    return out.select("doc_id", "source", "n_tokens", "ids", "decoded_sha256")


def _tuned(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage with the settings that its operators are written for."""
    return lambda spark, docs, sf_dir: stage(tune(spark), docs, sf_dir)


STAGES = [(name, _tuned(stage)) for name, stage in (
    ("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources), ("BPE encoding and decoding", encode))]

#: EM, MinHash and BPE are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = documents(tune(spark), sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
