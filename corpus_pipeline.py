"""A corpus through five stages: toxicity, near duplicates, decontamination, secrets, tokens.

Each stage works on all that the stage before it kept. Run as the query ``pipeline``. Rows with a null or empty text, or a null id, go
through all stages: they are neither toxic, duplicates, contaminated nor secret, and have no tokens. Of repeated rows (same id and text)
with words one stays, see ``near_duplicate_stage``; others stay as often as they come. Empty tables give empty results. Texts of any length
are taken whole, and columns may have any name beside ``doc_id`` and ``text``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.llm import byte_bpe, decontamination, ngram_jaccard, secret_scan, toxicity
from fusewright.llm._shared import cut, discard, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on ``labels``, does not find toxic. Without labels of both kinds all stay, unless all
    labels are toxic."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 5-word shingles at a similarity of 0.8.

    Rows without words all stay; of a group without any id one row of each set stays.
    """
    return ngram_jaccard.deduplicate(docs, words=5, num=4, den=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of ``benchmark``, repeated rows alike."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kinds; n_chars follows the text, null stays null."""
    redacted = secret_scan.redact_secrets(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 of its byte-level BPE encoding; a null text is empty."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("tokens", token_stage),
]

#: The classifier of the first stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, the one before it deleted."""
    docs, staged = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        discard(*staged)
        staged = [docs]
    return docs
