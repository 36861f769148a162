"""A corpus pipeline of the operators in tidemark.llm; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, langid, neardup, substrings
from tidemark.llm.common import discard, settle, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell stay."""
    return langid.keep_known_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays."""
    return neardup.drop_near_duplicates(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat those of earlier documents are cut out of the texts."""
    return substrings.drop_repeated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in benchmark windows are cut out of the texts; documents that are half benchmark or more go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded bytes: the ids of every text, decoded again."""
    import public_tokenizers

    path = public_tokenizers.path(bpe.RANKS)
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    both = bpe.decode(encoded, path)
    out = both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    out.settled_path = encoded.settled_path
    return out


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("bpe", bpe_round_trip)]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written as Parquet and read again, and deleted when the next one's is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        kept = settle(made, f"pipeline-{name}", "zstd")
        discard(made, docs)  # what a stage has written for itself, and its input
        docs = kept
    return docs
