"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import bpe_fold, chat, manifest, media, near_dups, negatives, packing, pieces, quality, sharding, token_counts, toxicity, url_rules
from docquarry.llm.shared import table

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens; null texts are one end token."""
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), BPE_JSON, PATTERN))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as stored sound, read back, with features."""
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, of 1 MiB of text at most."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all URLs, by listed rules and else by mined ones."""
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and decoded bytes of every text."""
    return bpe_fold.encode(table(spark, sf_dir, "documents"), BPE_RANKS, PATTERN, keep=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every text, and of its prefixes."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BPE_JSON, PATTERN)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all lines of all conversations, and their canonical rendering."""
    return chat.recover_roles(chat.transcribed(table(spark, sf_dir, "conversations")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by distinct two-word shingles."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words_each=2)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it still verifies after tampering."""
    return manifest.verify(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and decoded text of every text."""
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES, keep=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five negatives for each positive of each anchor, over all vectors."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_best_fit_packing, op2_toxicity, op3_media_columns, op4_sharding, op5_url_filters, op6_byte_bpe, op7_quality_rules, op8_token_counts, op9_chat_formatting, op10_minhash_near_dedup, op11_merkle_manifest, op12_sentencepiece, op13_hard_negatives)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.ORACLE, "op11_merkle_manifest": manifest.ORACLE, "op13_hard_negatives": negatives.ORACLE}
