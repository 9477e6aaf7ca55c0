"""One query for each operator of this folder, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitegauge.llm import automaton, divergence, mixing, neighbours, pieces, prefixes, quality, simhash, substrings, surrogates, tokenids, toxicity, variants
from suitegauge.llm.common import EMBEDDINGS, documents, labels

#: Key of the surrogates in the queries; a user passes a secret one.
KEY = "documents-2024"


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(documents(spark, folder), labels(spark, folder))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(documents(spark, folder), labels(spark, folder))


def op3_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    shards = tokenids.write_shards(docs, _tokenizer_file("byte_bpe_50k.json").read_text("utf-8"))
    return tokenids.fetch(shards, tokenids.keys_of(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = pieces.Model.load(str(_tokenizer_file("piece_bpe_32k.model")))
    return pieces.encode_documents(documents(spark, folder), model).select("doc_id", "n_ids", "ids_crc32", "decoded")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.without_repeats(documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(spark.read.schema(EMBEDDINGS).parquet(f"{folder}/embeddings.parquet"))


def op7_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replaced(documents(spark, folder).select("doc_id", "text"), KEY)


def op8_prefix_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.fingerprints(documents(spark, folder))


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(documents(spark, folder).select("doc_id", "source", "text")).drop("text")


def op10_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.grouped(documents(spark, folder))


def op12_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return automaton.scored(documents(spark, folder))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(documents(spark, folder))


def _tokenizer_file(name: str) -> Path:
    """A vocabulary file of the installed public tokenizers; read on the driver and sent with the plan."""
    import public_tokenizers

    return Path(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_token_ids": op3_token_ids,
    "op4_sentence_pieces": op4_sentence_pieces,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_prefix_fingerprints": op8_prefix_fingerprints,
    "op9_source_mixing": op9_source_mixing,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lm_scores": op12_lm_scores,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {"op13_source_divergence": divergence.AUDIT_SQL}
