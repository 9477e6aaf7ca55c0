"""From raw documents to token ids: the stages of the training-data pipeline.

Each stage takes the documents that the one before kept and returns documents of the same columns;
the last returns token ids. ``run`` applies them all, writing each stage's result to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitegauge.llm import mixing, pieces, quality, simhash, surrogates
from suitegauge.llm.common import documents, labels, staged
from suitegauge.llm.queries import KEY

#: The pieces that the last stage encodes with; any SentencePiece model with byte pieces will do.
PIECES = Path(public_tokenizers.path("piece_bpe_32k.model"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by the labels of the folder, does not reject."""
    return quality.good_documents(docs, quality.fit(docs, labels(spark, sf_dir)), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of SimHash near-duplicates, that of the smallest id; rows without an id come last."""
    return simhash.kept_documents(docs, shingle=3, most=3)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text."""
    replaced = surrogates.replaced(docs, KEY).select(*docs.columns)
    return replaced.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else replaced


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources interleave by their weights."""
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, decoded, position), sorted by position: the order in which the mix was written.

    ``position`` is a row's place in the files of the stage before. Rows that come from no Parquet files get the mix's own positions.
    """
    try:
        placed = mixing.written_order(docs.select("doc_id", "text"))
    except AnalysisException:
        placed = mixing.mixed(docs.select("doc_id", "source", "text"))
    # Written before it is sorted: the sort samples its input, which would encode every text twice.
    ids = staged(pieces.encode_documents(placed, pieces.Model.load(str(PIECES)), kept=("position",)), "pipeline-ids")
    return ids.orderBy("position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("simhash_dedup", drop_near_duplicates),
    ("pii_surrogates", replace_pii),
    ("source_mixing", mix_sources),
    ("sentence_pieces", encode),
]

#: No SQL expresses the classifier, the surrogates or the encoder; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that the stages keep, in the mix's order. An empty table gives no rows; null texts have no ids."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
