"""A training corpus from ``documents``: quality rules, exact and near deduplication, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns their columns; the last returns what the encoder made of each
row. Nulls, empty texts, repeated rows, ties and clashing names are handled as
the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lotlens.llm import exact_dedup, kn_quality, mixing, nbest, near_copies
from lotlens.llm.common import read, stored

#: The mixture: as many characters as come in, each source its equal share.
EPOCHS = 1.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the perplexity bands reject go."""
    return kn_quality.keep_quality(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id stays of each group of near copies: five-word SimHash, Jaccard of 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate asks for, in a shuffled order."""
    return mixing.mix(docs, epochs=EPOCHS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, score, best (digests of the n best segmentations), decodes."""
    return nbest.encode(docs, str(public_tokenizers.path("piece_bpe_32k.model")), n=4, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("sentencepiece encoding", encode),
]

#: Perplexity bands and the search over segmentations have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
