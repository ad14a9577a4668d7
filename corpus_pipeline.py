"""A pipeline over the documents table: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on every row of docs, and returns the rows
that it keeps with all their columns; the last returns the packed pieces.

Defined results: null and empty texts fail the quality rules; null doc_ids, languages and
sources pass like others; repeated rows leave one; an empty table gives no rows; columns of
any names besides doc_id, text, lang and source pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, quality, simhash_wide, toxicity
from tidemark.llm.shared import finished, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text's score is under the threshold, by a model of the labels that may be learnt from."""
    model = toxicity.train(docs.select(F.col("doc_id").cast("long"), "text"), toxicity.learning_rows(table(spark, sf_dir, "labels")))
    return toxicity.clean_rows(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and aren't outliers of their language and source."""
    return quality.kept_rows(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, a similarity of 0.8."""
    return simhash_wide.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows' pieces in sequences of at most 2048 tokens."""
    pieces = packing.pieces(docs.select(F.col("doc_id").cast("long"), "text"), public_tokenizers.path(packing.VOCABULARY))
    return packing.pack(pieces, packing.PIECES)


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_quality), ("SimHash near-dedup", drop_near_duplicates), ("best-fit packing", pack)]

#: No stage but the last is plain SQL: the models are trained, and near-duplicates are found by fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's own tables go when its result stands."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
