"""Stages over documents, each calling one corpus operator; each reads all that the one before kept.

Cases, for every stage: null and empty texts, null and repeated doc_ids and repeated rows are rows like any
other; all columns of documents come out of all stages but the last, whatever their names; an empty table stays empty. Very long
texts are read whole. Ties are named at the stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import mixing, packing, quality, simhash, toxicity
from ledgerlens.llm.common import table
from ledgerlens.plans.storage import checkpointed, removed, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models score below the toxicity threshold stay; a score at the threshold goes.

    Without labelled rows of both kinds nothing is known to be toxic: see toxicity.fit.
    """
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(docs, scorer) < toxicity.THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model scores at the quality threshold or above stay; a score at the threshold stays."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(docs, model) >= quality.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of least doc_id; rows without doc_id stay.

    Groups are those of op5's SimHash links and, joined with them, of the near copies whose fingerprints lie farther apart (simhash.groups).
    """
    return simhash.keep_one(docs, simhash.groups(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document at least once, rare sources repeated; null is a source of its own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 token ids with lexical neighbours side by side; a null or empty text is the single id 0."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL: str | None = None  # trained models and a tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; every stage is written as Parquet and read again.

    The stages' folder is deleted at the end; the result is read from the checkpoint folder.
    """
    docs, out = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    result = checkpointed(docs)
    removed(spark, out)
    return result
