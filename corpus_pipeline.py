"""The corpus pipeline: stages that each apply one operator to what the one before kept.

Each stage's rows are written and read again as the next one's docs. A decision
names documents by doc_id.

Defined results: null and empty texts are scored as documents without words,
are copies of one another in exact_dedup, and are linked with nothing in
near_dedup; a row without doc_id is judged but cannot be named, so it stays in
every filtering stage; rows that share a doc_id go together, if one of them
goes, and repeated rows of a doc_id that stays all stay; ties follow the
operators (the largest doc_id of equal texts, the least one of near copies);
very long texts are taken whole; an empty table gives no rows; further columns,
whatever their names, are carried to the last stage, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm import decontaminate, exact_dedup, near_dedup, quality, word_table
from lexaudit.llm.queries import digested
from lexaudit.llm.store import materialize

#: Dropped ids that may be broadcast (16 bytes each, 8 MB in all); above it both sides are exchanged.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is listed; rows without doc_id stay."""
    listed = materialize(dropped.select("doc_id").where("doc_id is not null").distinct(), "dropped")
    few = listed.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(listed) if few else listed, "doc_id", "left_anti").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it is fitted on these documents' labels."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, quality.score(docs, model).where("predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return _without(docs, exact_dedup.deduplicate(docs, F.col("doc_id") % 2 == 0).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, by chains of links, the document with the least doc_id."""
    return _without(docs, near_dedup.near_duplicates(docs).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of the benchmark."""
    return _without(docs, decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return digested(word_table.round_trip(docs, path))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
