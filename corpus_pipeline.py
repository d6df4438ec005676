"""Corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Language ID, near-duplicate removal, benchmark decontamination, source mixing, sharding. Every stage but
the last returns the columns of documents; mixing repeats rows, and sharding adds shard.

Edge cases: the language stage drops rows whose text is null or has no letter; near-duplicate removal keeps one of rows that repeat id and text, the least id
of a component, and texts without words; decontamination keeps texts without words; mixing gives repeated rows equal counts; sharding tells repeated
rows apart. Null ids and sources are values of their own, ties go to the least id, very long texts are read whole, an empty
table gives an empty one, and columns beside those of documents are carried, whatever their names (one named shard is replaced in the end).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import fold, materialize, table
from quillspark.llm.decontamination import decontaminate
from quillspark.llm.language import predict, train
from quillspark.llm.mixing import mix_sources
from quillspark.llm.near_duplicates import drop_near_duplicates
from quillspark.llm.sharding import shard_documents

SHARDS = 16


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected, and their lang as predicted. The models learn as in op2."""
    trained = train(docs.where(fold("doc_id", 4) != 2))
    judged = predict(docs, trained, [F.struct(*[docs[c] for c in docs.columns]).alias("row")])
    return judged.where(~F.col("rejected")).select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one of the least id."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate."""
    return mix_sources(docs).select(docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, of near equal bytes."""
    return shard_documents(docs, SHARDS)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

ORACLE_SQL = None  # language models and sketches have no SQL form; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what comes between is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
