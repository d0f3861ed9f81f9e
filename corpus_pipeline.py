"""The training-data pipeline: documents in, packed pieces out; every stage is written and read again."""

from __future__ import annotations

from procatlas.llm import exact_dedup, language, mixing, near_dedup, packing
from procatlas.llm.queries import fold, table, vocabulary
from procatlas.llm.store import stored
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL can express neither compression nor tokens; the tests compare the stages with plain loops.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null and letterless texts go, and long texts that fit two languages alike."""
    model = language.fit(docs.filter(fold("doc_id", 4) != 2))
    return language.identify(docs, model).filter(~F.col("rejected")).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its shingles of five words."""
    return near_dedup.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows repeat."""
    return mixing.repeat_mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows; each row that the mix repeats is a document of its own."""
    pieces = packing.pack(docs, vocabulary())
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
