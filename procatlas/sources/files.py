"""Read export files, gate them, and fingerprint them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procatlas.functions.text import format_bytes

# What counts as an export.
EXTENSIONS = r"(?i)\.(bprelease|xml)$"
ROOTS = ("bpr:release", "process")


def read_files(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """(file, size_bytes, content) of every file; a file is one row.

    Files over a limit, where the caller names one, keep their row for the gate, but their content is never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(path)
    head = [F.col("path").alias("file"), F.col("length").alias("size_bytes")]
    if max_bytes is None:
        return found.select(*head, F.col("content").cast("string").alias("content"))
    small = found.where(F.col("length") <= max_bytes).select(*head, F.col("content").cast("string").alias("content"))
    large = found.where(F.col("length") > max_bytes).select(*head, F.lit(None).cast("string").alias("content"))
    return small.unionByName(large)


def root_element(content: Column) -> Column:
    """Name of the first element after declarations and comments of any length; empty if there is none."""
    return F.regexp_extract(content, r"^\s*(?:<\?[^>]*\?>|<!--(?s:.*?)-->|<!DOCTYPE[^>]*>|\s)*<([\w:.-]+)", 1)


def looks_like_export(content: Column) -> Column:
    """Holds no NUL, and its root element is a release or a process."""
    return root_element(content).isin(*ROOTS) & ~F.contains(content, F.lit("\u0000"))


def intake_gate(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files with ``reason``: null when accepted, else why not."""
    name = F.element_at(F.split("file", "/"), -1)
    size = F.col("size_bytes")
    over = F.lit(False) if max_bytes is None else size > max_bytes
    reason = (
        F.when(~F.col("file").rlike(EXTENSIONS), F.format_string('"%s" is not an export file', name))
        .when(size == 0, F.format_string('"%s" is empty', name))
        .when(over, F.concat(F.format_string('"%s" is ', name), format_bytes("size_bytes"), F.lit(", the limit is "), format_bytes(F.lit(max_bytes or 0))))
        .when(~looks_like_export(F.col("content")), F.format_string('"%s" does not look like an export', name))
    )
    return files.withColumn("reason", reason)


def split_accepted(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted files, quarantined files with their reason and without content)."""
    return gated.where("reason is null").drop("reason"), gated.where("reason is not null").drop("content")
