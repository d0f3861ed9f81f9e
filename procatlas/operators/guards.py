"""Checks that no content leaves with the metadata."""

from __future__ import annotations


from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procatlas.functions import literals
from procatlas.functions import text as t
from procatlas.model import OWNER, PAGE, Estate
from procatlas.operators.search import contained

# Marks of source content, and the lengths from which values are guarded.
CONTENT_MARKERS = ("<?xml", "<process", "<stage", "<object", "xmlns", "<activity", "</")
MIN_DATA_VALUE, MIN_ATTRIBUTE_VALUE = 4, 8
MAX_PAYLOAD_BYTES = 100_000


def digest_stages(stages: DataFrame) -> DataFrame:
    """Names, kinds and references of stages; no expression text, no values."""
    refs = F.array_sort(F.array_distinct(F.flatten(F.transform("exprs", lambda e: t.extract_refs(e["raw"])))))
    return stages.select(
        *PAGE, "page_name", "page_index", "stage_pos", "name", "kind",
        F.col("object_name").alias("object"), F.col("action_name").alias("action"), F.when(F.size(refs) > 0, refs).alias("refs"),
    )


def build_digest(estate: Estate) -> DataFrame:
    """The redacted digest, one JSON line per part: owner, stage, data item, parameter, element, queue, credential.

    Lines carry their place, so a reader can rebuild documents of any size in order
    without any task holding a whole owner.
    """
    owner = estate.owners.select(*OWNER, "owner_type", "name")

    def line(df: DataFrame, part: str, place: Column, *columns: str | Column) -> DataFrame:
        return df.select("release_id", *(["owner_id"] if "owner_id" in df.columns else [F.lit(None).cast("string").alias("owner_id")]), F.lit(part).alias("part"), place.cast("string").alias("place"), F.to_json(F.struct(*columns)).alias("line"))

    stages = digest_stages(estate.stages)
    items = estate.data_items.select(*OWNER, "item_pos", "name", F.col("data_type").alias("type"), "exposure", "fields")
    zero = F.lit(0)
    parts = [
        line(owner, "owner", zero, "name", F.col("owner_type").alias("role")),
        line(stages, "stage", F.format_string("%06d/%09d", F.col("page_index"), F.col("stage_pos")), F.col("page_name").alias("page"), "name", "kind", "object", "action", "refs"),
        line(items, "item", F.col("item_pos"), "name", "type", "exposure", "fields"),
        line(estate.params, "param", F.col("param_pos"), "name", F.col("data_type").alias("type"), "direction"),
        line(estate.elements, "element", F.col("element_pos"), "name", "mode"),
        line(estate.work_queues, "queue", F.col("queue_pos"), "name"),
        line(estate.credentials, "credential", zero, "name"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def forbidden_values(items: DataFrame, elements: DataFrame) -> DataFrame:
    """Distinct values per release that must not appear: initial values and attribute values of some length."""
    data = items.where(F.length(F.trim(F.coalesce("initial_value", F.lit("")))) >= MIN_DATA_VALUE).select("release_id", F.col("initial_value").alias("value"))
    attributes = elements.select("release_id", F.explode("attributes.value").alias("value")).where(F.length(F.trim("value")) >= MIN_ATTRIBUTE_VALUE)
    return data.unionByName(attributes).distinct()


def leaked_values(texts: DataFrame, values: DataFrame, keys: Sequence[str] = ("release_id",), size: int = MIN_DATA_VALUE) -> DataFrame:
    """(keys, text_id, value) wherever a text contains a value of at least ``size`` characters, whatever the case."""
    sought = values.withColumn("body", F.lower("value")).where(F.length("body") >= size)
    return contained(texts.withColumn("body", F.lower("text")), sought, list(keys))


def digest_leaks(estate: Estate) -> DataFrame:
    """Digest lines that contain a guarded value; a release with any must not leave."""
    lines = build_digest(estate)
    texts = lines.select("release_id", F.concat_ws("/", "part", F.coalesce("owner_id", F.lit("")), "place").alias("text_id"), F.col("line").alias("text"))
    quoted = F.to_json(F.struct(F.col("value").alias("v")))
    values = forbidden_values(estate.data_items, estate.elements).select("release_id", quoted.substr(F.lit(7), F.length(quoted) - 8).alias("value"))
    return leaked_values(texts, values)


def _strings(schema: T.StructType) -> list[tuple[str, Column]]:
    """(path, text) of every column that can hold text; nested ones as JSON without escapes of the markers."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StringType):
            out.append((f.name, F.col(f"`{f.name}`")))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append((f.name, F.to_json(F.col(f"`{f.name}`"))))
    return out


def content_markers(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, marker) for every text column that contains a mark of source content."""
    checks = []
    for path, text in _strings(df.schema):
        low = F.lower(text)
        for marker in CONTENT_MARKERS:
            checks.append(F.when(F.contains(low, F.lit(marker)), F.struct(F.lit(path).alias("path"), F.lit(marker).alias("marker"))))
    found = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return df.select(*keys, F.inline(found))


def size_violations(df: DataFrame, keys: list[str], limit: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """Rows whose JSON form is larger than the limit."""
    sized = df.select(*keys, F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long").alias("bytes"))
    return sized.where(F.col("bytes") > limit)


def redact_code_column(df: DataFrame, column: str) -> DataFrame:
    """``column`` without its literals, the literals, and those that still show through."""
    done = df.withColumn("literals", literals.long_literals(column)).withColumn("redacted", literals.redact_literals(column))
    return done.withColumn("survivors", literals.surviving_literals("redacted", "literals")).drop(column)


def encrypt_payload(df: DataFrame, column: str, key: Column) -> DataFrame:
    """AES-GCM with a random IV, and the SHA-256 of what was encrypted."""
    secret = F.aes_encrypt(F.col(column).cast("binary"), key, F.lit("GCM"))
    return df.withColumn("plaintext_sha256", F.sha2(F.col(column).cast("binary"), 256)).withColumn("payload", secret).drop(column)


def verify_payload(df: DataFrame, key: Column) -> DataFrame:
    """Decrypt; ``intact`` says whether the content is what was encrypted, false also for a wrong key."""
    plain = F.try_aes_decrypt("payload", key, F.lit("GCM"))
    return df.withColumn("plain", plain).withColumn(
        "intact", F.coalesce(F.sha2("plain", 256) == F.col("plaintext_sha256"), F.lit(False))
    )


def code_overrides(stages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Code stages with the accepted replacement of their body, if any."""
    accepted = overrides.where("accepted").select(*PAGE, "stage_id", "replacement")
    joined = stages.where(F.col("kind") == "code").join(accepted, [*PAGE, "stage_id"], "left")
    return joined.withColumn("body", F.coalesce(F.trim("replacement"), "body")).withColumn("replaced", F.col("replacement").isNotNull()).drop("replacement")


