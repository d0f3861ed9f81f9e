"""Exact duplicates: one row of each group of equal texts stays.

Rows meet on a 128-bit hash of the normalised text in a slim table without texts, so that a group of copies of any
size is combined in every task before the shuffle. Only texts of groups with more than one row are compared byte by
byte: grouping by (hash, text) leaves one row per text and task. Where one hash has several texts, each is a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.llm.store import stored

SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without any white space of ASCII; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def content_hash(text: Column) -> Column:
    """128 bits of a normalised text."""
    return F.unhex(F.md5(text))


def _best(points: Column, doc_id: Column) -> Column:
    """Orders a group's rows: most code points, then smallest id, rows without an id last."""
    return F.struct((-points).alias("neg"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"))


def _groups(docs: DataFrame, text: str, doc_id: str, hash128: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(slim rows, groups): slim has ``h, doc_id, points, text_sha256, cls``, groups ``h, cls, best, ties, n``.

    ``cls`` is null unless several texts share the hash; then it is the text's SHA-256 beside its length.
    """
    norm = normalised(F.col(text))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("points"), norm.alias("norm"))
    slim = stored(slim.select("doc_id", "points", hash128(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256")), "exact-slim")
    by_hash = slim.groupBy("h").agg(F.min(_best(F.col("points"), F.col("doc_id"))).alias("best"), F.count("*").alias("n"))
    several = by_hash.filter("n > 1").select("h")
    texts = docs.select(norm.alias("norm")).select(hash128(F.col("norm")).alias("h"), "norm")
    compared = texts.join(several, "h", "left_semi").groupBy("h", "norm").agg(F.count("*").alias("n"))
    clashes = stored(compared.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"), "exact-clashes")
    # SHA-256 tells the texts of a clashing hash apart; their bytes have just been compared.
    slim = slim.join(clashes.withColumn("clash", F.lit(True)), "h", "left")
    slim = slim.withColumn("cls", F.when(F.col("clash"), F.col("text_sha256")).otherwise(F.lit(""))).drop("clash")
    best = _best(F.col("points"), F.col("doc_id"))
    groups = slim.groupBy("h", "cls").agg(F.min(best).alias("best"), F.count("*").alias("n"))
    return slim, groups


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after all ASCII white space is deleted. The row with the most code points stays,
    then the smallest id. Null and empty texts are equal; a row without an id stays only where no row of its group
    with as many code points has one, and then its ``keep_id`` is null. Rows that repeat an id are counted each; all
    that repeat the kept id with as many code points are marked kept. Other columns are ignored. An empty table gives
    an empty result. ``hash128`` may be weakened in tests.
    """
    slim, groups = _groups(docs, text, doc_id, hash128)
    return slim.join(groups, ["h", "cls"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("points") == -F.col("best.neg"))).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat an id and a text one stays."""
    slim, groups = _groups(docs, text, doc_id, hash128)
    best = _best(F.col("points"), F.col("doc_id"))
    tied = slim.join(groups.select("h", "cls", "best"), ["h", "cls"]).filter(best.eqNullSafe(F.col("best")))
    ties = tied.groupBy("h", "cls", "best").agg(F.count("*").alias("ties"))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).withColumn("norm", normalised(F.col(f"row.{text}")))
    whole = whole.select("row", hash128(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("sha"), F.length(F.coalesce(F.col(f"row.{text}"), F.lit(""))).cast("long").alias("points"))
    chosen = stored(ties.select(F.col("h").alias("gh"), "cls", "best", "ties"), "exact-chosen")
    match = (
        (F.col("h") == F.col("gh"))
        & ((F.col("cls") == "") | (F.col("cls") == F.col("sha")))
        & (F.col("points") == -F.col("best.neg"))
        & F.col(f"row.{doc_id}").eqNullSafe(F.col("best.doc_id"))
    )
    once = whole.join(chosen.filter("ties = 1"), match).select("row.*")
    repeated = chosen.filter("ties > 1")
    if repeated.isEmpty():
        return once
    return once.unionByName(whole.join(repeated, match).dropDuplicates(["h", "cls"]).select("row.*"))
