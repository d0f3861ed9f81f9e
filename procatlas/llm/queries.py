"""The registered queries of the subpackage; ``QUERIES`` and ``CHECKS`` are read by the entry points."""

from __future__ import annotations

from procatlas.llm import centroids, checks, exact_dedup, host_quality, html_blocks, language, mixing, near_dedup, packing, records, topk, toxicity, url_rules, whitening
from procatlas.llm.store import place, stored
from procatlas.plans.registry import Query
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return wrap


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def page_document(url: Column) -> Column:
    """The number of the document that a page shows, which its path ends with."""
    return F.regexp_extract(url_rules.path_of(url), r"/([0-9]+)(?:\.html|/)?$", 1).try_cast("long")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = toxicity.fit(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(model, F.col("text"))
    return docs.select("doc_id", held_out.alias("held_out"), scored.alias("scored")).select("doc_id", "held_out", "scored.score", "scored.predicted")


@query("op2_minhash_near_dedup")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op3_url_rules")
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the quality of the document it shows, and by nothing else; block rules are kept by their lift."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    quality = table(spark, sf_dir, "labels").filter("quality in (0, 1)").groupBy(F.col("doc_id").alias("shown")).agg(F.min("quality").alias("quality"))
    label = F.when(F.col("quality") == 0, url_rules.BLOCK).when(F.col("quality") == 1, url_rules.ALLOW)
    labelled = pages.select("url", page_document(F.col("url")).alias("shown")).join(quality, "shown").select("url", label.alias("label"))
    mined = url_rules.mine(labelled, min_lift=2.0)
    return url_rules.judge_urls(pages, mined, URL_RULES, by="lift").select("page_id", "host", "path", "rule", "verdict", "confidence")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = language.fit(docs.filter(~held_out))
    judged = language.judge_language(model, F.col("text"))
    return docs.select("doc_id", held_out.alias("held_out"), judged.alias("judged")).select("doc_id", "held_out", "judged.*")


def training_pages(pages: DataFrame, docs: DataFrame, many: int = 600) -> DataFrame:
    """Document and html hash, ``shown`` and ``draw``, of the ``many`` first by hash of the pages that can teach; no text leaves the scans.

    Page and document together are as short as fit() asks; of documents that share an id the shortest counts, the one with
    a text. Pages that repeat count once.
    """
    usable = docs.filter((F.length("text") > 0) & (F.length("text") <= html_blocks.MOST_CHARS)).groupBy(F.col("doc_id").alias("shown")).agg(F.min(F.length("text")).alias("chars"))
    asked = pages.select(page_document(F.col("url")).alias("shown"), F.xxhash64("html").alias("draw"), F.length("html").alias("size"))
    asked = asked.filter(F.col("shown").isNotNull() & (F.col("size") <= html_blocks.MOST_CHARS)).distinct()
    fits = asked.join(usable, "shown").filter(F.col("size") + F.col("chars") <= html_blocks.MOST_CHARS)
    return fits.orderBy("draw", "shown").limit(many).select("shown", "draw")


@query("op5_html_blocks")
def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labeller learns from pages whose document is in the table and has a text; of these 600 are drawn, more than fit() takes."""
    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    drawn = stored(training_pages(pages, docs), "pages-drawn")
    asked = pages.select("html", page_document(F.col("url")).alias("shown"), F.xxhash64("html").alias("draw")).join(F.broadcast(drawn), ["shown", "draw"])
    asked = asked.groupBy("shown", "draw").agg(F.min("html").alias("html"))
    ids = drawn.select(F.col("shown").alias("doc_id")).distinct()
    truths = docs.filter(F.length("text") > 0).join(F.broadcast(ids), "doc_id").groupBy(F.col("doc_id").alias("shown"))
    known = truths.agg(F.min(F.struct(F.length("text"), "text"))["text"].alias("truth"))
    model = html_blocks.fit(asked.join(known, "shown"))
    found = html_blocks.extract_text(model, F.col("html"))
    return pages.select("page_id", "url", found.alias("found")).select("page_id", "url", "found.text", F.length("found.text").cast("long").alias("n_chars"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_exact_dedup", """
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM normal)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM best""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op8_threshold_top_k", """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op8_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op9_binary_records")
def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = place(docs, "records")
    records.write_records(docs, folder, vocabulary())
    found = records.read_records(spark, folder)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op11_host_quality", checks.host_quality())
def op11_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source."""
    judged = host_quality.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op12_cholesky_whitening")
def op12_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_centroids", checks.clusters())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))
