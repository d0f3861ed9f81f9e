"""Rules on dead logic, unused data, near-copies and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.functions import text as t
from procatlas.model import OWNER, PAGE, Estate
from procatlas.operators import graph, similarity
from procatlas.operators.engine import define_rule, make_finding
from procatlas.operators.windows import join_null_safe

NON_FLOW_KINDS = ("data", "collection", "note", "generic")
ENTRY_KINDS = ("start", "recover")
PROCESS_STAGE_LIMIT = 150
PAGE_STAGE_LIMIT = 60


def unreachable_stages(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """Flow stages that no start or recover stage of their page leads to."""
    seeds = F.col("kind").isin(*ENTRY_KINDS)
    reached = graph.reachable(stages.withColumn("seed", seeds), edges)
    flow = stages.where(~F.col("kind").isin(*ENTRY_KINDS, *NON_FLOW_KINDS))
    return flow.join(reached.where("reached").drop("reached"), [*PAGE, "stage_id"], "left_anti")


def orphan_pages(pages: DataFrame, stages: DataFrame) -> DataFrame:
    """Process pages after the first that no resolved page call of the process names."""
    called = stages.where((F.col("kind") == "subsheetRef") & F.col("target_page_id").isNotNull()).select(
        "release_id", "owner_id", F.col("target_page_id").alias("page_id")
    )
    candidates = pages.where((F.col("owner_type") == "process") & (F.col("page_index") > 0))
    return candidates.join(called, list(PAGE), "left_anti")


@define_rule("MNT-001", "Dead logic", "medium", "maintainability",
             "Stages that control flow cannot reach, and process pages that nothing calls.")
def mnt_001(estate: Estate, meta) -> DataFrame:
    dead = unreachable_stages(estate.stages, estate.edges)
    orphans = orphan_pages(estate.pages, estate.stages)
    by_stage = F.format_string('Stage "%s" cannot be reached from any start or recover stage.', "name")
    by_page = F.format_string('Nothing calls page "%s".', "name")
    remedy = "Delete it or connect it before moving the process."
    return make_finding(
        meta, dead, by_stage, remedy, 0.9, page=F.col("page_id"), stage=F.col("stage_id")
    ).unionByName(make_finding(meta, orphans, by_page, remedy, 0.9, page=F.col("page_id")))


def item_names_used() -> Column:
    """Every item name a stage reads or writes."""
    read = F.flatten(F.transform("exprs", lambda e: t.base_refs(e["raw"])))
    stored = F.transform("outputs", lambda o: o["store_in"])
    stepped = F.transform("steps", lambda s: s["store_in"])
    none = F.array().cast("array<string>")
    single = F.array("store_in", "collection_name")
    every = F.concat(*[F.coalesce(a, none) for a in (read, stored, stepped, single)])
    return F.filter(F.array_distinct(every), lambda n: n.isNotNull())


def unused_items(stages: DataFrame) -> DataFrame:
    """Data and collection stages whose name no stage of the same owner uses.

    The used names are made distinct before they meet the definitions, so a busy
    item costs one row per owner however often it is read.
    """
    used = stages.select(*OWNER, F.explode(item_names_used()).alias("name")).distinct()
    defined = stages.where(F.col("kind").isin("data", "collection"))
    return defined.join(used, [*OWNER, "name"], "left_anti")


@define_rule("MNT-002", "Unused data item", "low", "maintainability",
             "A data item that no stage of its owner reads or writes.")
def mnt_002(estate: Estate, meta) -> DataFrame:
    message = F.format_string('No stage uses data item "%s".', "name")
    return make_finding(meta, unused_items(estate.stages), message, "Delete the item.", 0.85,
                        page=F.col("page_id"), stage=F.col("stage_id"))


@define_rule("MNT-003", "Near-duplicate objects", "medium", "maintainability",
             "Objects of one release whose structure agrees by more than 85 percent.")
def mnt_003(estate: Estate, meta) -> DataFrame:
    tokens = similarity.structure_tokens(estate)
    rows = similarity.near_duplicates(tokens).withColumn("owner_type", F.lit("object"))
    message = F.format_string('The structure agrees with object id "%s" by %.0f percent.',
                              F.col("canonical_id"), F.col("similarity") * 100)
    return make_finding(meta, rows, message, "Keep one shared object.", 0.8)


def oversize(stages: DataFrame, process_limit: int = PROCESS_STAGE_LIMIT, page_limit: int = PAGE_STAGE_LIMIT) -> DataFrame:
    """Processes with too many stages, or with a page of too many; counted per page first. ``reasons`` names each such page."""
    per_page = (
        stages.where(F.col("owner_type") == "process")
        .groupBy("release_id", "owner_id", "owner_type", "page_id")
        .agg(F.count("*").alias("n"))
    )
    owner = ["release_id", "owner_id", "owner_type"]
    per_owner = per_page.groupBy(*owner).agg(
        F.sum("n").alias("stage_count"), F.count_if(F.col("n") > page_limit).alias("large_pages"), F.max("n").alias("largest_page")
    )
    # only large pages are listed: a list for every owner would be sorted and spilled
    named = F.array_sort(F.collect_list(F.format_string('page "%s" has %d', "page_id", "n"))).alias("reasons")
    reasons = per_page.where(F.col("n") > page_limit).groupBy(*owner).agg(named)
    kept = per_owner.where((F.col("stage_count") > process_limit) | (F.col("large_pages") > 0))
    return join_null_safe(kept, reasons, owner, "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


@define_rule("MNT-004", "Oversized process", "medium", "maintainability",
             "A process of more than 150 stages or with a page of more than 60.")
def mnt_004(estate: Estate, meta) -> DataFrame:
    return oversize_findings(estate, meta)


def oversize_findings(estate: Estate, meta, process_limit=PROCESS_STAGE_LIMIT, page_limit=PAGE_STAGE_LIMIT) -> DataFrame:
    message = F.format_string("%d stages in all; %s.", F.col("stage_count"),
                              F.when(F.size("reasons") == 0, "no page is over the limit").otherwise(F.array_join("reasons", ", ")))
    return make_finding(meta, oversize(estate.stages, process_limit, page_limit), message,
                        "Split it into a part that loads work and a part that does it.", 0.95)
