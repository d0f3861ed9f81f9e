"""Readable facts about processes and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.functions import text as t
from procatlas.model import OWNER, Estate, located_owner

QUEUE_OBJECT = "Work Queues"


def _first_raw() -> Column:
    return F.coalesce(F.get("exprs", F.lit(0))["raw"], F.lit(""))


def _whole(number: Column) -> Column:
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def step_sentence() -> Column:
    """One sentence per flow stage, null for stages that are not a step."""
    queue = F.col("queue_name").isNotNull() | (F.coalesce("object_name", F.lit("")) == QUEUE_OBJECT)
    steps = F.coalesce(F.size("steps"), F.lit(0))
    stores = F.array_join(F.transform("steps", lambda s: s["store_in"]), ", ")
    actions = F.array_join(F.transform("steps", lambda s: s["action"]), ", ")
    choices = F.array_join(F.transform("exprs", lambda e: e["name"]), " / ")
    target = F.when(F.coalesce("target_page_name", F.lit("")) == "", F.col("name")).otherwise(F.col("target_page_name"))
    limit = F.when(
        F.col("timeout_seconds") > 0, F.concat(F.lit(" (timeout "), _whole(F.col("timeout_seconds")), F.lit("s)"))
    ).otherwise(" (no timeout)")
    detail = F.when(F.size("exprs") > 0, F.concat(F.lit(" ("), t.truncate(_first_raw(), 40), F.lit(")"))).otherwise("")
    say = {
        "calculation": F.concat(F.lit("Set "), F.col("store_in"), F.lit(" = "), t.truncate(_first_raw())),
        "multiCalc": F.concat(F.lit("Set "), steps.cast("string"), F.lit(" values ("), t.truncate(stores, 50), F.lit(")")),
        "decision": F.concat(F.lit("Decide: "), t.truncate(_first_raw())),
        "choice": F.concat(F.lit("Choose between "), choices),
        "loopStart": F.concat(F.lit("For each row in "), F.col("collection_name")),
        "loopEnd": F.lit("End loop"),
        "subsheetRef": F.concat(F.lit('Run page "'), target, F.lit('"')),
        "read": F.concat(F.lit("Read "), steps.cast("string"), F.lit(" value(s) from the application")),
        "write": F.concat(F.lit("Write "), steps.cast("string"), F.lit(" value(s) to the application")),
        "navigate": F.concat(F.lit("Navigate: "), F.coalesce(actions, F.lit(""))),
        "wait": F.concat(F.lit("Wait for "), steps.cast("string"), F.lit(" condition(s)"), limit),
        "alert": F.concat(F.lit("Alert: "), t.truncate(_first_raw())),
        "exception": F.concat(F.lit("Throw "), F.coalesce("exception_type", F.lit("exception")), detail),
        "recover": F.lit("Recover from exception"),
        "resume": F.lit("Resume normal flow"),
        "code": F.concat(F.lit("Run "), F.col("language"), F.lit(' code "'), F.col("name"), F.lit('"')),
        "generic": F.concat(F.lit('Unrecognized stage "'), F.col("name"), F.lit('" ('), F.col("raw_type"), F.lit(")")),
    }
    call = F.when(
        queue, F.concat(F.lit('Queue "'), F.coalesce("queue_name", F.lit("(dynamic)")), F.lit('": '), F.col("action_name"))
    ).otherwise(F.concat(F.lit("Call "), F.col("object_name"), F.lit(" › "), F.col("action_name")))
    out = F.when(F.col("kind") == "action", call)
    for kind, text in say.items():
        out = out.when(F.col("kind") == kind, text)
    return out


def outline(stages: DataFrame) -> DataFrame:
    """The steps of every page in order, one row per step."""
    said = stages.withColumn("sentence", step_sentence()).where(F.col("sentence").isNotNull())
    return said.select("release_id", "owner_id", "page_id", "page_name", "page_index", "stage_pos", "sentence")


def first_steps(stages: DataFrame, n: int) -> DataFrame:
    """The first n steps of the main page of each owner."""
    from procatlas.operators.windows import top_per_key

    main = outline(stages.where(F.col("page_index") == 0))
    return top_per_key(main, ["release_id", "owner_id"], [F.col("stage_pos")], n)


def location_paths(findings: DataFrame, estate: Estate) -> DataFrame:
    """Findings with ``process/<owner>/<page>/<stage>`` as far as known, else ``release``."""
    from procatlas.operators.engine import resolve_names

    named = resolve_names(findings, estate)
    role = F.when(F.col("location.process_id").isNotNull(), "process").otherwise("object")
    path = F.concat_ws(
        "/", F.when(F.col("owner_name").isNotNull(), role), "owner_name",
        F.when(F.col("owner_name").isNotNull(), F.col("page_name")),
        F.when(F.col("page_name").isNotNull(), F.col("stage_name")),
    )
    return named.withColumn("location_path", F.coalesce(F.nullif(path, F.lit("")), F.lit("release"))).select(
        *findings.columns, "location_path"
    )


def finding_spots(findings: DataFrame, estate: Estate) -> DataFrame:
    """Findings with a readable place: stage and page, page, element, or owner."""
    from procatlas.operators.engine import resolve_names

    named = resolve_names(findings, estate)
    quote = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    spot = (
        F.when(F.col("owner_name").isNull(), "unknown location")
        .when(F.col("stage_name").isNotNull(), F.concat(quote("stage_name"), F.lit(" ("), F.col("page_name"), F.lit(")")))
        .when(F.col("page_name").isNotNull(), F.concat(F.lit("page "), quote("page_name")))
        .when(F.col("element_name").isNotNull(), F.concat(F.lit("element "), quote("element_name")))
        .otherwise(F.col("owner_name"))
    )
    return named.withColumn("spot", spot).select(*findings.columns, "spot")


def stage_profile(stages: DataFrame, pages: DataFrame, items: DataFrame) -> DataFrame:
    """Per owner: stages, pages and data items."""
    n = lambda df, name: df.groupBy(*OWNER).agg(F.count("*").alias(name))
    joined = n(pages, "page_count").join(n(stages, "stage_count"), list(OWNER), "full_outer").join(
        n(items, "item_count"), list(OWNER), "full_outer"
    )
    return joined.na.fill(0)


def kind_profile(stages: DataFrame) -> DataFrame:
    """Stages per owner and kind."""
    return stages.groupBy(*OWNER, "kind").agg(F.count("*").alias("n"))


def touched(stages: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct (owner, role, name) a process touches: objects, queues and the objects' applications."""
    calls = stages.where((F.col("kind") == "action") & (F.col("owner_type") == "process"))
    queue = F.col("queue_name").isNotNull() | (F.col("object_name") == QUEUE_OBJECT)
    direct = calls.select(
        *OWNER, F.when(queue, "queue").otherwise("object").alias("role"),
        F.when(queue, F.coalesce("queue_name", F.lit("(dynamic)"))).otherwise(F.col("object_name")).alias("name"),
    ).distinct()
    # several objects of one name: the first one counts
    apps = owners.where(F.col("owner_type") == "object").groupBy("release_id", "name").agg(
        F.min_by(F.struct("application_name"), "owner_pos")["application_name"].alias("application")
    ).where(F.coalesce("application", F.lit("")) != "")
    through = (
        direct.where("role = 'object'").join(apps, ["release_id", "name"])
        .select(*OWNER, F.lit("application").alias("role"), F.col("application").alias("name")).distinct()
    )
    return direct.unionByName(through)


def summarize_processes(estate: Estate) -> DataFrame:
    """Counts per process; the names behind them are in ``touched``."""
    names = touched(estate.stages, estate.owners).groupBy(*OWNER).agg(
        *[F.count_if(F.col("role") == r).alias(f"{r}s") for r in ("object", "queue", "application")]
    )
    recovers = estate.stages.groupBy(*OWNER).agg(
        F.bool_or(F.col("kind") == "recover").alias("has_recovery"),
        F.count_if(F.col("kind") == "exception").alias("deliberate_throws"),
    )
    params = estate.params.groupBy(*OWNER).agg(
        F.count_if(F.col("direction") == "in").alias("inputs"), F.count_if(F.col("direction") == "out").alias("outputs")
    )
    profile = stage_profile(estate.stages, estate.pages, estate.data_items)
    base = estate.owners.where(F.col("owner_type") == "process").select(*OWNER, "name", "description")
    for more in (profile, names, recovers, params):
        base = base.join(more, list(OWNER), "left")
    return base.na.fill(0).na.fill(False)


def summarize_objects(estate: Estate) -> DataFrame:
    recovers = estate.stages.groupBy(*OWNER).agg(F.bool_or(F.col("kind") == "recover").alias("has_recovery"))
    profile = stage_profile(estate.stages, estate.pages, estate.data_items).withColumnRenamed("page_count", "action_pages")
    base = estate.owners.where(F.col("owner_type") == "object").select(*OWNER, "name", "description", "application_name")
    return base.join(profile, list(OWNER), "left").join(recovers, list(OWNER), "left").na.fill(0).na.fill(False)


def exception_strategy(stages: DataFrame) -> DataFrame:
    """Pages with recovery and every deliberate throw, one row each."""
    pages = stages.where(F.col("kind") == "recover").select(
        *OWNER, F.lit("recovery_page").alias("fact"), "page_name", F.lit(None).cast("string").alias("stage_name"),
        F.lit(None).cast("string").alias("exception_type"),
    ).distinct()
    throws = stages.where(F.col("kind") == "exception").select(
        *OWNER, F.lit("throw").alias("fact"), "page_name", F.col("name").alias("stage_name"), "exception_type"
    )
    return pages.unionByName(throws)


def sensitivity_flags(stages: DataFrame, items: DataFrame) -> DataFrame:
    """Items and collection fields with a sensitive name, and items of the password type."""
    placed = stages.where(F.col("kind").isin("data", "collection")).select(
        *OWNER, F.col("data_item_id").alias("item_id"), "page_name"
    )
    reason = F.when(t.is_sensitive_name("name"), "name-pattern").when(F.col("data_type") == "password", "password-type")
    fields = F.transform(
        F.filter(F.coalesce("fields", F.array().cast("array<struct<name:string,data_type:string>>")), lambda f: t.is_sensitive_name(f["name"])),
        lambda f: F.struct(F.concat_ws(".", "name", f["name"]).alias("item_name"), F.lit("name-pattern").alias("reason")),
    )
    own = F.filter(F.array(F.struct(F.col("name").alias("item_name"), reason.alias("reason"))), lambda s: s["reason"].isNotNull())
    flags = items.select(*OWNER, "item_id", F.inline(F.concat(own, fields)))
    return flags.join(placed, [*OWNER, "item_id"]).select(*OWNER, "item_name", "page_name", "reason")


def findings_by_owner(findings: DataFrame) -> DataFrame:
    return findings.withColumn("owner_id", located_owner())
