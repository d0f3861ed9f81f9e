"""How much of an estate can be moved: selectors, mappings, coverage, manual work, effort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.functions import text as t
from procatlas.functions.expressions import FUNCTION_NAMES
from procatlas.model import OWNER, PAGE, STAGE, Estate
from procatlas.operators import graph, naming, syntax
from procatlas.operators.score import coverage_pct
from procatlas.operators.select import uses_queues
from procatlas.session import cut, written

# Target attribute per mode and source attribute, tag per mode.
ATTRIBUTES = {
    "HTML": {"tag": "tag", "id": "id", "name": "name", "title": "title", "class": "class", "innertext": "innertext"},
    "Win32": {"windowtext": "title", "classname": "cls", "name": "name", "controlid": "ctrlid"},
    "UIA": {"automationid": "automationid", "name": "name", "classname": "cls", "windowtext": "title"},
    "Java": {"name": "name", "role": "role", "description": "description"},
    "SAP": {"id": "id", "name": "name"},
}
TAGS = {"HTML": "webctrl", "Win32": "wnd", "UIA": "ctrl", "Java": "java", "SAP": "sap"}
STRONG = ("id", "automationid", "ctrlid", "name")
IMAGE_MODES = ("Citrix", "Region")
# Planning minutes.
MINUTES_PER_STAGE, MINUTES_PER_PUNCH, MINUTES_PER_SELECTOR, MINUTES_PER_RISK = 3, 30, 10, 20
# Target type of each data type.
TARGET_TYPES = {
    "text": "String", "password": "String", "time": "String", "timespan": "String", "number": "Double",
    "flag": "Boolean", "date": "DateTime", "datetime": "DateTime", "collection": "DataTable",
    "image": "Object", "binary": "Object",
}


def _lookup(key: Column, mapping: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def domain_type(data_type: Column | str) -> Column:
    """Target type of a data type."""
    return F.coalesce(_lookup(F.col(data_type) if isinstance(data_type, str) else data_type, TARGET_TYPES), F.lit("String"))


# --- selectors ---------------------------------------------------------------


def _target_attribute(mode: Column, name: Column) -> Column:
    known = {f"{m}/{source}": target for m, pairs in ATTRIBUTES.items() for source, target in pairs.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.concat_ws("/", mode, F.lower(name)))


def _escaped(value: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def score_selectors(elements: DataFrame) -> DataFrame:
    """Per element the selector, its strategy, a confidence and notes; one projection, no join."""
    mode = F.col("mode")
    cells = F.transform(
        F.filter("attributes", lambda a: a["enabled"]),
        lambda a: F.struct(
            a["name"].alias("name"), a["value"].alias("value"), a["match_type"].alias("match_type"),
            F.when(a["match_type"] == "index", "idx").otherwise(_target_attribute(mode, a["name"])).alias("target"),
        ),
    )
    text = F.lit(None).cast("string")
    notes = F.filter(
        F.concat(
            F.transform(F.filter("attributes", lambda a: ~a["enabled"]), lambda a: F.format_string('"%s" is switched off', a["name"])),
            F.transform(
                "cells",
                lambda c: F.when(c["match_type"] == "index", F.format_string('"%s" matches by index', c["name"]))
                .when(c["target"].isNull(), F.format_string('"%s" has no counterpart', c["name"]))
                .when(c["match_type"] == "regex", F.format_string('"%s" was a pattern, check it', c["name"]))
                .otherwise(text),
            ),
        ),
        lambda n: n.isNotNull(),
    )
    base = F.when(mode == "SAP", 0.85).when(mode == "UIA", 0.8).otherwise(0.7)
    lifted = F.when(F.col("strong"), F.least(F.lit(0.9), base + 0.15)).otherwise(base)
    single = F.when((F.size("parts") == 1) & ~F.col("strong"), F.least(lifted, F.lit(0.4))).otherwise(lifted)
    final = F.when(F.col("by_index"), F.least(single, F.lit(0.25))).otherwise(single)
    tag = F.coalesce(_lookup(mode, TAGS), F.lit("wnd"))
    words = F.transform("parts", lambda c: F.concat(c["target"], F.lit("='"), _escaped(c["value"]), F.lit("'")))
    image = mode.isin(*IMAGE_MODES) | (F.size("parts") == 0)
    return (
        elements.withColumn("cells", cells)
        .withColumn("parts", F.filter("cells", lambda c: c["target"].isNotNull()))
        .withColumn("strong", F.exists("parts", lambda c: (c["match_type"] != "index") & c["target"].isin(*STRONG)))
        .withColumn("by_index", F.exists("parts", lambda c: c["match_type"] == "index"))
        .select(
            "release_id", "owner_id", "element_id", "name", "mode",
            F.when(image, "image-ocr").otherwise("selector").alias("strategy"),
            F.when(image, 0.1).otherwise(F.round(final, 2)).alias("confidence"),
            F.when(~image, F.concat(F.lit("<"), tag, F.lit(" "), F.array_join(words, " "), F.lit(" />"))).alias("selector"),
            notes.alias("notes"),
        )
    )


# --- coverage ----------------------------------------------------------------


def walked(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """Stages that the first start or first recover stage of their page leads to."""
    entries = reduce(DataFrame.unionByName, [graph.first_stage(stages, k) for k in ("start", "recover")])
    seeded = stages.join(entries.withColumn("seed", F.lit(True)), [*PAGE, "stage_id"], "left")
    return graph.reachable(seeded, edges).where("reached").drop("reached")


def convertible_stages(estate: Estate, reached: DataFrame | None = None) -> DataFrame:
    """Every stage with ``converted``; ``reached`` is what ``walked`` gives, where a caller has it.

    Data stages, the first start and the first recover always count.  Of the stages
    the page leads to, alerts, unknown types, jscript and calls of missing objects do
    not.  All branches are followed, where the compared tool follows the first
    successor of each stage and stops at a cycle.
    """
    reached = (walked(estate.stages, estate.edges) if reached is None else reached).withColumn("reached", F.lit(True))
    found = graph.resolve_calls(estate.stages, estate.owners, estate.pages).where(
        F.col("found") & (F.col("owner_type") == "process")
    ).select(*STAGE, "found")
    call = (F.col("kind") == "action") & ~uses_queues()
    lost = call & F.col("found").isNull()
    never = F.col("kind").isin("alert", "generic", "recover", "start") | ((F.col("kind") == "code") & (F.col("language") == "jscript")) | lost
    first = reduce(DataFrame.unionByName, [graph.first_stage(estate.stages, k) for k in ("start", "recover")]).withColumn("first", F.lit(True))
    out = estate.stages.join(reached, [*PAGE, "stage_id"], "left").join(found, list(STAGE), "left").join(first, [*PAGE, "stage_id"], "left")
    converted = F.col("kind").isin("data", "collection") | F.col("first").isNotNull() | (F.col("reached").isNotNull() & ~never)
    return out.withColumn("converted", F.coalesce(converted, F.lit(False))).drop("reached", "found", "first")


def owner_coverage(converted: DataFrame) -> DataFrame:
    return converted.groupBy(*OWNER, "owner_type").agg(
        F.count("*").alias("stage_count"), F.count_if("converted").alias("converted_count"), coverage_pct().alias("coverage_pct")
    )


# --- signatures --------------------------------------------------------------


def argument_signature(stages: DataFrame, items: DataFrame) -> DataFrame:
    """Arguments and variables of every page.

    A start and an end binding on the same item make one two-way argument; other
    bindings are one-way; the remaining items of the page are variables.
    """
    firsts = reduce(DataFrame.unionByName, [graph.first_stage(stages, k) for k in ("start", "end")])
    bound = stages.join(firsts, [*PAGE, "stage_id"], "left_semi").select(*PAGE, "kind", F.posexplode("outputs").alias("i", "b"))
    given = bound.where("kind = 'start'").select(*PAGE, F.col("b.param_name").alias("in_param"), F.col("b.store_in").alias("item"), F.col("i").alias("in_pos"))
    taken = bound.where("kind = 'end'").groupBy(*PAGE, F.col("b.store_in").alias("item")).agg(
        F.max_by("b.param_name", "i").alias("out_param"), F.min("i").alias("out_pos")
    )
    both = given.join(taken, [*PAGE, "item"], "full_outer")
    way = F.when(F.col("in_param").isNull(), "out").when(F.col("out_param").isNull(), "in").otherwise("inout")
    prefix = F.when(F.col("way") == "inout", "io_").otherwise(F.concat("way", F.lit("_")))
    order = F.when(F.col("in_pos").isNotNull(), F.col("in_pos")).otherwise(F.col("out_pos") + F.lit(1 << 32))
    arguments = both.withColumn("way", way).select(
        *PAGE, "item", "way", F.coalesce("in_param", "out_param").alias("param_name"), "in_param", "out_param",
        F.concat(prefix, t.sanitize_identifier(F.coalesce("in_param", "out_param"))).alias("base"), order.cast("long").alias("rank"),
    )
    local = items.where("page_id is not null").select(*PAGE, F.col("name").alias("item"), "data_type", F.col("item_pos").alias("pos"))
    types = local.groupBy(*PAGE, "item").agg(F.min_by("data_type", "pos").alias("data_type"), F.min("pos").alias("pos"))
    variables = types.join(arguments, [*PAGE, "item"], "left_anti").select(
        *PAGE, "item", F.lit("variable").alias("way"), F.lit(None).cast("string").alias("param_name"), t.sanitize_identifier("item").alias("base"),
        (F.col("pos") + F.lit(1 << 33)).cast("long").alias("rank"),
    )
    named = naming.unique_names(
        arguments.unionByName(variables, allowMissingColumns=True), list(PAGE), "base", "rank", [F.floor(F.col("rank") / 1000)]
    )
    return named.join(types.drop("pos"), [*PAGE, "item"], "left").withColumn("target_type", domain_type("data_type")).drop("base")


def queue_params(stages: DataFrame, items: DataFrame) -> DataFrame:
    """Called pages that receive a whole queue collection, and through which parameter."""
    fetches = stages.where(uses_queues() & (t.queue_action_class("action_name") == "get_next"))
    filled = fetches.select(*PAGE, F.explode("outputs.store_in").alias("item")).distinct()
    known = items.where((F.col("data_type") == "collection") & (F.size("fields") > 0)).select(*OWNER, F.col("name").alias("item")).distinct()
    calls = stages.where(F.col("kind") == "subsheetRef").select(*PAGE, F.col("target_page_name").alias("callee"), F.explode("inputs").alias("i"))
    whole = r"^\s*\[([^\].]+)\]\s*$"
    passed = calls.where((F.col("callee") != "") & F.col("i.raw").rlike(whole)).select(
        *PAGE, "callee", F.col("i.param_name").alias("param_name"), F.trim(F.regexp_extract("i.raw", whole, 1)).alias("item")
    )
    return passed.join(filled, [*PAGE, "item"]).join(known, [*OWNER, "item"], "left_semi").select(*OWNER, "callee", "param_name", "item").distinct()


def pages_needing_item(estate: Estate) -> DataFrame:
    """Process pages that must be handed the queue item: status writers and receivers without a fetch, and their callers."""
    stages = estate.stages.where(F.col("owner_type") == "process")
    role = t.queue_action_class("action_name")
    flags = stages.groupBy(*PAGE, "page_name", "page_index").agg(
        F.bool_or(uses_queues() & (role == "get_next")).alias("fetches"),
        F.bool_or(uses_queues() & role.isin("complete", "exception")).alias("marks"),
    )
    fed = queue_params(stages, estate.data_items).select(*OWNER, F.col("callee").alias("page_name"), F.lit(True).alias("fed")).distinct()
    loops = graph.polling_loops(stages, estate.edges).select(*PAGE, F.lit(True).alias("loops"))
    pages = flags.join(fed, [*OWNER, "page_name"], "left").join(loops, list(PAGE), "left")
    loops_here, fetches = F.coalesce("loops", F.lit(False)), F.coalesce("fetches", F.lit(False))
    pages = pages.withColumn("seed", loops_here | (~fetches & (F.coalesce("marks", F.lit(False)) | F.coalesce("fed", F.lit(False))))).withColumn("stop", fetches)
    calls = stages.where((F.col("kind") == "subsheetRef") & F.col("target_page_id").isNotNull()).select(
        *OWNER, F.col("page_id").alias("caller"), F.col("target_page_id").alias("callee")
    ).distinct()
    return graph.propagate_to_callers(pages, calls)


# --- manual work -------------------------------------------------------------


def expression_calls(stages: DataFrame) -> DataFrame:
    """The functions that expressions call, read by their syntax; one row per call."""
    raw = stages.select(*STAGE, "page_name", "name", "kind", "source_ref", F.explode("exprs.raw").alias("raw"))
    calls = syntax.expression_parts(raw).where(F.col("part") == "call")
    return calls.select(*raw.columns, F.col("text").alias("function"))


def expression_inventory(stages: DataFrame) -> DataFrame:
    """How often each function is called, and whether it has a counterpart."""
    used = expression_calls(stages).groupBy(F.lower("function").alias("function")).agg(F.count("*").alias("uses"))
    return used.withColumn("supported", F.col("function").isin(*FUNCTION_NAMES))


def unresolved_refs(stages: DataFrame, items: DataFrame) -> DataFrame:
    """References to items the owner does not have."""
    refs = stages.select(*OWNER, F.explode("exprs.raw").alias("raw")).select(*OWNER, F.explode(t.base_refs("raw")).alias("name")).distinct()
    return refs.join(items.select(*OWNER, "name").distinct(), [*OWNER, "name"], "left_anti")


def _listed(rows: DataFrame, base: list[str], reasons: list[tuple[Column, str, Column, bool]], more: Column | None = None) -> DataFrame:
    """All reasons (condition, code, text, wholly manual) that hold for a row, in one pass over the rows; ``more`` is an array of further ones."""
    entry = lambda reason, detail, manual: F.struct(F.lit(reason).alias("reason"), detail.alias("detail"), F.lit(manual).alias("manual"))
    held = F.filter(F.array(*[F.when(condition, entry(*found)) for condition, *found in reasons]), lambda r: r.isNotNull())
    return rows.select(*base, F.inline(held if more is None else F.concat(held, more)))


def punch_list(estate: Estate, overrides: DataFrame | None = None, reached: DataFrame | None = None) -> DataFrame:
    """One row per piece of manual work: where, a reason code, a text, and whether it is wholly manual.

    Only stages the flow leads to are listed.  ``overrides`` (stage keys, accepted)
    holds reviewed translations of code stages.  ``reached`` is what ``walked`` gives, where a caller has it.
    """
    # written once: every reason below reads a few columns of it
    reached = walked(estate.stages, estate.edges) if reached is None else reached
    seen = written(estate.stages.join(reached, [*PAGE, "stage_id"], "left_semi"), "walked")
    base = [*STAGE, "page_name", "name", "kind", "source_ref"]
    role = t.queue_action_class("action_name")
    kind, queue = F.col("kind"), uses_queues()
    rows = []

    def add(df: DataFrame, reason: str, text: Column, manual: bool = False) -> None:
        rows.append(df.select(*base, F.lit(reason).alias("reason"), text.alias("detail"), F.lit(manual).alias("manual")))

    # what a stage's own columns tell
    review, no_script = F.lit("Review the code that was carried over"), F.lit("JScript has no counterpart")
    own = [
        (queue & F.col("queue_name").isNull(), "dynamic-queue", F.lit("The queue is only known at run time"), False),
        (queue & (role == "other"), "queue-action", F.format_string('Queue action "%s" has no counterpart', "action_name"), False),
        ((kind == "wait") & (F.coalesce("timeout_seconds", F.lit(0.0)) <= 0), "no-timeout", F.lit("The wait had no timeout, a default was set"), False),
        ((kind == "alert") & t.is_sensitive_name(F.get("exprs", F.lit(0))["raw"]), "sensitive-alert", F.lit("The message names sensitive data"), False),
    ]
    if overrides is None:
        own.append(((kind == "code") & (F.col("language") != "jscript"), "code-review", review, False))
        own.append(((kind == "code") & (F.col("language") == "jscript"), "jscript", no_script, True))
    else:
        code = seen.where(kind == "code")
        accepted = overrides.where("accepted").select(*STAGE)
        taken = code.join(accepted, list(STAGE), "left_semi")
        add(taken, "translated-code", F.lit("Review the accepted translation"))
        add(taken.unionByName(code.where(F.col("language") != "jscript").join(accepted, list(STAGE), "left_anti")), "code-review", review)
        add(code.where(F.col("language") == "jscript").join(accepted, list(STAGE), "left_anti"), "jscript", no_script, True)
    items = F.transform("outputs", lambda o: F.struct(
        F.lit("queue-item").alias("reason"), F.format_string('Check the mapping of output "%s"', o["param_name"]).alias("detail"), F.lit(False).alias("manual"),
    ))
    none = F.array().cast("array<struct<reason:string,detail:string,manual:boolean>>")
    rows.append(_listed(seen, base, own, F.coalesce(F.when(queue & (role == "get_next"), items), none)))
    # what other rows tell
    fetching = seen.where(queue & (role == "get_next")).select(*PAGE).distinct()
    marks = seen.where(queue & role.isin("complete", "exception"))
    add(marks.join(fetching, list(PAGE), "left_anti"), "item-source", F.lit("The status needs the queue item of another page"))
    calls = graph.resolve_calls(seen, estate.owners, estate.pages)
    add(calls.where(~F.col("found") | (F.col("owner_type") == "object")), "unresolved-object", F.format_string('Action "%s" of object "%s" is not in the release', "action_name", "object_name"), True)
    steps = seen.where(kind.isin("read", "write", "navigate", "wait")).select(*base, F.explode("steps").alias("s")).where("s.element_id is not null")
    selectors = score_selectors(estate.elements).select(*OWNER, F.col("element_id").alias("eid"), "strategy", "confidence")
    on = steps.withColumn("eid", F.col("s.element_id")).join(selectors, [*OWNER, "eid"], "left")
    rows.append(_listed(on, base, [
        (F.col("strategy").isNull(), "missing-selector", F.format_string('Element "%s" is not in the application model', "eid"), False),
        (F.col("strategy") == "image-ocr", "image-only", F.format_string('Element "%s" can only be found by its image', "eid"), True),
        ((F.col("strategy") == "selector") & (F.col("confidence") < 0.5), "weak-selector", F.format_string('The selector of element "%s" has confidence %.2f', "eid", "confidence"), False),
        ((kind == "navigate") & ~F.lower("s.action").startswith("click"), "navigate-action", F.format_string('Action "%s" became a click', "s.action"), False),
    ]))
    heads = graph.cycles(seen, estate.edges).where("head = stage_id").select(*PAGE, "stage_id")
    absorbed = cut(graph.polling_loops(estate.stages, estate.edges))
    plain_cycles = seen.join(heads, [*PAGE, "stage_id"], "left_semi").join(absorbed, list(PAGE), "left_anti")
    add(plain_cycles, "cycle", F.lit("The flow leads back to this stage"), True)
    add(seen.join(absorbed.select(*PAGE, F.col("mark_id").alias("stage_id")), [*PAGE, "stage_id"], "left_semi"), "absorbed-loop", F.lit("The polling loop became the framework's loop, check the status"))
    ends = seen.where(kind == "loopEnd").select(*PAGE, "pair_id")
    add(seen.where(kind == "loopStart").join(ends, [*PAGE, "pair_id"], "left_anti"), "open-loop", F.lit("The loop has no end stage"))
    add(expression_calls(seen).where(~F.lower("function").isin(*FUNCTION_NAMES)), "unknown-function", F.format_string('Function "%s" has no counterpart', "function"))
    add(unmatched_arguments(estate, seen), "no-parameter", F.format_string('"%s" has no matching page parameter', "param"))
    return reduce(DataFrame.unionByName, rows)


def unmatched_arguments(estate: Estate, stages: DataFrame) -> DataFrame:
    """Inputs and outputs of page and object calls that the called page does not declare."""
    entry = estate.stages.where(F.col("kind").isin("start", "end")).select(
        "release_id", F.col("owner_id").alias("to_owner"), F.col("page_id").alias("to_page"),
        F.when(F.col("kind") == "start", "in").otherwise("out").alias("way"), F.explode("outputs.param_name").alias("param"),
    ).distinct()
    pages = stages.where(F.col("kind") == "subsheetRef").withColumn("to_owner", F.col("owner_id")).withColumn("to_page", F.col("target_page_id"))
    objects = graph.resolve_calls(stages.where(F.col("owner_type") == "process"), estate.owners, estate.pages).where("found")
    objects = objects.withColumn("to_owner", F.col("object_id")).withColumn("to_page", F.col("object_page_id")).drop("object_id", "object_page_id", "found")
    calls = pages.unionByName(objects)
    side = lambda way, col: F.transform(F.coalesce(F.col(col), F.array().cast("array<string>")), lambda p: F.struct(F.lit(way).alias("way"), p.alias("param")))
    used = calls.select("*", F.inline(F.concat(side("in", "inputs.param_name"), side("out", "outputs.param_name"))))
    return used.join(entry, ["release_id", "to_owner", "to_page", "way", "param"], "left_anti")


# --- labels and effort -------------------------------------------------------


# What each kind of stage turns into; kinds that need a closer look are told apart in target_code.
TARGET_OF_KIND = {
    "anchor": "nothing", "loopEnd": "nothing", "resume": "nothing", "recover": "catch block", "alert": "log line", "note": "annotation",
    "start": "inputs", "end": "outputs", "data": "variable", "collection": "variable", "calculation": "assignment", "multiCalc": "assignments",
    "decision": "two-way branch", "choice": "branch chain", "loopStart": "row loop", "wait": "element check", "write": "typing", "read": "reading",
    "navigate": "clicking", "subsheetRef": "page call", "action": "object call", "exception": "throw", "code": "code block", "generic": "by hand",
}
TARGET_OF_QUEUE_ROLE = {"get_next": "queue take", "add": "queue put", "complete": "queue success", "exception": "queue failure"}


def target_code() -> Column:
    """What a stage becomes on the target side, as a short code; null for an unknown kind."""
    kind = F.col("kind")
    lookup = lambda table, key, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), other)
    code = lookup(TARGET_OF_KIND, kind, F.lit(None).cast("string"))
    queue = (kind == "action") & uses_queues()
    business = F.contains(F.lower(F.coalesce("exception_type", F.lit(""))), F.lit("business"))
    return (
        F.when(queue, lookup(TARGET_OF_QUEUE_ROLE, F.coalesce(t.queue_action_class("action_name"), F.lit("")), F.lit("queue step")))
        .when((kind == "exception") & F.coalesce("preserve", F.lit(False)), "throw again").when((kind == "exception") & business, "throw for business")
        .when((kind == "code") & F.coalesce(F.col("language") == "jscript", F.lit(False)), "by hand").otherwise(code)
    )


def target_detail() -> Column:
    """What the target code is about: a variable, a count, a file or a name; null where the code says all."""
    kind, file = F.col("kind"), lambda *parts: F.concat(F.concat_ws("\\", *parts), F.lit(".xaml"))
    page = F.coalesce(F.nullif(F.col("target_page_name"), F.lit("")), F.col("name"))
    return (
        F.when(kind == "calculation", F.col("store_in")).when(kind == "loopStart", F.col("collection_name"))
        .when(kind.isin("multiCalc", "write", "read", "navigate"), F.coalesce(F.size("steps"), F.lit(0)).cast("string"))
        .when(kind == "choice", F.size("exprs").cast("string")).when(kind == "generic", F.col("raw_type"))
        .when(kind == "subsheetRef", file(F.lit("Pages"), t.sanitize_identifier(page)))
        .when((kind == "action") & ~uses_queues(), file(F.lit("Objects"), t.sanitize_identifier("object_name"), t.sanitize_identifier("action_name")))
        .when((kind == "action") & (t.queue_action_class("action_name") == "other"), F.col("action_name"))
    )


def target_label() -> Column:
    """Code and detail in one text."""
    return F.when(target_code().isNotNull(), F.concat_ws(": ", target_code(), target_detail()))


def stage_mapping(estate: Estate, punch: DataFrame) -> DataFrame:
    """Per stage: target, status (converted, review, manual) and confidence.

    Notes are reduced to two facts per page and stage name before the join.
    """
    notes = punch.groupBy(*OWNER, "page_name", "name").agg(F.count("*").alias("notes"), F.bool_or("manual").alias("any_manual"))
    selectors = score_selectors(estate.elements).select(*OWNER, F.col("element_id").alias("eid"), F.col("confidence").alias("selector_confidence"))
    status = (
        F.when((F.col("kind") == "generic") | F.coalesce("any_manual", F.lit(False)), "manual")
        .when(F.coalesce("notes", F.lit(0)) > 0, "review").otherwise("converted")
    )
    confidence = F.when(F.col("status") == "manual", 0.2).otherwise(
        F.coalesce("selector_confidence", F.when(F.col("status") == "review", 0.6).otherwise(0.95))
    )
    touched = F.when(F.col("kind").isin("read", "write", "navigate", "wait"), F.get("steps", F.lit(0))["element_id"])
    return (
        estate.stages.withColumn("eid", touched).join(notes, [*OWNER, "page_name", "name"], "left").join(selectors, [*OWNER, "eid"], "left")
        .withColumn("status", status)
        .select(*STAGE, "page_name", "name", "kind", target_label().alias("target"), "status", F.round(confidence, 2).alias("confidence"), F.coalesce("notes", F.lit(0)).alias("notes"))
    )


def effort_hours(estate: Estate, punch: DataFrame) -> DataFrame:
    """Planning hours of each process with the objects it calls; counts per owner first, then one join."""
    stages = estate.stages.groupBy(*OWNER).agg(F.count("*").alias("stages"))
    punched = punch.groupBy(*OWNER).agg(F.count("*").alias("punch"))
    risky = (F.col("strategy") == "image-ocr") | (F.col("confidence") < 0.5)
    selectors = score_selectors(estate.elements).groupBy(*OWNER).agg(F.count("*").alias("selectors"), F.count_if(risky).alias("risky"))
    work = estate.owners.select(*OWNER, "owner_type", "name")
    for part in (stages, punched, selectors):
        work = work.join(part, list(OWNER), "left")
    work = work.na.fill(0)
    called = estate.stages.where(
        (F.col("kind") == "action") & (F.col("owner_type") == "process") & F.col("queue_name").isNull()
    ).select(*OWNER, F.col("object_name").alias("name")).distinct()
    objects = work.where("owner_type = 'object'").select("release_id", "name", "stages", "punch", "selectors", "risky")
    own = work.where("owner_type = 'process'").select(*OWNER, "stages", "punch", F.lit(0).cast("long").alias("selectors"), F.lit(0).cast("long").alias("risky"))
    lent = called.join(objects, ["release_id", "name"]).select(*OWNER, "stages", "punch", "selectors", "risky")
    minutes = (
        F.sum("stages") * MINUTES_PER_STAGE + F.sum("punch") * MINUTES_PER_PUNCH
        + F.sum("selectors") * MINUTES_PER_SELECTOR + F.sum("risky") * MINUTES_PER_RISK
    )
    return own.unionByName(lent).groupBy(*OWNER).agg(
        F.sum("stages").alias("stages"), F.sum("punch").alias("punch"), F.sum("selectors").alias("selectors"), F.sum("risky").alias("risky"),
        (F.floor(minutes / 6 + 0.5) / 10).alias("effort_hours"),
    )
