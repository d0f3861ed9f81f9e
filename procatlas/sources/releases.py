"""XML releases → normalised tables.

A file is parsed once into one row per component (process or object).  That
frame is written, and every table is derived from it without a join: page
look-ups happen inside a component's row, and positions come from the arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from procatlas.functions.text import source_hash
from procatlas.model import SCHEMAS, Estate, conform
from procatlas.session import shared_dir
from procatlas.sources.files import root_element

# Element and attribute names of the export format.
_INPUT = "struct<_name:string,_type:string,_expr:string,_stage:string>"
_CALC = "struct<_expression:string,_stage:string>"
_STEP = "struct<_element:string,_action:string,_expr:string,_stage:string>"
_CHOICE = "struct<_name:string,_expression:string,onsuccess:string,element:array<string>,condition:array<string>>"
_STAGE_FIELDS = {
    **dict.fromkeys(("_stageid", "_name", "_type", "subsheetid", "onsuccess", "ontrue", "onfalse", "ontimeout"), "string"),
    "inputs": f"struct<input:array<{_INPUT}>>", "outputs": f"struct<output:array<{_INPUT}>>", "calculation": f"array<{_CALC}>",
    "steps": f"struct<calculation:array<{_CALC}>,step:array<{_STEP}>>", "decision": "struct<_expression:string>",
    "alert": "struct<_expression:string>", "exception": "struct<_type:string,_detail:string,_usecurrent:string>",
    "choices": f"struct<choice:array<{_CHOICE}>>", "resource": "struct<_object:string,_action:string>",
    **dict.fromkeys(("processid", "loopdata", "groupid", "timeout", "datatype", "initialvalue", "exposure"), "string"),
    "collectioninfo": "struct<field:array<struct<_name:string,_type:string>>>", "code": "struct<_language:string,_VALUE:string>", "narrative": "string",
}


def _stage(*fields: str) -> str:
    """The type of a stage that is read with only the given fields."""
    return f"struct<{','.join(f'{name}:{ddl}' for name, ddl in _STAGE_FIELDS.items() if name in fields)}>"


_STAGE = _stage(*_STAGE_FIELDS)
_ELEMENT = (
    "struct<_id:string,_name:string,_mode:string,attributes:struct<attribute:array<"
    "struct<_name:string,_value:string,_matchtype:string,_enabled:string>>>>"
)
_QUEUE = "struct<_id:string,_name:string,keyfield:string,maxattempts:string,encrypted:string>"
_VARIABLE = "struct<_name:string,datatype:string,value:string,description:string>"
_SUBSHEETS = "array<struct<_subsheetid:string,_type:string,name:string>>"


def definition(**parts: str) -> str:
    """The type of a component that is read with only the given ``stage`` and ``appdef`` types; its pages and texts always are."""
    heads = "_name:string,_version:string,_bpversion:string,_narrative:string,_preferredid:string"
    return f"struct<{','.join([heads, f'subsheet:{_SUBSHEETS}', *[f'{name}:{ddl}' for name, ddl in parts.items()]])}>"


DEFINITION = definition(stage=f"array<{_STAGE}>", appdef=f"struct<application:struct<_name:string>,element:array<{_ELEMENT}>>")


def _wrapper(of: str = DEFINITION) -> str:
    return f"struct<_id:string,_name:string,process:array<{of}>>"


def _release(of: str | None = DEFINITION) -> str:
    components = "" if of is None else f"process:array<{_wrapper(of)}>,object:array<{_wrapper(of)}>,"
    return (
        f"`bpr:name` string, `bpr:created` string, `bpr:package-name` string, `bpr:contents` struct<{components}"
        f"`work-queue`:array<{_QUEUE}>,`environment-variable`:array<{_VARIABLE}>>, _corrupt_record string"
    )


def _bare(of: str = DEFINITION) -> str:
    return of.removeprefix("struct<").removesuffix(">") + ",_corrupt_record:string"


_WRAPPER, RELEASE, _BARE = _wrapper(), _release(), _bare()
# What the tables that need no whole stages read of a component. Parsing costs by the fields that are asked for.
READ_FOR = {
    "pages": definition(),
    "params": definition(stage=f"array<struct<_type:string,subsheetid:string,inputs:struct<input:array<{_INPUT}>>,outputs:struct<output:array<{_INPUT}>>>>"),
    "elements": definition(appdef=f"struct<element:array<{_ELEMENT}>>"),
}
STAGE_IDS = definition(stage="array<struct<_stageid:string>>")
# What every row of a table of stages is made from, of the fields of a stage, and under the names of columns what these need beside it.
_CALL = ("_type", "resource")
_LINKS = ("_type", "onsuccess", "ontrue", "onfalse", "ontimeout", "choices")
_PLACE = dict.fromkeys(("page_id", "page_name", "page_index"), ("subsheetid",))
MADE_FROM = {
    "stages": (
        ("_stageid",),
        {
            **_PLACE, "name": ("_name",), "kind": ("_type",), "raw_type": ("_type",), "object_name": _CALL, "action_name": _CALL, "queue_name": (*_CALL, "inputs"),
            "store_in": ("_type", "calculation"), "collection_name": ("_type", "loopdata"), "pair_id": ("_type", "groupid"), "data_item_id": ("_type",),
            "target_page_id": ("_type", "processid"), "target_page_name": ("_type", "processid"), "timeout_seconds": ("_type", "timeout"),
            "exception_type": ("_type", "exception"), "preserve": ("_type", "exception"), "language": ("_type", "code"), "body": ("_type", "code"), "text": ("_type", "narrative"),
            "exprs": ("_type", "calculation", "decision", "alert", "steps", "choices", "inputs", "exception"), "inputs": ("_type", "inputs"),
            "outputs": ("_type", "inputs", "outputs"), "steps": ("_type", "steps", "choices"),
        },
    ),
    "edges": (_LINKS, {**_PLACE, "src": ("_stageid",)}),
    "data_items": (
        ("_type",),
        {
            **_PLACE, "item_id": ("_stageid",), "stage_id": ("_stageid",), "name": ("_name",), "data_type": ("datatype",), "initial_value": ("initialvalue",),
            "exposure": ("exposure",), "fields": ("collectioninfo",),
        },
    ),
    "params": (("_type", "subsheetid", "inputs", "outputs"), {}),
    "issues": (("_name", "_type", "subsheetid", "processid", "datatype", "resource", "inputs", "collectioninfo"), {}),
}
_OF_ELEMENTS, _OF_APPLICATION = f"element:array<{_ELEMENT}>", "application:struct<_name:string>"
# What tables of stages and of links read of a stage that was written: Parquet leaves the other fields where they are.
FIELDS_OF = {
    "edges": ("_stageid", "_type", "subsheetid", "processid", "onsuccess", "ontrue", "onfalse", "ontimeout", "choices"),
    "stages": (
        "_stageid", "_name", "_type", "subsheetid", "inputs", "outputs", "calculation", "steps", "decision", "alert", "exception", "choices",
        "resource", "processid", "loopdata", "groupid", "timeout", "code", "narrative",
    ),
}

# Source stage types and the kinds they become.
KINDS = {
    "Start": "start", "End": "end", "Anchor": "anchor", "Recover": "recover", "Resume": "resume", "Note": "note",
    "Alert": "alert", "Calculation": "calculation", "MultipleCalculation": "multiCalc", "Decision": "decision",
    "ChoiceStart": "choice", "ChoiceEnd": "anchor", "Data": "data", "Collection": "collection",
    "LoopStart": "loopStart", "LoopEnd": "loopEnd", "Action": "action", "SubSheet": "subsheetRef",
    "Exception": "exception", "Read": "read", "Write": "write", "Navigate": "navigate", "WaitStart": "wait",
    "WaitEnd": "anchor", "Code": "code",
}
DATA_TYPES = ("text", "number", "flag", "date", "datetime", "time", "timespan", "password", "image", "binary", "collection")
APP_MODES = ("Win32", "HTML", "Java", "UIA", "SAP", "Citrix", "Region")
MATCH_TYPES = ("exact", "wildcard", "regex", "index", "dynamic")
EXPOSURES = ("environment", "session", "statistic")
QUEUE_OBJECT = "Work Queues"
CONTENTS = "/bpr:release/bpr:contents"


def _s(col: Column | str) -> Column:
    """Text, with nothing for what is absent."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _some(col: Column) -> Column:
    """Null for empty text."""
    return F.nullif(_s(col), F.lit(""))


def _list(col: Column, like: str) -> Column:
    return F.coalesce(col, F.array().cast(f"array<{like}>"))


def data_type(raw: Column) -> Column:
    """A known type in lower case, else text."""
    lower = F.lower(_s(raw))
    return F.when(lower.isin(*DATA_TYPES), lower).otherwise("text")


def _unknown_type(raw: Column) -> Column:
    return (_s(raw) != "") & ~F.lower(_s(raw)).isin(*DATA_TYPES)


def parse(files: DataFrame, of: str | None = DEFINITION) -> DataFrame:
    """(release_id, file, size_bytes, source_hash, root, rel, bare) per (file, size_bytes, content).

    Broken XML never fails the job: the row keeps its root and both documents are null.
    A given ``release_id`` column is kept, else file and content make one. ``of`` is the
    ``definition`` components are read with, without one they are left out, and so is a file that is nothing but one;
    every release is read to its end all the same.
    """
    root = root_element(F.col("content"))
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    if "release_id" not in files.columns:
        files = files.withColumn("release_id", F.sha2(F.concat_ws("\n", "file", "content"), 256))
    parsed = (
        files.withColumn("source_hash", source_hash("content"))
        .withColumn("root", root)
        .withColumn("rel", F.when(F.col("root") == "bpr:release", F.from_xml("content", _release(of), opts)))
    )
    if of is not None:
        parsed = parsed.withColumn("bare", F.when(F.col("root") == "process", F.from_xml("content", f"struct<{_bare(of)}>", opts)))
    return parsed.drop("content")


def _wrapped(items: Column, kind: str, of: str = DEFINITION) -> Column:
    tag = "process" if kind == "process" else "object"
    return F.transform(
        _list(items, _wrapper(of)),
        lambda w, i: F.struct(
            F.lit(kind).alias("owner_type"), F.lit(0 if kind == "process" else 1).alias("owner_rank"), i.cast("int").alias("owner_pos"),
            _s(w["_id"]).alias("wrapper_id"), _s(w["_name"]).alias("wrapper_name"),
            F.concat(F.lit(f"{CONTENTS}/{tag}["), (i + 1).cast("string"), F.lit("]/process")).alias("base_path"),
            F.get(w["process"], F.lit(0)).alias("def"),
        ),
    )


def bare_part(of: str = DEFINITION) -> Column:
    """The process of a parsed file that is nothing but one."""
    names = StructType.fromDDL(_bare(of)).fieldNames()[:-1]
    return F.struct(
        F.lit("process").alias("owner_type"), F.lit(0).alias("owner_rank"), F.lit(0).alias("owner_pos"),
        F.coalesce(_some(F.col("bare._preferredid")), F.concat(F.lit("process-"), F.coalesce(_some(F.col("bare._name")), F.lit("1")))).alias("wrapper_id"),
        _s("bare._name").alias("wrapper_name"), F.lit("/process").alias("base_path"),
        F.struct(*[F.col(f"bare.{n}").alias(n) for n in names]).alias("def"),
    )


def _parts(of: str = DEFINITION) -> Column:
    """The processes and objects of a parsed file, in order."""
    ok_rel, ok_bare = F.col("rel._corrupt_record").isNull(), F.col("bare._corrupt_record").isNull()
    contents = F.col("rel.`bpr:contents`")
    return F.when(
        F.col("rel").isNotNull() & ok_rel, F.concat(_wrapped(contents["process"], "process", of), _wrapped(contents["object"], "object", of))
    ).when(F.col("bare").isNotNull() & ok_bare, F.array(bare_part(of)))


def split_components(parsed: DataFrame, of: str = DEFINITION) -> DataFrame:
    """One row per process or object of a file, with its position and path in the file; ``of`` is what ``parse`` was given."""
    return parsed.select("release_id", F.explode(_parts(of)).alias("c")).select("release_id", "c.*")


def with_pages(rows: DataFrame) -> DataFrame:
    """Components with ``pages``: main page first, one made up when none is declared."""
    declared = F.transform(
        _list(F.col("def.subsheet"), "struct<_subsheetid:string,_type:string,name:string>"),
        lambda p, i: F.struct(
            _s(p["_subsheetid"]).alias("page_id"), _s(p["name"]).alias("name"), (_s(p["_type"]) == "MainPage").alias("is_main"),
            F.concat(F.col("base_path"), F.lit("/subsheet["), (i + 1).cast("string"), F.lit("]")).alias("source_ref"),
        ),
    )
    name = F.coalesce(_some(F.col("def._name")), F.col("wrapper_name"))
    made = F.struct(
        F.concat(_s("def._name"), F.lit("-main")).alias("page_id"), F.lit("Main Page").alias("name"), F.lit(True).alias("is_main"),
        F.col("base_path").alias("source_ref"),
    )
    sorted_pages = F.concat(F.filter("declared", lambda p: p["is_main"]), F.filter("declared", lambda p: ~p["is_main"]))
    return rows.withColumn("name", name).withColumn("declared", declared).withColumn(
        "pages", F.when(F.size("declared") == 0, F.array(made)).otherwise(sorted_pages)
    ).drop("declared")


def _located(comp: DataFrame) -> DataFrame:
    """One row per stage: its raw form, its page, and the page its call names; a field that was not read is null."""
    read = comp.schema["def"].dataType["stage"].dataType.elementType.names
    given = lambda stage, name: stage[name] if name in read else F.lit(None).cast(_STAGE_FIELDS[name])
    pages = F.transform("pages", lambda p, i: F.struct(p["page_id"].alias("page_id"), p["name"].alias("name"), i.cast("int").alias("page_index")))
    find = lambda pid: F.try_element_at(F.filter(F.col("pg"), lambda p: p["page_id"] == pid), F.lit(-1))
    placed = F.transform(
        F.col("def.stage"),
        lambda s: F.struct(s.alias("raw"), find(_s(given(s, "subsheetid"))).alias("page"), find(_s(given(s, "processid"))).alias("target")),
    )
    first = F.get("pg", F.lit(0))
    return (
        comp.withColumn("pg", pages)
        .select("release_id", "owner_type", "owner_rank", "owner_pos", F.col("wrapper_id").alias("owner_id"), "base_path", first.alias("main"), F.posexplode(placed).alias("stage_pos", "at"))
        .select(
            "release_id", "owner_type", "owner_rank", "owner_pos", "owner_id", "base_path", "main", "stage_pos",
            (F.col("at.raw") if set(read) >= set(_STAGE_FIELDS) else F.struct(*[given(F.col("at.raw"), n).alias(n) for n in _STAGE_FIELDS])).alias("raw"), F.col("at.target").alias("target"), F.col("at.page").isNull().alias("stray"),
            F.coalesce("at.page", "main").alias("page"),
            F.concat(F.col("base_path"), F.lit("/stage["), (F.col("stage_pos") + 1).cast("string"), F.lit("]")).alias("source_ref"),
        )
        .withColumn("kind", _kind(F.col("raw._type")))
    )


def _kind(raw_type: Column) -> Column:
    out = None
    for source, kind in KINDS.items():
        out = F.when(raw_type == source, kind) if out is None else out.when(raw_type == source, kind)
    return out.otherwise("generic")


def _inputs(raw: str = "raw") -> Column:
    return F.transform(_list(F.col(f"{raw}.inputs.input"), _INPUT), lambda i: F.struct(_s(i["_name"]).alias("param_name"), _s(i["_expr"]).alias("raw")))


def _stores(col: str) -> Column:
    return F.transform(_list(F.col(col), _INPUT), lambda i: F.struct(_s(i["_name"]).alias("param_name"), _s(i["_stage"]).alias("store_in")))


def _queue_literal() -> Column:
    arg = F.get(F.filter(_inputs(), lambda i: i["param_name"] == "Queue Name"), F.lit(0))["raw"]
    return F.when(arg.rlike(r'^"(.*)"$'), F.regexp_extract(arg, r'^"(.*)"$', 1))


def stages_of(located: DataFrame) -> DataFrame:
    kind = F.col("kind")
    expr = lambda raw, name=None, role="expression": F.struct(F.lit(role).alias("role"), (F.lit(None).cast("string") if name is None else name).alias("name"), _s(raw).alias("raw"))
    call = kind.isin("action", "subsheetRef", "code")
    inputs, choices = _inputs(), _list(F.col("raw.choices.choice"), _CHOICE)
    calcs, steps = _list(F.col("raw.steps.calculation"), _CALC), _list(F.col("raw.steps.step"), _STEP)
    first_calc = F.get("raw.calculation", F.lit(0))
    exprs = (
        F.when(kind == "calculation", F.array(expr(first_calc["_expression"])))
        .when(kind == "decision", F.array(expr(F.col("raw.decision._expression"))))
        .when(kind == "alert", F.array(expr(F.col("raw.alert._expression"))))
        .when(kind == "multiCalc", F.transform(calcs, lambda c: expr(c["_expression"], c["_stage"], "step")))
        .when(kind == "choice", F.transform(choices, lambda c: expr(c["_expression"], _s(c["_name"]), "choice")))
        .when(call, F.transform(inputs, lambda i: expr(i["raw"], i["param_name"], "input")))
        .when(kind == "write", F.transform(steps, lambda s: expr(s["_expr"], s["_element"], "value")))
        .when((kind == "exception") & (_s("raw.exception._detail") != ""), F.array(expr(F.col("raw.exception._detail"))))
    )
    bound = F.filter(
        F.when(kind == "start", _stores("raw.inputs.input")).when(kind == "end", _stores("raw.outputs.output")), lambda b: b["store_in"] != ""
    )
    step = lambda e, a, st, r: F.struct(e.alias("element_id"), a.alias("action"), st.alias("store_in"), r.alias("raw"))
    none = F.lit(None).cast("string")
    all_steps = (
        F.when(kind == "read", F.transform(steps, lambda s: step(_s(s["_element"]), _some(s["_action"]), _s(s["_stage"]), none)))
        .when(kind == "write", F.transform(steps, lambda s: step(_s(s["_element"]), none, none, _s(s["_expr"]))))
        .when(kind == "navigate", F.transform(steps, lambda s: step(_s(s["_element"]), _s(s["_action"]), none, none)))
        .when(kind == "multiCalc", F.transform(calcs, lambda c: step(none, none, _s(c["_stage"]), _s(c["_expression"]))))
        .when(kind == "wait", F.transform(choices, lambda c: step(_some(F.get(c["element"], F.lit(0))), _some(F.get(c["condition"], F.lit(0))), none, none)))
    )
    only = lambda k, col: F.when(kind == k, col)
    language = F.lower(_s("raw.code._language"))
    known = F.col("target").isNotNull()
    queue = (kind == "action") & (_s("raw.resource._object") == QUEUE_OBJECT)
    return located.select(
        "release_id", "owner_id", "owner_type", "owner_rank", "owner_pos", F.col("page.page_id").alias("page_id"),
        F.col("page.name").alias("page_name"), F.col("page.page_index").alias("page_index"), _s("raw._stageid").alias("stage_id"),
        _s("raw._name").alias("name"), "kind", F.col("stage_pos").cast("int").alias("stage_pos"),
        only("action", _s("raw.resource._object")).alias("object_name"), only("action", _s("raw.resource._action")).alias("action_name"),
        F.when(queue, _queue_literal()).alias("queue_name"), only("calculation", _s(first_calc["_stage"])).alias("store_in"),
        only("loopStart", _s("raw.loopdata")).alias("collection_name"),
        F.when(kind.isin("loopStart", "loopEnd"), _s("raw.groupid")).alias("pair_id"),
        F.when(kind.isin("data", "collection"), _s("raw._stageid")).alias("data_item_id"),
        F.when((kind == "subsheetRef") & known & (_s("raw.processid") != ""), F.col("raw.processid")).alias("target_page_id"),
        only("subsheetRef", _s("target.name")).alias("target_page_name"),
        only("wait", F.expr("try_cast(nullif(trim(raw.timeout), '') AS double)")).alias("timeout_seconds"),
        only("exception", _some(F.col("raw.exception._type"))).alias("exception_type"),
        only("exception", F.lower(_s("raw.exception._usecurrent")) == "true").alias("preserve"),
        only("code", F.when(language.isin("csharp", "jscript"), language).otherwise("vbnet")).alias("language"),
        only("code", _s("raw.code._VALUE")).alias("body"), only("note", _s("raw.narrative")).alias("text"),
        only("generic", _s("raw._type")).alias("raw_type"), exprs.alias("exprs"), F.when(call, inputs).alias("inputs"),
        F.when(call, _stores("raw.outputs.output")).otherwise(bound).alias("outputs"), all_steps.alias("steps"), "source_ref",
    )


def edges_of(located: DataFrame) -> DataFrame:
    """Links out of a stage in written order; empty targets are dropped."""
    link = lambda to, kind, label=None: F.struct(_s(to).alias("dst"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if label is None else label).alias("label"))
    own = F.array(
        link(F.col("raw.onsuccess"), "flow"), link(F.col("raw.ontrue"), "true"), link(F.col("raw.onfalse"), "false"),
        link(F.col("raw.ontimeout"), "choice", F.lit("Time Out")),
    )
    branches = F.when(
        F.col("kind").isin("choice", "wait"),
        F.transform(_list(F.col("raw.choices.choice"), _CHOICE), lambda c: link(c["onsuccess"], "choice", _s(c["_name"]))),
    ).otherwise(F.slice(own, 1, 0))
    rows = located.select(
        "release_id", "owner_id", F.col("page.page_id").alias("page_id"), "stage_pos", _s("raw._stageid").alias("src"),
        F.posexplode(F.filter(F.concat(own, branches), lambda e: e["dst"] != "")).alias("i", "e"),
    )
    return rows.select(
        "release_id", "owner_id", "page_id", "src", "e.*", (F.shiftleft(F.col("stage_pos").cast("long"), 31) + F.col("i")).alias("edge_pos")
    )


def data_items_of(located: DataFrame) -> DataFrame:
    exposure = F.lower(_s("raw.exposure"))
    fields = F.transform(
        _list(F.col("raw.collectioninfo.field"), "struct<_name:string,_type:string>"),
        lambda f: F.struct(_s(f["_name"]).alias("name"), data_type(f["_type"]).alias("data_type")),
    )
    plain = F.col("kind") == "data"
    return located.where(F.col("kind").isin("data", "collection")).select(
        "release_id", "owner_id", "owner_type", _s("raw._stageid").alias("item_id"), _s("raw._name").alias("name"),
        F.when(plain, data_type(F.col("raw.datatype"))).otherwise("collection").alias("data_type"),
        F.when(plain, _some(F.col("raw.initialvalue"))).alias("initial_value"),
        F.when(plain & exposure.isin(*EXPOSURES), exposure).alias("exposure"), F.when(~plain, fields).alias("fields"),
        F.col("page.page_id").alias("page_id"), _s("raw._stageid").alias("stage_id"), F.col("stage_pos").alias("item_pos"), "source_ref",
    )


def params_of(comp: DataFrame) -> DataFrame:
    """Parameters of a process: from the first Start and first End written on the main page."""
    main = F.get("pages", F.lit(0))["page_id"]
    first = lambda kind: F.get(F.filter("def.stage", lambda s: (s["_type"] == kind) & (_s(s["subsheetid"]) == main)), F.lit(0))
    entry = lambda items, way: F.transform(_list(items, _INPUT), lambda p, i: F.struct(_s(p["_name"]).alias("name"), data_type(p["_type"]).alias("data_type"), F.lit(way).alias("direction"), i.cast("int").alias("param_pos")))
    both = F.concat(entry(first("Start")["inputs"]["input"], "in"), entry(first("End")["outputs"]["output"], "out"))
    return comp.where("owner_type = 'process'").select("release_id", F.col("wrapper_id").alias("owner_id"), F.inline(both))


def pages_of(comp: DataFrame) -> DataFrame:
    rows = comp.select("release_id", F.col("wrapper_id").alias("owner_id"), "owner_type", F.posexplode("pages").alias("page_index", "p"))
    return rows.select("release_id", "owner_id", "owner_type", F.col("p.page_id").alias("page_id"), F.col("p.name").alias("name"), "page_index", F.col("p.source_ref").alias("source_ref"))


def elements_of(comp: DataFrame) -> DataFrame:
    attributes = lambda e: F.transform(
        _list(e["attributes"]["attribute"], "struct<_name:string,_value:string,_matchtype:string,_enabled:string>"),
        lambda a: F.struct(
            _s(a["_name"]).alias("name"), _s(a["_value"]).alias("value"),
            F.when(F.lower(_s(a["_matchtype"])).isin(*MATCH_TYPES), F.lower(a["_matchtype"])).otherwise("exact").alias("match_type"),
            (_s(a["_enabled"]) != "false").alias("enabled"),
        ),
    )
    rows = comp.where("owner_type = 'object'").select(
        "release_id", F.col("wrapper_id").alias("owner_id"), "base_path", F.posexplode("def.appdef.element").alias("element_pos", "e")
    )
    return rows.select(
        "release_id", "owner_id", _s("e._id").alias("element_id"), _s("e._name").alias("name"),
        F.when(_s("e._mode").isin(*APP_MODES), F.col("e._mode")).otherwise("Win32").alias("mode"),
        attributes(F.col("e")).alias("attributes"), F.col("element_pos").cast("int").alias("element_pos"),
        F.concat(F.col("base_path"), F.lit("/appdef/element["), (F.col("element_pos") + 1).cast("string"), F.lit("]")).alias("source_ref"),
        (~_s("e._mode").isin(*APP_MODES)).alias("odd_mode"), _s("e._mode").alias("raw_mode"),
    )


def _issue(rows: DataFrame, level: str, message: Column, path: Column | str) -> DataFrame:
    return rows.select("release_id", F.lit(level).alias("level"), message.alias("message"), (F.col(path) if isinstance(path, str) else path).alias("path"))


def issues_of(heads: DataFrame, comp: DataFrame, located: DataFrame, elements: DataFrame, variables: DataFrame) -> DataFrame:
    """Everything that was tolerated (warning) or could not be read (error)."""
    none = F.lit(None).cast("string")
    broken = F.col("broken")
    foreign = ~F.col("root").isin("bpr:release", "process")
    hollow = (F.col("root") == "bpr:release") & ~F.col("has_contents")
    top = F.when(foreign, "The root element is neither a release nor a process").when(broken, "The XML is not well-formed").when(hollow, "The release has no contents")
    quote = lambda fmt, *cols: F.format_string(fmt, *cols)
    undefined = comp.where("def is null")
    pageless = comp.where(F.col("def").isNotNull() & (F.size(F.coalesce("def.subsheet", F.array().cast("array<struct<_subsheetid:string,_type:string,name:string>>"))) == 0))
    kind = F.col("kind")
    queue = (kind == "action") & (_s("raw.resource._object") == QUEUE_OBJECT) & _queue_literal().isNull()
    odd_fields = F.filter(F.transform(_list(F.col("raw.collectioninfo.field"), "struct<_name:string,_type:string>"), lambda f: _s(f["_type"])), _unknown_type)
    checks = F.filter(
        F.concat(
            F.array(
                F.when(F.col("stray"), quote('Stage "%s" names the unknown page "%s" and was put on "%s"', _s("raw._name"), _s("raw.subsheetid"), F.col("main.name"))),
                F.when(kind == "generic", quote('Unknown stage type "%s" of stage "%s"', _s("raw._type"), _s("raw._name"))),
                F.when((kind == "data") & _unknown_type(F.col("raw.datatype")), quote('Unknown data type "%s", read as text', _s("raw.datatype"))),
                F.when(queue, quote('Queue action "%s" has no literal queue name', _s("raw._name"))),
                F.when((kind == "subsheetRef") & F.col("target").isNull(), quote('Page call "%s" names the unknown page "%s"', _s("raw._name"), _s("raw.processid"))),
            ),
            F.when(kind == "collection", F.transform(odd_fields, lambda f: quote('Unknown data type "%s", read as text', f))).otherwise(F.array().cast("array<string>")),
        ),
        lambda m: m.isNotNull(),
    )
    per_stage = located.select("release_id", F.explode(checks).alias("m"), "source_ref")
    parts = [
        _issue(heads.where(top.isNotNull()), "error", top, none),
        _issue(undefined, "error", quote('The %s "%s" has no definition', F.col("owner_type"), F.col("wrapper_name")), "base_path"),
        _issue(pageless, "warning", quote('"%s" declares no pages, a main page was made', _s("def._name")), "base_path"),
        _issue(per_stage, "warning", F.col("m"), "source_ref"),
        _issue(elements.where("odd_mode"), "warning", quote('Unknown element mode "%s", read as Win32', F.col("raw_mode")), "source_ref"),
        _issue(variables.where("odd_type"), "warning", quote('Unknown data type "%s", read as text', F.col("raw_type")), "source_ref"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _heads(parsed: DataFrame, of: str = DEFINITION) -> DataFrame:
    """What a file says about itself, with its components as they were parsed."""
    contents = F.col("rel.`bpr:contents`")
    return parsed.select(
        "release_id", "file", "size_bytes", "source_hash", "root",
        (F.col("rel._corrupt_record").isNotNull() | F.col("bare._corrupt_record").isNotNull()).alias("broken"),
        F.coalesce("rel.`bpr:package-name`", "bare._name").alias("package_name"), F.col("rel.`bpr:created`").alias("created"),
        F.coalesce(F.get(F.filter(F.transform(_parts(of), lambda p: p["def"]["_bpversion"]), lambda v: _s(v) != ""), F.lit(0)), F.lit("")).alias("bp_version"),
        contents.isNotNull().alias("has_contents"), contents["work-queue"].alias("queues"), contents["environment-variable"].alias("variables"),
        _parts(of).alias("parts"),
    )


def releases_of(heads: DataFrame) -> DataFrame:
    return heads.select("release_id", "file", _s("package_name").alias("package_name"), "bp_version", _some(F.col("created")).alias("export_date"), "source_hash", "size_bytes")


def owners_of(comp: DataFrame) -> DataFrame:
    known = "appdef" in comp.schema["def"].dataType.names and "application" in comp.schema["def"].dataType["appdef"].dataType.names
    return comp.select(
        "release_id", F.col("wrapper_id").alias("owner_id"), "owner_type", "name", _some(F.col("def._narrative")).alias("description"),
        _some(F.col("def.appdef.application._name") if known else F.lit(None).cast("string")).alias("application_name"), "owner_rank", "owner_pos", F.col("base_path").alias("source_ref"),
    )


def queues_of(heads: DataFrame) -> DataFrame:
    rows = heads.select("release_id", F.posexplode(_list(F.col("queues"), _QUEUE)).alias("queue_pos", "q"))
    return rows.select(
        "release_id", _some(F.col("q._id")).alias("queue_id"), _s("q._name").alias("name"), _some(F.col("q.keyfield")).alias("key_field"),
        F.expr("try_cast(try_cast(nullif(q.maxattempts, '') AS double) AS int)").alias("max_attempts"),
        F.when(_s("q.encrypted") != "", F.col("q.encrypted") == "true").alias("encrypted"), F.col("queue_pos").cast("int").alias("queue_pos"),
    )


def variables_of(heads: DataFrame) -> DataFrame:
    rows = heads.select("release_id", F.posexplode(_list(F.col("variables"), _VARIABLE)).alias("var_pos", "v"))
    return rows.select(
        "release_id", _s("v._name").alias("name"), data_type(F.col("v.datatype")).alias("data_type"), _some(F.col("v.value")).alias("value"),
        _some(F.col("v.description")).alias("description"), F.col("var_pos").cast("int").alias("var_pos"),
        _unknown_type(F.col("v.datatype")).alias("odd_type"), _s("v.datatype").alias("raw_type"),
        F.concat(F.lit(f"{CONTENTS}/environment-variable["), (F.col("var_pos") + 1).cast("string"), F.lit("]")).alias("source_ref"),
    )


def normalize(files: DataFrame, of: str = DEFINITION) -> Estate:
    """All tables of the given (file, size_bytes, content) rows.

    The XML is parsed once; the parsed rows are written, and the tables read only
    the columns they need from there. Parsing costs by the fields asked for: a caller that shows few of them
    gives their ``definition``, and what follows from other fields is as if those were absent.
    """
    heads = heads_of(files, of)
    path = f"{shared_dir(files.sparkSession).rstrip('/')}/parsed-{uuid.uuid4().hex}"
    heads.write.parquet(path)
    return tables_of(files.sparkSession.read.schema(heads_of(files).schema).parquet(path))


def heads_of(files: DataFrame, of: str = DEFINITION) -> DataFrame:
    """The parsed files, one row each."""
    return _heads(parse(files, of), of)


def tables_of(heads: DataFrame) -> Estate:
    """All tables of parsed files that were written."""
    return estate_of(heads.sparkSession, heads, heads.select("release_id", F.explode("parts").alias("c")).select("release_id", "c.*"))


def _with_only(heads: StructType, fields: Sequence[str]) -> StructType:
    """The schema of written heads with the components alone, and of these no more of a stage than the given fields."""
    part = heads["parts"].dataType.elementType
    of = part["def"].dataType
    stage = StructType([f for f in of["stage"].dataType.elementType if f.name in fields])
    kept = StructType([StructField(f.name, ArrayType(stage) if f.name == "stage" else f.dataType) for f in of if f.name != "appdef"])
    parts = StructType([StructField(f.name, kept if f.name == "def" else f.dataType) for f in part])
    return StructType([heads["release_id"], StructField("parts", ArrayType(parts))])


def read_table(heads: DataFrame, path: str, name: str) -> DataFrame:
    """The stages or the edges of the parsed files ``heads`` that were written to ``path``; only the fields they show are read."""
    narrow = heads.sparkSession.read.schema(_with_only(heads.schema, FIELDS_OF[name])).parquet(path)
    rows = with_pages(narrow.select("release_id", F.explode("parts").alias("c")).select("release_id", "c.*")).where("def is not null")
    made = {"edges": edges_of, "stages": stages_of}[name](_located(rows))
    return conform(made, heads.sparkSession.createDataFrame([], SCHEMAS[name]))


def direct_tables(files: DataFrame) -> Estate:
    """The tables of files, for a reader of a single one: nothing is written, and each table in ``READ_FOR`` parses no more than it shows."""
    heads = heads_of(files)
    estate = tables_of(heads)
    made = {"pages": pages_of, "params": params_of, "elements": elements_of}
    parts = {name: split_components(parse(files, of), of) for name, of in READ_FOR.items()}
    tables = {name: made[name](with_pages(rows).where("def is not null")) for name, rows in parts.items()}
    return replace(estate, **{name: conform(df, getattr(estate, name)) for name, df in tables.items()})


def fields_for(columns: Mapping[str, Sequence[str]]) -> tuple[str, ...]:
    """The fields of a stage that the given columns of tables are made from, in their order."""
    used = {field for name, wanted in columns.items() if name in MADE_FROM for field in (*MADE_FROM[name][0], *[f for c in wanted for f in MADE_FROM[name][1].get(c, ())])}
    return tuple(f for f in _STAGE_FIELDS if f in used)


def needed(columns: Mapping[str, Sequence[str]]) -> str | None:
    """The ``definition`` that shows the given columns of tables by name; None where none of them tells of components."""
    if not set(columns) - {"work_queues", "env_vars", "credentials"}:
        return None
    stage, parts = fields_for(columns), {}
    if stage:
        parts["stage"] = f"array<{_stage(*stage)}>"
    app = [ddl for ddl, asked in ((_OF_APPLICATION, "application_name" in columns.get("owners", ())), (_OF_ELEMENTS, "elements" in columns or "issues" in columns)) if asked]
    if app:
        parts["appdef"] = f"struct<{','.join(app)}>"
    return definition(**parts)


def _table(name: str, heads: DataFrame, rows: DataFrame | None) -> DataFrame:
    """One table of parsed files and their components, whichever fields these were read with."""
    if name in (of_heads := {"releases": releases_of, "work_queues": queues_of, "env_vars": variables_of}):
        return of_heads[name](heads)
    comp = with_pages(rows)
    defined = comp.where("def is not null")
    if name in (of_components := {"owners": owners_of, "pages": pages_of, "params": params_of, "elements": elements_of}):
        return of_components[name](defined)
    located = _located(defined)
    if name == "issues":
        return issues_of(heads, comp, located, elements_of(defined), variables_of(heads))
    return {"stages": stages_of, "edges": edges_of, "data_items": data_items_of}[name](located)


def _only(spark: SparkSession, columns: Mapping[str, Sequence[str]], table) -> Estate:
    """The given columns of the tables that ``table`` makes; the other tables are None."""
    made = dict.fromkeys(SCHEMAS)
    for name, wanted in columns.items():
        empty = spark.createDataFrame([], SCHEMAS[name])
        made[name] = (empty if name == "credentials" else conform(table(name, wanted), empty)).select(*wanted)
    return Estate(**made)


def chosen_tables(files: DataFrame, columns: Mapping[str, Sequence[str]]) -> Estate:
    """The given columns of tables of files, for readers that read a table once: each parses no more than it shows, and nothing is written."""

    def table(name: str, wanted: Sequence[str]) -> DataFrame:
        of = needed({name: wanted})
        # components come from ``parse`` itself: an array that is a column of its own is filtered by its size first, which would parse again
        return _table(name, heads_chosen(files, {name: wanted}), of and split_components(parse(files, of), of))

    return _only(files.sparkSession, columns, table)


def written_tables(spark: SparkSession, path: str, schema: StructType, columns: Mapping[str, Sequence[str]]) -> Estate:
    """The given columns of tables of files that ``heads_chosen`` has parsed for them and that were written to ``path``; a table reads only the fields it shows."""

    def table(name: str, wanted: Sequence[str]) -> DataFrame:
        narrow = name in ("stages", "edges", "data_items", "params")
        heads = spark.read.schema(_with_only(schema, fields_for({name: wanted})) if narrow else schema).parquet(path)
        rows = heads.select("release_id", F.explode("parts").alias("c")).select("release_id", "c.*") if "parts" in heads.columns else None
        return _table(name, heads, rows)

    return _only(spark, columns, table)


def heads_chosen(files: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """The parsed files with no more than the given columns of tables are made from."""
    of = needed(columns)
    if of is not None:
        return heads_of(files, of)
    contents = F.col("rel.`bpr:contents`")
    return parse(files, None).select("release_id", contents["work-queue"].alias("queues"), contents["environment-variable"].alias("variables"))


def estate_of(spark: SparkSession, heads: DataFrame, rows: DataFrame) -> Estate:
    """All tables, from what the exports say about themselves and their components."""
    comp = with_pages(rows)
    defined = comp.where("def is not null")
    located = _located(defined)
    elements, variables = elements_of(defined), variables_of(heads)
    return Estate.of(
        spark,
        releases=releases_of(heads),
        owners=owners_of(defined), pages=pages_of(defined), stages=stages_of(located), edges=edges_of(located), data_items=data_items_of(located),
        params=params_of(defined), elements=elements, work_queues=queues_of(heads), env_vars=variables,
        issues=issues_of(heads, comp, located, elements, variables),
    )
