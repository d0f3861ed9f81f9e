"""Normalisation and findings of small hand-written exports."""

import json

import pytest

from procatlas.model import located_owner
from procatlas.operators.engine import RuleConfig, build_ruleset, define_rule, order_findings, run_rules
from procatlas.operators.rules import ALL_RULES
from procatlas.operators.validate import validate_model
from procatlas.sources import bots, releases


def files(spark, *contents):
    return spark.createDataFrame([(f"F{i}", f"f{i}.xml", len(c), c) for i, c in enumerate(contents)], "release_id string, file string, size_bytes long, content string")


def stage(sid, kind, inner="", page="p1", name=None):
    return f'<stage stageid="{sid}" name="{name or sid}" type="{kind}"><subsheetid>{page}</subsheetid>{inner}</stage>'


def release(stages, extra="", narrative="what it does", objects=""):
    return (
        '<bpr:release xmlns:bpr="urn:x"><bpr:contents><process id="P" name="Proc"><process name="Proc" bpversion="7" narrative="' + narrative + '">'
        '<subsheet subsheetid="p1" type="MainPage"><name>Main</name></subsheet><subsheet subsheetid="p2" type="Normal"><name>Sub</name></subsheet>'
        + "".join(stages) + f"</process></process>{objects}{extra}</bpr:contents></bpr:release>"
    )


go = lambda to: f"<onsuccess>{to}</onsuccess>"
CLEAN = release([
    stage("s", "Start", go("call")), stage("call", "SubSheet", "<processid>p2</processid>" + go("e")), stage("e", "End"),
    stage("s2", "Start", go("set"), "p2"), stage("set", "Calculation", '<calculation expression="[Item] + 1" stage="Item"/>' + go("e2"), "p2"), stage("e2", "End", "", "p2"),
    stage("r", "Recover", go("res"), "p2"), stage("res", "Resume", go("e2"), "p2"), stage("d", "Data", "<datatype>number</datatype>", "p1", "Item"),
])
FAULTY = release([
    stage("s", "Start", '<inputs><input name="Password" type="text" stage="Item"/></inputs>' + go("a")), stage("a", "Anchor", go("b")), stage("b", "Anchor", go("a")),
    stage("dead", "Calculation", '<calculation expression="1" stage="Item"/>'), stage("al", "Alert", '<alert expression="[Customer SSN]"/>'),
    stage("act", "Action", '<resource object="X" action="Y"/><inputs><input name="Token" expr="&quot;abcdefg1&quot;"/></inputs>'),
    stage("d", "Data", "<datatype>text</datatype><initialvalue>https://host/x</initialvalue>", "p1", "Never used"),
    stage("self", "Anchor", go("self")),
], narrative="")


def rules_found(estate):
    findings, errors = run_rules(estate, ALL_RULES)
    assert errors.count() == 0
    return sorted((r.rule_id, r.location.page_id, r.location.stage_id) for r in order_findings(findings).collect())


def test_clean_release_has_no_findings(spark):
    e = releases.normalize(files(spark, CLEAN))
    assert rules_found(e) == []
    assert e.issues.count() == 0 and validate_model(e).count() == 0


def test_faulty_release(spark):
    e = releases.normalize(files(spark, FAULTY))
    assert rules_found(e) == [
        ("CMP-002", None, None), ("MNT-001", "p1", "act"), ("MNT-001", "p1", "al"), ("MNT-001", "p1", "dead"), ("MNT-001", "p1", "self"), ("MNT-001", "p2", None),
        ("MNT-002", "p1", "d"), ("REL-001", None, None), ("REL-002", "p1", "a"), ("REL-002", "p1", "self"), ("SEC-001", "p1", "act"), ("SEC-002", None, None),
        ("SEC-003", "p1", "al"), ("SEC-004", "p1", "d"),
    ]


def test_broken_foreign_and_bare_files(spark):
    bare = '<process name="Solo" preferredid="solo-1"><subsheet subsheetid="m" type="MainPage"><name>M</name></subsheet></process>'
    e = releases.normalize(files(spark, "<bpr:release><oops>", "<html></html>", bare, '<bpr:release xmlns:bpr="urn:x"></bpr:release>'))
    issues = {r.release_id: (r.level, r.message) for r in e.issues.collect()}
    assert issues["F0"] == ("error", "The XML is not well-formed")
    assert issues["F1"] == ("error", "The root element is neither a release nor a process")
    assert issues["F3"] == ("error", "The release has no contents")
    assert [(r.owner_id, r.name) for r in e.owners.collect()] == [("solo-1", "Solo")]


def test_tables_read_alone_agree_with_all_tables(spark):
    """Pages, parameters and elements parsed on their own are those of the whole parse, on odd and broken files too."""
    start = stage("s", "Start", '<inputs><input name="In" type="Number" stage="X"/><input type="odd"/></inputs><odd><deep a="1">x</deep>text</odd><onsuccess>e</onsuccess>')
    end = stage("e", "End", '<outputs><output name="Out" stage="X"/></outputs>')
    code = stage("c", "Code", '<code language="CSharp"><![CDATA[a < b </stage>]]></code><choices><choice><element>1</element><element>2</element></choice>words</choices>', "p2")
    appdef = '<appdef><application name="A"/><element id="e1" name="N" mode="HTML"><attributes><attribute name="Id" value="a &amp; b" enabled="false"/></attributes></element><ELEMENT id="e2" mode="None"/></appdef>'
    objects = f'<object id="O" name="Obj"><process name="Obj">{stage("x", "Read")}{appdef}</process></object><object id="H" name="Hollow"/><object id="E"><process/></object>'
    whole = release([start, end, code, '<Stage stageid="t" type="End"/>', "<stage/>", "<stage>words</stage>"], objects=objects)
    bare = f'<process name="Bare" preferredid="B">{start}{stage("q", "Start", page="p9")}{appdef}</process>'
    texts = [whole, bare, '<process name="None"/>', whole[:-20], whole.replace('type="Number"', "type=Number"), whole.replace("</appdef>", "<a></b></appdef>"), "<html><p>no</p></html>", "", "<bpr:release/>"]
    rows = files(spark, *texts)
    alone, together = releases.direct_tables(rows), releases.normalize(rows)
    for name in ("pages", "params", "elements"):
        found, wanted = (getattr(e, name) for e in (alone, together))
        assert found.schema.simpleString() == wanted.schema.simpleString()
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) != []
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "_initialvalue" not in plan and "initialvalue" not in plan and "narrative:" not in plan
    size = lambda of: sorted(map(tuple, releases.split_components(releases.parse(rows, of), of).selectExpr("release_id", "owner_type", "wrapper_name", "base_path", "size(def.stage) AS n").collect()), key=str)
    assert size(releases.STAGE_IDS) == size(releases.DEFINITION) != []


def test_structural_checks(spark):
    bad = release([
        stage("s", "Start", go("missing")), stage("s", "Anchor"), stage("l", "LoopStart", "<groupid>g</groupid>"), stage("self", "Anchor", go("self")),
    ])
    issues = sorted(r.issue for r in validate_model(releases.normalize(files(spark, bad))).collect())
    assert issues == ["duplicate-stage", "loop-pair", "unknown-stage"]


def test_rule_runner(spark):
    with pytest.raises(ValueError):
        define_rule("bad", "t", "low", "security", "d")
    with pytest.raises(ValueError):
        build_ruleset([ALL_RULES[0], ALL_RULES[0]])
    e = releases.normalize(files(spark, FAULTY))
    config = RuleConfig(disabled=frozenset(r.meta.id for r in ALL_RULES if not r.meta.id.startswith("SEC")), severity_overrides={"SEC-002": "low"})
    findings, _ = run_rules(e, ALL_RULES, config)
    assert {r.rule_id: r.severity for r in findings.collect()} == {"SEC-001": "critical", "SEC-002": "low", "SEC-003": "high", "SEC-004": "medium"}
    assert {r[0] for r in findings.select(located_owner()).collect()} == {"P"}


def node(uid, command, **more):
    return {"uid": uid, "command": command, **more}


def test_bot_with_nested_tries_and_empty_branches(spark):
    bot = {"name": "B", "nodes": [
        node("t", "try", children=[node("t2", "try", children=[node("a", "comment")]), node("b", "comment")]),
        node("c", "catch", children=[node("x", "log")]),
        node("i", "if", children=[]), node("l", "loop", children=[]), node("off", "comment", disabled=True), node("e", "else"),
    ]}
    e = bots.normalize(files(spark, json.dumps(bot), "not json", "[]"))
    edges = {(r.src, r.dst, r.kind) for r in e.edges.collect()}
    assert edges == {
        ("aa-start", "a", "flow"), ("a", "b", "flow"), ("b", "i", "flow"), ("i", "i-join", "true"), ("i", "i-join", "false"), ("i-join", "l", "flow"),
        ("l", "l-end", "flow"), ("l-end", "e", "flow"), ("e", "aa-end", "flow"), ("aa-recover", "x", "flow"), ("x", "aa-resume", "flow"), ("aa-resume", "aa-end", "flow"),
    }
    order = [r.stage_id for r in e.stages.orderBy("stage_pos").collect()]
    assert order == ["aa-start", "a", "b", "i", "i-join", "l", "l-end", "e", "aa-end", "aa-recover", "x", "aa-resume"]
    assert sorted((r.release_id, r.level) for r in e.issues.collect()) == [("F0", "warning"), ("F1", "error"), ("F2", "error")]


def test_bots_leave_no_checkpoints(spark, monkeypatch):
    """Rows of nodes are written as compressed tables; a checkpoint would hold every node in full, several times."""
    import json

    from pyspark.sql import DataFrame

    from procatlas.sources import bots

    def refuse(*args, **kwargs):
        raise AssertionError("a checkpoint")

    monkeypatch.setattr(DataFrame, "checkpoint", refuse)
    node = {"command": "log", "attributes": [{"name": "message", "value": {"string": "x"}}]}
    bot = {"name": "B", "nodes": [{"command": "try", "children": [{"command": "try", "children": [node]}], "branches": [{"label": "catch", "children": [node]}]}, node]}
    files = spark.createDataFrame([("b", "b.bot", 1, json.dumps(bot)), ("n", "n.bot", 1, '{"nodes": []}')], "release_id string, file string, size_bytes long, content string")
    e = bots.normalize(files)
    stages = [r.stage_id for r in e.stages.where("release_id = 'b'").orderBy("stage_pos").collect()]
    assert stages == ["aa-start", "aa-0.0.0", "aa-1", "aa-end", "aa-recover", f"aa-0.{bots.CATCH}", "aa-resume"]
    assert [r.stage_id for r in e.stages.where("release_id = 'n'").orderBy("stage_pos").collect()] == ["aa-start", "aa-end"]
