"""Manual work listed in one pass, from a walk that a caller may hand in."""

from __future__ import annotations

import pytest

from procatlas.operators import conversion
from procatlas.sources.releases import normalize

XML = """<process name="A"><subsheet subsheetid="m" type="MainPage"><name>Main Page</name></subsheet>
<stage stageid="s" name="Start" type="Start"><subsheetid>m</subsheetid><onsuccess>get</onsuccess></stage>
<stage stageid="get" name="Fetch" type="Action"><subsheetid>m</subsheetid><resource object="Work Queues" action="Get Next Item"/>
<inputs><input name="Queue Name" expr="[Queue]"/></inputs><outputs><output name="Data" stage="D"/><output name="Id" stage="I"/></outputs><onsuccess>odd</onsuccess></stage>
<stage stageid="odd" name="Odd" type="Action"><subsheetid>m</subsheetid><resource object="Work Queues" action="Defer"/><inputs><input name="Queue Name" expr="&quot;Q&quot;"/></inputs><onsuccess>wait</onsuccess></stage>
<stage stageid="wait" name="Wait" type="WaitStart"><subsheetid>m</subsheetid><timeout>0</timeout><choices><choice name="Seen"><element>e1</element><condition>x</condition><onsuccess>code</onsuccess></choice></choices></stage>
<stage stageid="code" name="Script" type="Code"><subsheetid>m</subsheetid><code language="jscript">1</code><onsuccess>more</onsuccess></stage>
<stage stageid="more" name="More" type="Code"><subsheetid>m</subsheetid><code language="csharp">2</code><onsuccess>nav</onsuccess></stage>
<stage stageid="nav" name="Press" type="Navigate"><subsheetid>m</subsheetid><steps><step element="e2" action="Hover"/></steps></stage>
<stage stageid="off" name="Never" type="Code"><subsheetid>m</subsheetid><code language="jscript">3</code></stage></process>"""
EXPECTED = sorted([
    ("get", "dynamic-queue", "The queue is only known at run time", False), ("get", "queue-item", 'Check the mapping of output "Data"', False),
    ("get", "queue-item", 'Check the mapping of output "Id"', False), ("odd", "queue-action", 'Queue action "Defer" has no counterpart', False),
    ("wait", "no-timeout", "The wait had no timeout, a default was set", False), ("wait", "missing-selector", 'Element "e1" is not in the application model', False),
    ("code", "jscript", "JScript has no counterpart", True), ("more", "code-review", "Review the code that was carried over", False),
    ("nav", "missing-selector", 'Element "e2" is not in the application model', False), ("nav", "navigate-action", 'Action "Hover" became a click', False),
])


@pytest.fixture(scope="module")
def estate(spark):
    return normalize(spark.createDataFrame([("a.xml", 1, XML)], "file string, size_bytes long, content string"))


def _rows(punch):
    return sorted((r["stage_id"], r["reason"], r["detail"], r["manual"]) for r in punch.collect())


def test_reasons_of_a_page(estate):
    assert _rows(conversion.punch_list(estate)) == EXPECTED


def test_a_walk_that_is_handed_in_is_not_made_again(estate, monkeypatch):
    reached = conversion.walked(estate.stages, estate.edges).cache()
    whole = conversion.owner_coverage(conversion.convertible_stages(estate)).collect()
    monkeypatch.setattr(conversion, "walked", lambda *_: pytest.fail("walked again"))
    assert _rows(conversion.punch_list(estate, reached=reached)) == EXPECTED
    assert conversion.owner_coverage(conversion.convertible_stages(estate, reached)).collect() == whole


def test_reasons_of_one_kind_share_a_pass(estate, monkeypatch):
    """Each branch of the list reads the walked stages anew; it took 18 branches."""
    branches, plain = [], conversion.reduce
    monkeypatch.setattr(conversion, "reduce", lambda step, parts: (branches.append(len(parts)), plain(step, parts))[1])
    conversion.punch_list(estate)
    assert branches[-1] <= 12
