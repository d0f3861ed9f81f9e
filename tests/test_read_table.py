"""Stages and edges read from written releases with only the fields they show."""

from __future__ import annotations

import pytest

from procatlas.sources import releases

XML = """<process name="A"><subsheet subsheetid="m" type="MainPage"><name>Main Page</name></subsheet>
<stage stageid="s" name="Start" type="Start"><subsheetid>m</subsheetid><inputs><input name="N" type="text" stage="D"/></inputs><onsuccess>c</onsuccess></stage>
<stage stageid="c" name="Pick" type="ChoiceStart"><subsheetid>gone</subsheetid><choices><choice name="One" expression="[D] = 1"><onsuccess>s</onsuccess></choice></choices><onsuccess>w</onsuccess></stage>
<stage stageid="w" name="Wait" type="WaitStart"><subsheetid>m</subsheetid><timeout>5</timeout><choices><choice name="Seen"><element>e1</element><onsuccess>s</onsuccess></choice></choices><ontimeout>c</ontimeout></stage>
<stage stageid="d" name="D" type="Data"><subsheetid>m</subsheetid><datatype>text</datatype><initialvalue>held</initialvalue></stage></process>"""


@pytest.mark.parametrize("name", ["stages", "edges"])
def test_same_rows_from_fewer_fields(spark, tmp_path, name):
    files = spark.createDataFrame([("F", "a.xml", 1, XML), ("F", "a.xml", 1, XML), ("G", "b.xml", 1, "<broken")], "release_id string, file string, size_bytes long, content string")
    path = str(tmp_path / "heads")
    releases.heads_of(files).write.parquet(path)
    heads = spark.read.parquet(path)
    whole, narrow = releases.tables_of(heads).tables()[name], releases.read_table(heads, path, name)
    assert narrow.schema == whole.schema
    assert sorted(map(str, narrow.collect())) == sorted(map(str, whole.collect())) != []
    assert "initialvalue" not in narrow._jdf.queryExecution().analyzed().toString() and "initialvalue" in heads.schema.simpleString()
