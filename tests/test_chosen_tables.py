"""Tables with few columns parse few fields and show the same rows."""

import pytest
from pyspark.sql import Row

from procatlas.model import SCHEMAS
from procatlas.plans.rendered import RELEASE_XML, VALUES, render
from procatlas.sources import releases

ODD = """<process name="A" preferredid="p1"><subsheet subsheetid="m" type="MainPage"><name>Main Page</name></subsheet><subsheet subsheetid="n"><name>N</name></subsheet>
<stage stageid="s" name="Start" type="Start"><subsheetid>m</subsheetid><inputs><input name="N" type="odd" stage="D"/></inputs><onsuccess>c</onsuccess></stage>
<stage/><stage name="lone"><x>1</x></stage><stage stageid="c" name="Pick" type="ChoiceStart"><subsheetid>gone</subsheetid><choices><choice name="One" expression="[D] = 1"><onsuccess>s</onsuccess></choice></choices></stage>
<stage stageid="w" name="Wait" type="WaitStart"><timeout> 5 </timeout><choices><choice name="Seen"><element>e1</element><condition>c</condition><onsuccess>s</onsuccess></choice></choices><ontimeout>c</ontimeout></stage>
<stage stageid="call" type="SubSheet"><subsheetid>n</subsheetid><processid>m</processid><inputs><input name="Queue Name" expr="&quot;q&quot;"/></inputs><outputs><output name="O" stage="D"/></outputs></stage>
<stage stageid="d" name="D" type="Data"><subsheetid>m</subsheetid><datatype>strange</datatype><initialvalue>held</initialvalue><exposure>Session</exposure></stage>
<appdef><application name="App"/><element id="e1" name="E" mode="Odd"><attributes><attribute name="a" value="v"/></attributes></element></appdef></process>"""


@pytest.fixture(scope="module")
def files(spark):
    orders = spark.sql("SELECT k AS o_orderkey, k + 7 AS o_custkey, DATE'2024-01-02' AS o_orderdate, s AS o_orderstatus, '1-URGENT' AS o_orderpriority FROM VALUES (30, 'P'), (91, 'O'), (91, 'O') v(k, s)")
    content = [r[0] for r in orders.select(render(RELEASE_XML, VALUES)).collect()]
    wrapped = f'<bpr:release><bpr:contents><object id="o" name="Obj">{ODD}</object><process id="none" name="Gone"/></bpr:contents></bpr:release>'
    content += [ODD, wrapped, '<process name="Bare"><stage stageid="a" type="End"/></process>', "<bpr:release><broken", "<process><broken", "<other/>", None]
    rows = [(None if c is None else f"f{len(c)}", f"{i}.xml", 1, c) for i, c in enumerate(content)]
    return spark.createDataFrame(rows, "release_id string, file string, size_bytes bigint, content string").coalesce(1).cache()


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def whole(files):
    return {name: [df.columns, df.collect()] for name, df in releases.normalize(files).tables().items()}


@pytest.mark.parametrize("name", [n for n in SCHEMAS if n != "credentials"])
def test_some_columns(spark, files, whole, name):
    """Read for a few columns at a time, directly; the parser is asked for no field that they are not made from."""
    columns, rows = whole[name]
    assert rows
    turns = {"stages": 4, "data_items": 2, "edges": 2}.get(name, 1)
    for wanted in ({name: columns[i::turns]} for i in range(turns)):
        at = [columns.index(c) for c in wanted[name]]
        found = releases.chosen_tables(files, wanted).tables()[name]
        assert found.columns == wanted[name] and shown(found) == sorted(str(Row(**{columns[i]: r[i] for i in at})) for r in rows), wanted
    assert len(releases.fields_for({name: columns[:2]})) < 10


@pytest.mark.parametrize("name", ["owners", "pages", "stages", "edges", "data_items", "params", "elements", "work_queues", "env_vars"])
def test_a_table_parses_a_file_once(files, name):
    """Spark doubles the parser where it moves an expression: once for releases, once for bare processes is all there may be."""
    columns = SCHEMAS[name].split(" ")[0:1]
    plan = releases.chosen_tables(files, {name: columns}).tables()[name]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") <= 2


def test_written_once_for_several(spark, files, whole, tmp_path):
    wanted = {"stages": ["release_id", "name", "inputs"], "edges": ["release_id", "src", "dst", "edge_pos"], "params": ["name", "direction"], "env_vars": ["name", "value"], "owners": ["name", "application_name"], "credentials": ["name"]}
    heads = releases.heads_chosen(files, wanted)
    heads.write.parquet(str(tmp_path / "heads"))
    made = releases.written_tables(spark, str(tmp_path / "heads"), heads.schema, wanted)
    for name, columns in wanted.items():
        at = [whole[name][0].index(c) for c in columns]
        assert shown(made.tables()[name]) == sorted(str(Row(**{c: r[i] for c, i in zip(columns, at)})) for r in whole[name][1])
    assert made.data_items is None and releases.needed({"env_vars": ["name"], "work_queues": ["name"]}) is None
    text = made.stages._jdf.queryExecution().analyzed().toString()
    assert "initialvalue" not in heads.schema.simpleString() and "onsuccess" in heads.schema.simpleString() and "ontimeout:string" not in text.split("Relation")[0]
