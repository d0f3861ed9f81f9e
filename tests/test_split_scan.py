"""Releases read by component over small splits against whole files."""

import random

import pytest
from test_releases import CLEAN, FAULTY, release, stage

from procatlas.sources import releases, split_scan

TRICKY = release(
    [
        stage("c", "Code", '<code language="x"><![CDATA[if (a > b) { "</process></bpr:release><process>" } ]] > ]]></code>'),
        stage("q", "Calculation", "<calculation expression='[A] > \"x>y\"' stage=\"a > 'b'\"/>"),
        "<!-- a comment with </process> and > and <object> -->", "<?note with > and <process ?>",
        stage("n", "Note", "<narrative>ä 😀 &lt;object&gt; text > more</narrative>"),
    ],
    extra='<work-queue id="q" name="Q > R"><keyfield>K</keyfield></work-queue><environment-variable name="E"><datatype>flag</datatype><value>a > b</value></environment-variable>',
    objects='<object id="O1" name="One"/><object id="O2" name="Two"><process name="Two"><subsheet subsheetid="z" type="Normal"><name>Z</name></subsheet></process></object>'
    + '<process id="P2" name="Second"><process name="Second" bpversion="9"></process></process>',
)
BARE = '<?xml version="1.0"?><process name="Alone" bpversion="5"><subsheet subsheetid="p1" type="MainPage"><name>Main</name></subsheet>' + stage("s", "Start") + "</process>"
EMPTY = '<bpr:release xmlns:bpr="urn:x"><bpr:name>x</bpr:name></bpr:release>'
FOREIGN = "<html><body><process>no</process><br/></body></html>"
LONG = release([stage(f"s{i}", "Calculation", f'<calculation expression="{i} > 1" stage="x"/>') for i in range(300)])
TABLES = ("owners", "pages", "stages", "edges", "data_items", "params", "elements", "work_queues", "env_vars")


def rows_of(df, *without):
    kept = [c for c in df.columns if c not in without]
    return sorted(str([r[c] for c in kept]) for r in df.collect())


def whole(spark, contents):
    data = [(f"F{i}", f"f{i}.xml", len(c.encode()), c) for i, c in enumerate(contents)]
    return releases.normalize(spark.createDataFrame(data, "release_id string, file string, size_bytes long, content string"))


def split(spark, folder, texts, size):
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"f{i}.xml").write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return split_scan.normalize_path(spark, str(folder), most=1000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [601, 1 << 20])
def test_same_tables(spark, tmp_path, size):
    """Several exports in each file, cut anywhere: inside tags, quotes, comments and character data."""
    exports = [CLEAN, TRICKY, FAULTY, BARE, LONG, EMPTY, TRICKY, FOREIGN]
    ours = split(spark, tmp_path / "in", ["\n".join([CLEAN, TRICKY, FAULTY, BARE]), LONG + EMPTY + "\n\n" + TRICKY + FOREIGN + "\n"], size)
    theirs = whole(spark, exports)
    for name in TABLES:
        assert rows_of(getattr(ours, name), "release_id") == rows_of(getattr(theirs, name), "release_id"), name
    assert rows_of(ours.issues, "release_id") == rows_of(theirs.issues, "release_id")
    shown = ("package_name", "bp_version", "export_date")
    assert rows_of(ours.releases.select(*shown)) == rows_of(theirs.releases.select(*shown))
    assert ours.releases.select("release_id").distinct().count() == len(exports)


def test_broken_files(spark, tmp_path):
    """One error row for a file that does not balance, and for an export with a broken component; others are read."""
    bad_part = TRICKY.replace('<object id="O2" name="Two">', '<object id="O2" name="Two"><process name=Two></process>')
    texts = [CLEAN + CLEAN[: len(CLEAN) // 2], "</a>" + CLEAN, CLEAN + "<!-- never closed", "no tags", bad_part + CLEAN, CLEAN]
    e = split(spark, tmp_path / "in", texts, 301)
    by_file = {r["file"].rsplit("/", 1)[-1]: r["n"] for r in e.releases.join(e.owners, "release_id").groupBy("file").agg({"owner_id": "count"}).withColumnRenamed("count(owner_id)", "n").collect()}
    assert by_file == {"f4.xml": 1, "f5.xml": 1}
    issues = sorted((r["file"].rsplit("/", 1)[-1], r["message"]) for r in e.issues.filter("level = 'error'").join(e.releases, "release_id").collect())
    broken, foreign = "The XML is not well-formed", "The root element is neither a release nor a process"
    assert issues == [("f0.xml", broken), ("f1.xml", broken), ("f2.xml", broken), ("f3.xml", foreign), ("f4.xml", broken)]


def test_summaries_compose():
    """Any cutting at brackets gives the same depth and counts as one pass."""
    rng = random.Random(3)
    text = "\n".join([TRICKY, BARE, LONG, FOREIGN])
    plain = split_scan.Summary()
    plain.feed(*split_scan.tokens(text, split_scan.TEXT))
    ends = [i + 1 for i, ch in enumerate(text) if ch == ">"]
    for _ in range(30):
        cuts = sorted({0, *rng.sample(ends, 12), len(text)})
        total = split_scan.Summary()
        for a, b in zip(cuts, cuts[1:]):
            part = split_scan.Summary(total.state)
            part.feed(*split_scan.tokens(text[a:b], total.state))
            total = total.then(part)
        assert (total.state, total.depth, total.low, total.starts) == (plain.state, plain.depth, plain.low, plain.starts)
