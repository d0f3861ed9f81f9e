"""A caller that shows few fields parses no others."""

from pyspark.sql import functions as F

from procatlas.plans.rendered import RELEASE_XML, VALUES, render
from procatlas.sources import releases

PLAIN = '<process name="Alone" preferredid="p1"><stage stageid="a" name="A" type="Start"/><stage stageid="b" name="B" type="End"/></process>'


def test_few_fields(spark, monkeypatch):
    order = spark.sql("SELECT 30 AS o_orderkey, 7 AS o_custkey, DATE'2024-01-02' AS o_orderdate, 'P' AS o_orderstatus, '1-URGENT' AS o_orderpriority")
    content = [order.select(render(RELEASE_XML, VALUES)).first()[0], PLAIN, "<bpr:release><broken", "<other/>", None]
    files = spark.createDataFrame([(f"f{i}", f"{i}.xml", 1, c) for i, c in enumerate(content)], "release_id string, file string, size_bytes bigint, content string")
    whole, few = releases.normalize(files), releases.normalize(files, releases.STAGE_IDS)
    shown = {
        "stages": ("release_id", "owner_id", "owner_type", "stage_id", "stage_pos", "source_ref"), "owners": ("release_id", "owner_id", "owner_type", "name", "description", "owner_rank", "owner_pos", "source_ref"),
        "pages": tuple(whole.pages.columns), "releases": tuple(whole.releases.columns), "work_queues": tuple(whole.work_queues.columns), "env_vars": tuple(whole.env_vars.columns),
    }
    for name, columns in shown.items():
        a, b = (sorted(map(str, e.tables()[name].select(*columns).collect())) for e in (whole, few))
        assert a and a == b, name
    errors = lambda e: sorted(map(str, e.issues.where("level = 'error'").collect()))
    assert errors(whole) == errors(few)
    path = few.stages.inputFiles()[0].rsplit("/", 1)[0]
    stage = spark.read.parquet(path).select(F.explode("parts").alias("p")).select(F.explode("p.def.stage").alias("s")).select("s.*")
    assert stage.columns == ["_stageid"] and stage.count() == 36


def test_the_intake_asks_for_what_it_shows(spark, monkeypatch, tmp_path):
    from procatlas.streaming import flows

    asked, parse = [], releases.parse
    monkeypatch.setattr(releases, "parse", lambda files, of=releases.DEFINITION: asked.append((files.isStreaming, of)) or parse(files, of))
    spark.createDataFrame([("0.xml", 1, PLAIN)], "file string, size_bytes bigint, content string").write.parquet(f"{tmp_path}/in")
    landed, counts = spark.readStream.schema("file string, size_bytes bigint, content string").parquet(f"{tmp_path}/in"), []
    flows.run_intake(landed, lambda e, rejected: counts.append((e.stages.count(), rejected.count())), f"{tmp_path}/checkpoint", of=releases.STAGE_IDS)
    assert counts == [(2, 0)] and (False, releases.STAGE_IDS) in asked
