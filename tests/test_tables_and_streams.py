import datetime as dt

import pytest
from pyspark.sql import functions as F

from procatlas.operators import score, tables
from procatlas.streaming import flows


def test_upsert_keeps_id_and_status(spark):
    columns = "id string, program_id string, source_hash string, score int, status string"
    target = spark.createDataFrame([("1", "g", "h1", 50, "deployed"), ("2", "g", "h2", 60, None)], columns)
    source = spark.createDataFrame([("9", "g", "h1", 70, "analyzed"), ("8", "g", "h3", 80, "analyzed"), ("7", "g", "h2", 65, "analyzed")], columns)
    got = sorted(tuple(r) for r in tables.upsert_processes(target, source).collect())
    assert got == [("1", "g", "h1", 70, "deployed"), ("2", "g", "h2", 65, None), ("8", "g", "h3", 80, "analyzed")]


def test_gates(spark):
    parts = spark.createDataFrame([("f", "a", "A"), ("f", "e", "E"), ("g", "f", "F")], "file string, name string, grade string")
    totals = spark.createDataFrame([("f", 2), ("g", 0)], "file string, n_critical long")
    assert {r.detail.split('"')[1] for r in score.evaluate_gates(parts, totals, "d").collect()} == {"e", "f"}
    assert {r.detail.split('"')[1] for r in score.evaluate_gates(parts, totals, "d", compat=True).collect()} == {"f"}
    assert [r.file for r in score.evaluate_gates(parts, totals, max_critical=1).collect()] == ["f"]
    with pytest.raises(ValueError):
        score.evaluate_gates(parts, totals, "E", compat=True)


def test_artifacts_need_the_switch_and_the_signature(spark):
    members = spark.createDataFrame([("w1", "u", "editor"), ("w2", "u", "editor"), ("w3", "u", "viewer")], "workspace_id string, user_id string, role string")
    spaces = spark.createDataFrame([("w1", True), ("w2", False), ("w3", True)], "id string, artifact_storage_enabled boolean")
    rows = spark.createDataFrame([("a", "w1", "u"), ("b", "w1", "x"), ("c", "w2", "u"), ("d", "w3", "u"), ("e", "w9", "u")], "id string, workspace_id string, uploaded_by string")
    none = spark.createDataFrame([], "id string, workspace_id string, program_id string")
    allowed = tables.writable_rows(rows, "artifacts", "insert", "u", members, none, none, spaces)
    assert [r.id for r in allowed.collect()] == ["a"]


def _events(spark, path, rows):
    made = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    made.coalesce(1).write.mode("append").parquet(path)


def test_status_stream_keeps_state_between_batches(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    landing, base = str(tmp_path / "in"), str(tmp_path / "out")
    _events(spark, landing, [(1, at(1), 7, "a", 0.0, ""), (3, at(3), 7, "b", 0.0, ""), (2, at(2), 7, "a", 0.0, "")])
    run = lambda: flows.drain(flows.stream_status_changes(flows.read_events(spark, landing, "*.parquet"), "user_id"), path=base)
    assert [(r.event_id, r.from_status, r.to_status) for r in run().collect()] == [(3, "a", "b")]
    _events(spark, landing, [(4, at(4), 7, "b", 0.0, ""), (5, at(5), 7, "c", 0.0, "")])
    assert sorted((r.event_id, r.from_status, r.to_status) for r in run().collect()) == [(3, "a", "b"), (5, "b", "c")]


def test_dedup_stream_across_batches(spark, tmp_path):
    landing, base = str(tmp_path / "in"), str(tmp_path / "out")
    day = dt.datetime(2024, 1, 1)
    run = lambda: flows.drain(flows.stream_dedup(flows.read_events(spark, landing, "*.parquet"), ["user_id"]), path=base)
    _events(spark, landing, [(1, day, 7, "a", 0.0, ""), (2, day, 8, "a", 0.0, "")])
    run()
    _events(spark, landing, [(3, day, 7, "b", 0.0, ""), (4, day, 9, "b", 0.0, "")])
    assert sorted(r.user_id for r in run().collect()) == [7, 8, 9]


def test_intake_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text('<process name="Solo"><subsheet subsheetid="m" type="MainPage"><name>M</name></subsheet></process>')
    (tmp_path / "in" / "b.txt").write_text("hello")
    seen = []

    def sink(estate, rejected):
        seen.extend(r.name for r in estate.owners.collect())
        seen.extend(r.reason for r in rejected.collect())

    flows.stream_intake(spark, str(tmp_path / "in"), sink, str(tmp_path / "check"))
    assert sorted(seen) == ['"b.txt" is not an export file', "Solo"]


def test_mean_is_rounded_half_up(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "C")], "score int, grade string")
    got = rows.agg(score.average_score().alias("s"), score.worst_grade().alias("g")).first()
    assert tuple(got) == (2, "C")
    assert rows.where(F.lit(False)).agg(score.worst_grade().alias("g")).first().g == "—"


def test_large_files_are_gated_without_their_content(spark, tmp_path):
    from procatlas.sources.files import intake_gate, read_files, split_accepted

    (tmp_path / "ok.xml").write_text('<process name="a"/>')
    (tmp_path / "big.xml").write_text('<process name="b"/>' + " " * 100)
    accepted, rejected = split_accepted(intake_gate(read_files(spark, str(tmp_path), max_bytes=50), 50))
    assert [r.content for r in accepted.collect()] == ['<process name="a"/>']
    assert [r.reason for r in rejected.collect()] == ['"big.xml" is 119 B, the limit is 50 B']
