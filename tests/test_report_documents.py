"""Nested report documents against their records put together in a loop, with and without a cut."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from procatlas.model import Estate
from procatlas.sources import reports

FINDING = "release_id string, rule_id string, severity string, category string, location struct<process_id:string,object_id:string,page_id:string,stage_id:string,element_id:string>, message string"


@pytest.fixture(scope="module")
def report(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    owners = [("r1", f"P{i}", "process", f"Process {i}", None if i else "first") for i in range(4)] + [("r2", "P0", "process", "Same id", "")]
    tables = {
        "releases": table([(r, f"{r}.bprelease", "Package", "6.8") for r in ("r1", "r2", "r3")], "release_id string, file string, package_name string, bp_version string"),
        "owners": table(owners, "release_id string, owner_id string, owner_type string, name string, description string"),
        "issues": table([("r1", "warning")], "release_id string, level string"),
        "stages": table([("r1", "P1")] * 3, "release_id string, owner_id string"),
    }
    estate = Estate(**{name: tables.get(name, tables["issues"]) for name in Estate.__dataclass_fields__})
    hot = [("r1", "R", "high" if i % 2 else "low", "c", Row(process_id="P2", object_id=None, page_id=None, stage_id=f"s{i:03}", element_id=None), f"m{i}") for i in range(40)]
    few = [("r1", "R", "info", "c", Row(process_id="P0", object_id=None, page_id=None, stage_id="x", element_id=None), "again")] * 3
    lost = [("r2", "R", "info", "c", Row(process_id=None, object_id=None, page_id=None, stage_id=None, element_id=None), "of the file")]
    findings = table(hot + few + lost, FINDING)
    scored = estate.owners.select("release_id", "owner_id", "name", "owner_type", F.lit(90).cast("long").alias("score"), F.lit("A").alias("grade"))
    return estate, findings, scored


def put_together(documents):
    whole = {}
    for d in sorted(documents, key=lambda d: (d.release_id, d.document)):
        assert d.document == len(whole.setdefault(d.release_id, []))
        whole[d.release_id].append(d)
    parts = {}
    for release, docs in whole.items():
        parts[release] = merged = []
        for d in docs:
            assert d.file == f"{release}.bprelease"
            for part in d.parts:
                if merged and part.name == merged[-1][0]:
                    merged[-1][1].extend(f.message for f in part.findings)
                else:
                    merged.append((part.name, [f.message for f in part.findings]))
    return parts


@pytest.mark.parametrize("records", [100_000, 7, 1])
def test_documents(spark, report, tmp_path, records):
    path = str(tmp_path / "report")
    reports.write_report_documents(*report, path, records)
    documents = reports.scan_report_documents(spark, path).collect()
    assert all(sum(1 + len(p.findings) for p in d.parts) <= records + 1 for d in documents)  # a part that is cut has its head again
    assert max(d.document for d in documents) == (47 - 1) // records
    hot = sorted((f"m{i}" for i in range(40)), key=lambda m: (int(m[1:]) % 2 == 0, int(m[1:])))
    assert put_together(documents) == {
        "r1": [("Process 0", ["again"] * 3), ("Process 1", []), ("Process 2", hot), ("Process 3", [])],
        "r2": [(None, ["of the file"]), ("Same id", [])], "r3": [],
    }
