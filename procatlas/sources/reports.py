"""Report data sets and the files they are written to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procatlas.functions.ranks import severity_rank
from procatlas.model import Estate, located_owner, location_key
from procatlas.operators import conversion, score
from procatlas.operators.summary import location_paths
from procatlas.operators.windows import numbered
from procatlas.session import written

# Fixed schema of an answer key file.
_FINDING = "struct<ruleId:string,severity:string,processName:string,objectName:string,pageName:string,stageName:string,elementName:string>"
_COUNTS = "struct<processes:int,objects:int,workQueues:int,environmentVars:int,credentialRefs:int>"
_PROCESS = (
    "struct<name:string,pages:array<string>,stageCount:int,dataItemCount:int,startupParams:array<string>,"
    "outputs:array<string>,stageKinds:map<string,int>,strayStageCount:int>"
)
_OBJECT = (
    "struct<name:string,applicationName:string,appElementCount:int,pages:array<string>,stageCount:int,dataItemCount:int,"
    "stageKinds:map<string,int>,strayStageCount:int>"
)
_SUMMARY = (
    "struct<processName:string,applicationsTouched:array<string>,objectsCalled:array<string>,queuesUsed:array<string>,"
    "inputs:array<string>,outputs:array<string>,hasRecovery:boolean,recoveryPages:array<string>,deliberateThrows:boolean,"
    "mainPageFirstSteps:array<string>,sensitiveItems:array<string>>"
)
ANSWER_KEY = (
    f"id string, file string, description string, notes string, expectedParse struct<errors:int,warnings:int,bpVersion:string,packageName:string,"
    f"counts:{_COUNTS},processes:array<{_PROCESS}>,objects:array<{_OBJECT}>>, expectedFindings array<{_FINDING}>, expectedSummaries array<{_SUMMARY}>"
)


def scan_answer_keys(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Expected results, one file per row, or one line per row where files hold many keys."""
    return spark.read.schema(ANSWER_KEY).json(path, multiLine=not one_per_line)


def expected_findings(keys: DataFrame) -> DataFrame:
    """The expected findings of the keys as rows of names."""
    rows = keys.select(F.col("id").alias("key_id"), "file", F.explode("expectedFindings").alias("f"))
    return rows.select(
        "key_id", "file", F.col("f.ruleId").alias("rule_id"), F.col("f.severity").alias("severity"), F.col("f.processName").alias("process_name"),
        F.col("f.objectName").alias("object_name"), F.col("f.pageName").alias("page_name"), F.col("f.stageName").alias("stage_name"), F.col("f.elementName").alias("element_name"),
    )


def scan_workspace(spark: SparkSession, root: str, table: str, where: dict[str, object] | None = None, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """A metadata table with equality filters, a column list and an order; filters and columns reach the Parquet scan."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{table}.parquet")
    for name, value in (where or {}).items():
        df = df.where(F.col(name) == value)
    if columns:
        df = df.select(*columns)
    return df.orderBy(*order) if order else df


FILE_FIELDS = ("file", "package_name", "bp_version", "parse_errors", "parse_warnings", "components", "findings", "average_score", "worst_grade")
COMPONENT_FIELDS = ("name", "role", "score", "grade", "stage_count", "purpose")
FINDING_FIELDS = ("rule_id", "severity", "category", "message")

REPORT_DOCUMENT = (
    "release_id string, document int, file string, package_name string, bp_version string, parse_errors long, parse_warnings long, components long, findings long, "
    "average_score long, worst_grade string, parts array<struct<name:string,role:string,score:long,grade:string,stage_count:long,purpose:string,"
    "findings:array<struct<rule_id:string,severity:string,category:string,message:string>>>>"
)


def _records(estate: Estate, findings: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row per file, per component and per finding) with the fields of their records; findings have their place in the component."""
    key = ["release_id", "owner_id"]
    files = estate.releases.select("release_id", "file", "package_name", "bp_version")
    totals = score.file_totals(scored, findings)
    problems = estate.issues.groupBy("release_id").agg(
        F.count_if(F.col("level") == "error").alias("parse_errors"), F.count_if(F.col("level") == "warning").alias("parse_warnings")
    )
    stages = estate.stages.groupBy(*key).agg(F.count("*").alias("stage_count"))
    head = files.join(totals, "release_id", "left").join(problems, "release_id", "left").na.fill(0)
    parts = scored.join(stages, key, "left").join(estate.owners.select(*key, "description"), key, "left").select(
        *key, "name", F.col("owner_type").alias("role"), "score", "grade", F.coalesce("stage_count", F.lit(0)).alias("stage_count"), F.coalesce("description", F.lit("")).alias("purpose")
    )
    place = F.concat_ws("/", severity_rank("severity").cast("string"), "rule_id", location_key())
    return head.select("release_id", *FILE_FIELDS), parts, findings.select("release_id", located_owner().alias("owner_id"), place.alias("place"), *FINDING_FIELDS)


def report_lines(estate: Estate, findings: DataFrame, scored: DataFrame) -> DataFrame:
    """The analysis report as JSON lines: a line per file, component and finding.

    Lines carry their place in the report, so the report is written by sorted
    partitions and no task assembles a whole file.
    """
    files, components, found = _records(estate, findings, scored)
    line = lambda record, fields: F.to_json(F.struct(F.lit(record).alias("record"), *fields)).alias("line")
    none = F.lit("")
    file_lines = files.select("release_id", none.alias("owner_id"), none.alias("place"), line("file", FILE_FIELDS))
    component_lines = components.select("release_id", "owner_id", none.alias("place"), line("component", COMPONENT_FIELDS))
    return file_lines.unionByName(component_lines).unionByName(found.select("release_id", "owner_id", "place", line("finding", FINDING_FIELDS)))


def report_documents(estate: Estate, findings: DataFrame, scored: DataFrame, records: int = 100_000) -> DataFrame:
    """The analysis report as one nested document per file: its fields, its components in order, their findings in order.

    A document holds at most ``records`` components and findings. A file with more goes on in further ones with the same
    fields and the next ``document`` number, in which a component that is cut appears again with its other findings; put
    together in order they are the whole. Findings of no component follow under one without fields; a file without
    components has one document. Places come from the ranges of one global sort, so no task holds a file's records.
    """
    files, components, found = _records(estate, findings, scored)
    order = ["release_id", "owner_id", "place", "tie"]
    finding = F.struct(*FINDING_FIELDS).alias("finding")
    rows = found.select("release_id", F.coalesce("owner_id", F.lit("")).alias("owner_id"), "place", F.xxhash64("message", "category").alias("tie"), finding)
    heads = components.select("release_id", "owner_id", F.lit("").alias("place"), F.lit(None).cast("long").alias("tie"), F.lit(None).cast(rows.schema["finding"].dataType).alias("finding"))
    spread = heads.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("split", F.spark_partition_id())
    placed = numbered(written(spread, "report-records"), ["release_id"], order[1:], [F.col("split")], "at")
    placed = placed.withColumn("document", F.floor((F.col("at") - 1) / records).cast("int"))
    entry = F.when(F.col("finding").isNotNull(), F.struct("at", "finding"))
    nested = placed.groupBy("release_id", "document", "owner_id").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(entry)).alias("entries"))
    nested = nested.join(components, ["release_id", "owner_id"], "left").select(
        "release_id", "document", F.struct("at", F.struct(*COMPONENT_FIELDS, F.col("entries.finding").alias("findings")).alias("component")).alias("entry")
    )
    documents = nested.groupBy("release_id", "document").agg(F.array_sort(F.collect_list("entry"))["component"].alias("parts"))
    whole = files.join(documents, "release_id", "left")
    empty = F.array().cast(whole.schema["parts"].dataType)
    return whole.select("release_id", F.coalesce("document", F.lit(0)).alias("document"), *FILE_FIELDS, F.coalesce("parts", empty).alias("parts"))


def write_report_documents(estate: Estate, findings: DataFrame, scored: DataFrame, path: str, records: int = 100_000) -> None:
    """The nested documents as JSON, in the order of files."""
    report_documents(estate, findings, scored, records).repartitionByRange("release_id", "document").sortWithinPartitions("release_id", "document").write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, order: list[str], column: str = "line") -> None:
    """Write lines as text in a global order; range partitions are sorted in parallel."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.mode("overwrite").text(path)


def write_report_json(estate: Estate, findings: DataFrame, scored: DataFrame, path: str) -> None:
    write_lines(report_lines(estate, findings, scored), path, ["release_id", "owner_id", "place"])


def scan_report_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_DOCUMENT).json(path)


def audit_dataset(estate: Estate, findings: DataFrame, coverage: DataFrame, punch: DataFrame, effort: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row per component, a row per finding of a component with its place and order)."""
    scored = score.score_owners(estate.owners, findings)
    punched = punch.groupBy("release_id", "owner_id").agg(F.count("*").alias("punch_count"))
    key = ["release_id", "owner_id"]
    sections = (
        scored.join(coverage.select(*key, "stage_count", "coverage_pct"), key, "left").join(punched, key, "left")
        .join(effort.select(*key, "effort_hours"), key, "left")
        .select(*key, "name", F.col("owner_type").alias("role"), "score", "grade", F.coalesce("stage_count", F.lit(0)).alias("stage_count"),
                F.coalesce("coverage_pct", F.lit(100.0)).alias("coverage_pct"), F.coalesce("punch_count", F.lit(0)).alias("punch_count"), "effort_hours", "finding_count")
    )
    rows = location_paths(findings, estate).select(
        "release_id", located_owner().alias("owner_id"), "rule_id", "severity", severity_rank("severity").alias("severity_rank"), "location_path", "message"
    )
    return sections, rows


def migration_report(estate: Estate, coverage: DataFrame, punch: DataFrame, effort: DataFrame) -> DataFrame:
    """The report of each process as numbered lines: coverage, manual work, selectors, effort.

    A section is a union of rows; the line order is (section, place), so a long
    report is sorted and written by many tasks.
    """
    key = ["release_id", "owner_id"]
    processes = estate.owners.where(F.col("owner_type") == "process").select(*key, "name")
    objects = estate.owners.where(F.col("owner_type") == "object").select("release_id", F.col("owner_id").alias("object_id"), F.col("name").alias("object_name"))
    called = estate.stages.where((F.col("kind") == "action") & (F.col("owner_type") == "process") & F.col("queue_name").isNull()).select(*key, "object_name").distinct()
    scope = processes.select(*key, F.col("owner_id").alias("part_id"), F.col("name").alias("part_name"), F.lit("process").alias("role")).unionByName(
        called.join(objects, ["release_id", "object_name"]).select(*key, F.col("object_id").alias("part_id"), F.col("object_name").alias("part_name"), F.lit("object").alias("role"))
    )

    def rows(df: DataFrame, section: int, place, text) -> DataFrame:
        return df.select(*key, F.lit(section).alias("section"), place.cast("string").alias("place"), text.alias("line"))

    title = rows(processes, 0, F.lit(""), F.concat(F.lit("# Migration report: "), F.col("name")))
    cov = scope.join(coverage.withColumnRenamed("owner_id", "part_id").select("release_id", "part_id", "stage_count", "converted_count", "coverage_pct"), ["release_id", "part_id"])
    coverage_rows = rows(cov, 1, F.concat_ws("/", F.when(F.col("role") == "process", "0").otherwise("1"), "part_name"),
                         F.format_string("| %s (%s) | %d/%d | %s%% |", F.col("part_name"), F.col("role"), F.col("converted_count"), F.col("stage_count"), F.col("coverage_pct").cast("string")))
    work = scope.join(punch.withColumnRenamed("owner_id", "part_id"), ["release_id", "part_id"])
    punch_rows = rows(work, 2, F.concat_ws("/", "part_name", "source_ref", "reason"),
                      F.format_string("| %s | %s | %s | %s | %s |", "page_name", "name", "kind", "detail", "source_ref"))
    selectors = conversion.score_selectors(estate.elements).withColumnRenamed("owner_id", "part_id").withColumnRenamed("name", "element_name")
    picked = scope.join(selectors, ["release_id", "part_id"])
    selector_rows = rows(picked, 3, F.concat_ws("/", "part_name", "element_id"),
                         F.format_string("| %s | %s | %s | %s | %.2f | %s |", F.col("part_name"), F.col("element_name"), F.col("mode"), F.coalesce("selector", F.lit("image only")), F.col("confidence"), F.array_join("notes", "; ")))
    total = rows(effort, 4, F.lit(""), F.format_string("| Total | %d stages, %d manual items, %d selectors of which %d risky | %.1f h |", "stages", "punch", "selectors", "risky", "effort_hours"))
    return title.unionByName(coverage_rows).unionByName(punch_rows).unionByName(selector_rows).unionByName(total)


def write_migration_report(lines: DataFrame, path: str) -> None:
    """One folder per process of each release, its lines in order."""
    order = ["release_id", "owner_id", "section", "place"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("release_id", "owner_id", "line").write.mode("overwrite").partitionBy("release_id", "owner_id").text(path)
