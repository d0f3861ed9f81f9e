"""The normalised tables of an estate.

Keys: a release (one export file) holds owners (processes and objects), an owner
holds pages, a page holds stages and edges.  ``stages`` repeats the few owner and
page columns that give document order, so that most operators need no join.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RELEASE = ("release_id",)
OWNER = ("release_id", "owner_id")
PAGE = ("release_id", "owner_id", "page_id")
STAGE = ("release_id", "owner_id", "page_id", "stage_id")
# Document order of stages: processes before objects, then as written.
WALK_ORDER = ("release_id", "owner_rank", "owner_pos", "page_index", "stage_pos")

LOCATION_TYPE = (
    "struct<process_id:string,object_id:string,page_id:string,stage_id:string,element_id:string>"
)

SCHEMAS = {
    "releases": "release_id string, file string, package_name string, bp_version string, "
    "export_date string, source_hash string, size_bytes bigint",
    "owners": "release_id string, owner_id string, owner_type string, name string, description string, "
    "application_name string, owner_rank int, owner_pos int, source_ref string",
    "pages": "release_id string, owner_id string, owner_type string, page_id string, name string, "
    "page_index int, source_ref string",
    "stages": "release_id string, owner_id string, owner_type string, owner_rank int, owner_pos int, "
    "page_id string, page_name string, page_index int, stage_id string, name string, kind string, stage_pos int, "
    "object_name string, action_name string, queue_name string, store_in string, collection_name string, "
    "pair_id string, data_item_id string, target_page_id string, target_page_name string, "
    "timeout_seconds double, exception_type string, preserve boolean, language string, body string, text string, "
    "raw_type string, exprs array<struct<role:string,name:string,raw:string>>, "
    "inputs array<struct<param_name:string,raw:string>>, outputs array<struct<param_name:string,store_in:string>>, "
    "steps array<struct<element_id:string,action:string,store_in:string,raw:string>>, source_ref string",
    "edges": "release_id string, owner_id string, page_id string, src string, dst string, kind string, "
    "label string, edge_pos bigint",
    "data_items": "release_id string, owner_id string, owner_type string, item_id string, name string, "
    "data_type string, initial_value string, exposure string, fields array<struct<name:string,data_type:string>>, "
    "page_id string, stage_id string, item_pos int, source_ref string",
    "params": "release_id string, owner_id string, name string, data_type string, direction string, param_pos int",
    "elements": "release_id string, owner_id string, element_id string, name string, mode string, "
    "attributes array<struct<name:string,value:string,match_type:string,enabled:boolean>>, "
    "element_pos int, source_ref string",
    "work_queues": "release_id string, queue_id string, name string, key_field string, max_attempts int, "
    "encrypted boolean, queue_pos int",
    "env_vars": "release_id string, name string, data_type string, value string, description string, var_pos int",
    "credentials": "release_id string, name string",
    "issues": "release_id string, level string, message string, path string",
}

FINDING_SCHEMA = (
    f"release_id string, rule_id string, severity string, category string, location {LOCATION_TYPE}, "
    "message string, remediation string, confidence double"
)


@dataclass(frozen=True)
class Estate:
    """The normalised tables; a table an export kind does not have is an empty frame."""

    releases: DataFrame
    owners: DataFrame
    pages: DataFrame
    stages: DataFrame
    edges: DataFrame
    data_items: DataFrame
    params: DataFrame
    elements: DataFrame
    work_queues: DataFrame
    env_vars: DataFrame
    credentials: DataFrame
    issues: DataFrame

    @staticmethod
    def of(spark: SparkSession, **tables: DataFrame) -> "Estate":
        """Build from the given tables; columns that are left out become null."""
        built = {}
        for name, ddl in SCHEMAS.items():
            empty = spark.createDataFrame([], ddl)
            given = tables.get(name)
            built[name] = empty if given is None else conform(given, empty)
        return Estate(**built)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def union(self, other: "Estate") -> "Estate":
        theirs = other.tables()
        return Estate(**{name: df.unionByName(theirs[name]) for name, df in self.tables().items()})

    def write(self, path: str) -> None:
        """One Parquet table per name under ``path``."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Estate":
        return Estate(
            **{n: spark.read.schema(ddl).parquet(f"{path.rstrip('/')}/{n}") for n, ddl in SCHEMAS.items()}
        )


def conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, cast; missing ones null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def location(
    owner_type: Column | str = "owner_type",
    owner_id: Column | str = "owner_id",
    page_id: Column | None = None,
    stage_id: Column | None = None,
    element_id: Column | None = None,
) -> Column:
    """Where a finding is: a process or an object, and maybe a page, stage or element of it."""
    owner_type = F.col(owner_type) if isinstance(owner_type, str) else owner_type
    owner_id = F.col(owner_id) if isinstance(owner_id, str) else owner_id
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(owner_type == "process", owner_id).alias("process_id"),
        F.when(owner_type != "process", owner_id).alias("object_id"),
        (none if page_id is None else page_id).alias("page_id"),
        (none if stage_id is None else stage_id).alias("stage_id"),
        (none if element_id is None else element_id).alias("element_id"),
    )


def located_owner() -> Column:
    """Owner id of a finding, whichever kind of owner it is."""
    return F.coalesce(F.col("location.process_id"), F.col("location.object_id"))


def location_key() -> Column:
    """The five ids of a location joined by ``/``, missing ones empty."""
    parts = ("process_id", "object_id", "page_id", "stage_id", "element_id")
    return F.concat_ws("/", *[F.coalesce(F.col(f"location.{p}"), F.lit("")) for p in parts])
