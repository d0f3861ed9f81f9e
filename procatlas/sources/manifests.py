"""What the target environment must provide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.model import Estate
from procatlas.operators.select import first_queue


def _declared(queues: DataFrame) -> DataFrame:
    """One row per release and queue name; of several declarations the last one counts."""
    return queues.groupBy("release_id", "name").agg(
        F.max_by(F.struct("key_field", "max_attempts", "encrypted"), "queue_pos").alias("q")
    ).select("release_id", "name", "q.*")


def queue_manifest(estate: Estate) -> DataFrame:
    """Declared queues, and queues that processes name without a declaration."""
    declared = _declared(estate.work_queues).withColumn("source", F.lit("work-queue-definition"))
    named = estate.stages.where((F.col("owner_type") == "process") & (F.col("kind") == "action") & F.col("queue_name").isNotNull()).select(
        "release_id", F.col("queue_name").alias("name")
    ).distinct()
    missing = named.join(declared.select("release_id", "name"), ["release_id", "name"], "left_anti").withColumn("source", F.lit("referenced-by-process"))
    return declared.unionByName(missing, allowMissingColumns=True).orderBy("release_id", "name")


def _asset_type(data_type: Column) -> Column:
    return F.when(data_type == "number", "Integer").when(data_type == "flag", "Boolean").otherwise("Text")


def asset_manifest(estate: Estate) -> DataFrame:
    """Environment variables by type, and credentials."""
    variables = estate.env_vars.select(
        "release_id", "name", _asset_type(F.col("data_type")).alias("type"), "value", "description", F.lit("environment-variable").alias("source")
    )
    credentials = estate.credentials.select(
        "release_id", "name", F.lit("Credential").alias("type"), F.lit(None).cast("string").alias("value"),
        F.lit("Create as a credential asset").alias("description"), F.lit("credential-reference").alias("source"),
    )
    return variables.unionByName(credentials).orderBy("release_id", "name")


def setup_plan(estate: Estate) -> DataFrame:
    """The items to create, with a short description each."""
    ref = F.when(F.col("key_field").isNotNull(), F.concat(F.lit(' · unique ref from "'), F.col("key_field"), F.lit('"'))).otherwise("")
    tries = F.when(F.col("max_attempts").isNotNull(), F.concat(F.lit(" · "), F.col("max_attempts").cast("string"), F.lit(" retries"))).otherwise("")
    queues = estate.work_queues.select("release_id", F.lit("queue").alias("kind"), "name", F.concat(F.lit("queue"), ref, tries).alias("detail"))
    short = F.when(F.col("data_type") == "number", "integer").when(F.col("data_type") == "flag", "bool").otherwise("text")
    given = F.when(F.col("value").isNotNull(), " (value from export)").otherwise("")
    variables = estate.env_vars.select("release_id", F.concat(F.lit("asset-"), short).alias("kind"), "name", F.concat(short, F.lit(" asset"), given).alias("detail"))
    credentials = estate.credentials.select("release_id", F.lit("asset-credential").alias("kind"), "name", F.lit("credential asset (set the secret after creation)").alias("detail"))
    return queues.unionByName(variables).unionByName(credentials)


def config_entries(estate: Estate) -> DataFrame:
    """Key and value per process: its first queue, and the release's variables and credentials."""
    processes = estate.owners.where(F.col("owner_type") == "process").select("release_id", "owner_id")
    queue = first_queue(estate.stages).select("release_id", "owner_id", F.lit("OrchestratorQueueName").alias("key"), F.col("queue_name").alias("value"))
    shared = estate.env_vars.select("release_id", F.col("name").alias("key"), F.coalesce("value", F.lit("")).alias("value")).unionByName(
        estate.credentials.select("release_id", F.concat("name", F.lit("_CredentialAsset")).alias("key"), F.col("name").alias("value"))
    )
    return queue.unionByName(processes.join(shared, "release_id"))
