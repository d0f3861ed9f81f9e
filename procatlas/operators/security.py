"""Rules on secrets, personal data and environment values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procatlas.functions import text as t
from procatlas.model import Estate
from procatlas.operators.engine import define_rule, make_finding

CALL_KINDS = ("action", "subsheetRef")
USE_VAULT = "Keep the secret in a credential store and fetch it at run time."
USE_SETTING = "Move the value to an environment setting and refer to that."


def call_inputs(estate: Estate) -> DataFrame:
    """One row per input of an action or page call; inputs of code are not calls."""
    return estate.stages.where(F.col("kind").isin(*CALL_KINDS)).select(
        "release_id", "owner_type", "owner_id", "page_id", "stage_id", "name", F.explode("inputs").alias("i")
    )


def initial_values(estate: Estate) -> DataFrame:
    return estate.data_items.where(F.coalesce("initial_value", F.lit("")) != "")


@define_rule("SEC-001", "Credential written as a literal", "critical", "security",
             "A credential-named target receives a literal that looks like a real secret.")
def sec_001(estate: Estate, meta) -> DataFrame:
    value = t.whole_literal("i.raw")
    inputs = call_inputs(estate).where(t.is_credential_name("i.param_name") & t.credential_strength(value))
    value = t.whole_literal(F.get("exprs", F.lit(0))["raw"])
    stores = estate.stages.where(
        (F.col("kind") == "calculation") & t.is_credential_name("store_in") & t.credential_strength(value)
    )
    items = initial_values(estate).where(
        t.is_credential_name("name") & t.credential_strength("initial_value")
    )
    at = {"page": F.col("page_id"), "stage": F.col("stage_id")}
    by_input = F.format_string('Input "%s" of stage "%s" is a literal secret.', "i.param_name", "name")
    by_store = F.format_string('Calculation "%s" puts a literal secret into "%s".', "name", "store_in")
    by_item = F.format_string('Data item "%s" starts with a literal secret.', "name")
    return (
        make_finding(meta, inputs, by_input, USE_VAULT, 0.9, **at)
        .unionByName(make_finding(meta, stores, by_store, USE_VAULT, 0.9, **at))
        .unionByName(make_finding(meta, items, by_item, USE_VAULT, 0.9, **at))
    )


@define_rule("SEC-002", "Password parameter as plain text", "high", "security",
             "A process takes a credential-named startup parameter that is not of the password type.")
def sec_002(estate: Estate, meta) -> DataFrame:
    plain = estate.params.where(
        (F.col("direction") == "in") & t.is_credential_name("name") & (F.col("data_type") != "password")
    )
    # an owner's parameters come from one component, which is one row of the input
    in_order = F.array_sort(F.collect_list(F.struct("param_pos", "name")))
    per_owner = plain.groupBy("release_id", "owner_id").agg(F.array_join(F.transform(in_order, lambda p: p["name"]), '", "').alias("names"))
    processes = estate.owners.where(F.col("owner_type") == "process").select("release_id", "owner_id", "owner_type")
    message = F.format_string('Startup parameters carry secrets as plain text: "%s".', "names")
    return make_finding(meta, processes.join(per_owner, ["release_id", "owner_id"]), message, USE_VAULT, 0.9)


@define_rule("SEC-003", "Personal data in logs", "high", "security",
             "An alert or note shows social security, account or card data.")
def sec_003(estate: Estate, meta) -> DataFrame:
    raw = F.get("exprs", F.lit(0))["raw"]
    named = F.array_distinct(F.filter(t.identifier_refs(raw), t.is_sensitive_name))
    digits = F.array(F.lit("SSN literal"))
    none = F.array().cast("array<string>")
    alert = F.when(F.size(named) > 0, named).when(t.has_ssn_digits(raw), digits).otherwise(none)
    note = F.when(t.has_ssn_digits("text"), digits).otherwise(none)
    rows = (
        estate.stages.where(F.col("kind").isin("alert", "note"))
        .withColumn("shown", F.when(F.col("kind") == "alert", alert).otherwise(note))
        .where(F.size("shown") > 0)
    )
    message = F.format_string('Stage "%s" shows sensitive data (%s).', F.col("name"), F.array_join("shown", ", "))
    return make_finding(meta, rows, message, "Show a masked reference instead.", 0.85,
                        page=F.col("page_id"), stage=F.col("stage_id"))


@define_rule("SEC-004", "Environment value written as a literal", "medium", "security",
             "A network path, URL or internal host is fixed in a data item or a call input.")
def sec_004(estate: Estate, meta) -> DataFrame:
    items = initial_values(estate).where(t.looks_like_environment_value("initial_value"))
    inputs = call_inputs(estate).where(t.looks_like_environment_value(t.whole_literal("i.raw")))
    at = {"page": F.col("page_id"), "stage": F.col("stage_id")}
    by_item = F.format_string('Data item "%s" fixes the environment value "%s".', "name", "initial_value")
    by_input = F.format_string(
        'Input "%s" of stage "%s" fixes an environment value.', "i.param_name", "name"
    )
    return make_finding(meta, items, by_item, USE_SETTING, 0.85, **at).unionByName(
        make_finding(meta, inputs, by_input, USE_SETTING, 0.85, **at)
    )
