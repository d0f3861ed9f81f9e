"""Workspace tables: upserts, history, tenancy and invitations.

Tables are keyed frames.  An upsert is an anti-join and a union, which the caller
writes as one new version of the table or of the partitions it touches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.functions.text import source_hash
from procatlas.model import Estate, located_owner
from procatlas.operators import graph, score, summary
from procatlas.operators.guards import content_markers

ROLES = ("admin", "editor", "viewer")
ARTIFACT_KINDS = ("bprelease", "uipath-export")
AUDIT_SCHEMA = "workspace_id string, actor string, event string, subject_type string, subject_id string, detail string, at timestamp"
# Who may do what to which table.
POLICIES = {
    "workspaces": {"update": ("admin",), "delete": ("admin",)},
    "workspace_members": {"insert": ("admin",), "update": ("admin",), "delete": ("admin",)},
    "programs": {"insert": ("admin", "editor"), "update": ("admin", "editor"), "delete": ("admin",)},
    "processes": {"insert": ("admin", "editor"), "update": ("admin", "editor"), "delete": ("admin", "editor")},
    "findings": {"insert": ("admin", "editor"), "update": ("admin", "editor"), "delete": ("admin", "editor")},
    "audit_events": {"insert": ("admin", "editor", "viewer")},
    "dependency_edges": {"insert": ("admin", "editor"), "delete": ("admin", "editor")},
    "workspace_invites": {"delete": ("admin",)},
    "artifacts": {"insert": ("admin", "editor"), "delete": ("admin",)},
}


# --- sync --------------------------------------------------------------------


def build_sync_rows(estate: Estate, findings: DataFrame, effort: DataFrame, contents: DataFrame) -> dict[str, DataFrame]:
    """Process, finding and edge rows of the releases, and what in them looks like source content.

    ``contents`` has release_id and content; it only goes into the hash.
    """
    scored = score.score_owners(estate.owners.where(F.col("owner_type") == "process"), findings)
    stages = estate.stages.groupBy("release_id", "owner_id").agg(F.count("*").alias("stage_count"))
    releases = estate.releases.select("release_id", "bp_version")
    processes = (
        scored.join(stages, ["release_id", "owner_id"], "left").join(effort.select("release_id", "owner_id", "effort_hours"), ["release_id", "owner_id"], "left")
        .join(releases, "release_id", "left").join(contents.select("release_id", "content"), "release_id")
        .select(
            "release_id", "owner_id", F.col("name").alias("bp_name"), source_hash("content", "name").alias("source_hash"), "bp_version",
            F.coalesce("stage_count", F.lit(0)).alias("stage_count"), "score", "grade", F.col("effort_hours").alias("effort_hours_est"),
        )
    )
    placed = summary.location_paths(findings.where("location.process_id is not null"), estate)
    rows = placed.select("release_id", located_owner().alias("owner_id"), "rule_id", "severity", "category", "location_path", "message")
    edges = graph.dependency_edges(estate.owners, estate.stages)
    keyed = {"processes": (processes, ["source_hash"]), "findings": (rows, ["owner_id", "rule_id"]), "edges": (edges, ["from_name", "to_name"])}
    checks = [
        content_markers(df, ["release_id"]).select(F.lit(name).alias("table"), "release_id", "path", "marker") for name, (df, _) in keyed.items()
    ]
    return {"processes": processes, "findings": rows, "edges": edges, "violations": reduce(DataFrame.unionByName, checks)}


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Source rows replace target rows of the same key; columns in ``keep`` stay as they were.

    Source rows are expected to be unique by key.
    """
    key, kept = list(key), [c for c in keep if c in target.columns]
    old = target.select(*key, *[F.col(c).alias(f"__{c}") for c in kept], F.lit(True).alias("__there"))
    merged = source.join(old, key, "left")
    for c in kept:
        new = F.col(c) if c in source.columns else F.lit(None)
        merged = merged.withColumn(c, F.when(F.col("__there"), F.col(f"__{c}")).otherwise(new))
    merged = merged.drop("__there", *[f"__{c}" for c in kept])
    untouched = target.join(source.select(*key), key, "left_anti")
    return untouched.unionByName(merged, allowMissingColumns=True).select(*target.columns)


def upsert_processes(target: DataFrame, source: DataFrame) -> DataFrame:
    """By (program_id, source_hash); id and status of a known process stay."""
    return upsert(target, source, ["program_id", "source_hash"], ["id", "status"])


def replace_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, parent_key: str = "process_id") -> DataFrame:
    """All children of the re-synced parents are dropped, the fresh ones put in."""
    kept = children.join(parents.select(parent_key).distinct(), parent_key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


EDGE_KEY = ("program_id", "from_name", "from_type", "to_name", "to_type")


def insert_absent(target: DataFrame, source: DataFrame, key: Sequence[str] = EDGE_KEY) -> DataFrame:
    """The source rows to append: those whose key the target lacks, once each."""
    return source.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")


# --- history -----------------------------------------------------------------


def status_changes(old: DataFrame, new: DataFrame, programs: DataFrame, actor: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """(processes with updated_at touched, an audit row for every status that differs)."""
    before = old.select("id", F.col("status").alias("__from"))
    joined = new.join(before, "id", "left")
    known = joined.where(~F.col("__from").eqNullSafe(F.col("status"))).join(old.select("id"), "id", "left_semi")
    spaces = programs.select(F.col("id").alias("program_id"), "workspace_id")
    audit = known.join(spaces, "program_id", "left").select(
        "workspace_id", actor.alias("actor"), F.lit("status.changed").alias("event"), F.lit("process").alias("subject_type"),
        F.col("id").cast("string").alias("subject_id"),
        F.to_json(F.struct(F.col("__from").alias("from"), F.col("status").alias("to"), F.col("bp_name").alias("name"))).alias("detail"), at.alias("at"),
    )
    return joined.drop("__from").withColumn("updated_at", at), audit


def recent_audit(events: DataFrame, workspace, limit: int = 12) -> DataFrame:
    """The newest events of one workspace."""
    return events.where(F.col("workspace_id") == workspace).orderBy(F.desc("at"), F.desc("id")).limit(limit)


def prune_audit(events: DataFrame, workspaces: DataFrame, now: Column) -> DataFrame:
    """Events within their workspace's retention; a workspace without one keeps all."""
    kept = events.join(workspaces.select(F.col("id").alias("workspace_id"), "retention_days"), "workspace_id", "left")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return kept.where(F.col("retention_days").isNull() | (age <= F.col("retention_days") * 86_400_000_000)).drop("retention_days")


def purge_workspaces(tables: dict[str, DataFrame], purged: DataFrame) -> dict[str, DataFrame]:
    """Programs of the purged workspaces go, and with them their processes, findings and edges.

    ``tables`` holds programs, processes, findings and dependency_edges; ``purged`` has workspace_id.
    """
    programs = tables["programs"].join(purged.select("workspace_id"), "workspace_id", "left_anti")
    alive = programs.select(F.col("id").alias("program_id"))
    processes = tables["processes"].join(alive, "program_id", "left_semi")
    findings = tables["findings"].join(processes.select(F.col("id").alias("process_id")), "process_id", "left_semi")
    edges = tables["dependency_edges"].join(alive, "program_id", "left_semi")
    return {"programs": programs, "processes": processes, "findings": findings, "dependency_edges": edges}


def purge_events(tables: dict[str, DataFrame], events: DataFrame, workspaces: DataFrame, purged: DataFrame, actor: Column, now: Column) -> DataFrame:
    """One ``workspace.purged`` event per workspace with the counts of what went."""
    programs = tables["programs"].groupBy("workspace_id").agg(F.count("*").alias("programs_deleted"))
    kept = prune_audit(events, workspaces, now).groupBy("workspace_id").agg(F.count("*").alias("kept"))
    had = events.groupBy("workspace_id").agg(F.count("*").alias("had"))
    counts = purged.select("workspace_id").join(programs, "workspace_id", "left").join(had, "workspace_id", "left").join(kept, "workspace_id", "left").na.fill(0)
    days = workspaces.select(F.col("id").alias("workspace_id"), "retention_days")
    detail = F.to_json(F.struct("programs_deleted", (F.col("had") - F.col("kept")).alias("audit_events_pruned"), "retention_days"))
    return counts.join(days, "workspace_id", "left").select(
        "workspace_id", actor.alias("actor"), F.lit("workspace.purged").alias("event"), F.lit("workspace").alias("subject_type"),
        F.col("workspace_id").cast("string").alias("subject_id"), detail.alias("detail"), now.alias("at"),
    )


def named_audit_trail(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events with a readable actor: e-mail, else the first 8 characters of the id, else ``system``."""
    known = members.select("workspace_id", F.col("user_id").alias("actor"), "email").dropDuplicates(["workspace_id", "actor"])
    joined = events.join(known, ["workspace_id", "actor"], "left")
    return joined.withColumn("actor_name", F.coalesce("email", F.substring("actor", 1, 8), F.lit("system"))).drop("email")


# --- tenancy -----------------------------------------------------------------


def workspace_of(table: DataFrame, name: str, programs: DataFrame, processes: DataFrame) -> DataFrame:
    """The table's rows with the workspace they belong to, through program and process where needed."""
    if name == "workspaces":
        return table.withColumn("workspace_id", F.col("id"))
    if "workspace_id" in table.columns:
        return table
    to_space = programs.select(F.col("id").alias("program_id"), "workspace_id")
    if "program_id" in table.columns:
        return table.join(to_space, "program_id")
    to_program = processes.select(F.col("id").alias("process_id"), "program_id").join(to_space, "program_id").drop("program_id")
    return table.join(to_program, "process_id")


def tenant_view(table: DataFrame, name: str, user: str, members: DataFrame, programs: DataFrame, processes: DataFrame) -> DataFrame:
    """The rows a user may read: those of workspaces the user is a member of.

    The user's few workspaces filter programs and processes before they meet the table.
    """
    mine = members.where(F.col("user_id") == user).select("workspace_id")
    return workspace_of(table, name, programs, processes).join(mine, "workspace_id", "left_semi").select(*table.columns)


def writable_rows(
    table: DataFrame, name: str, action: str, user: str, members: DataFrame, programs: DataFrame, processes: DataFrame,
    workspaces: DataFrame | None = None,
) -> DataFrame:
    """The rows a user may insert, update or delete, by role and table.

    Inserts into programs, audit events and artifacts must be signed by the user;
    artifacts need the workspace's storage switched on.
    """
    allowed = POLICIES.get(name, {}).get(action, ())
    mine = members.where((F.col("user_id") == user) & F.col("role").isin(*allowed)).select("workspace_id")
    rows = workspace_of(table, name, programs, processes).join(mine, "workspace_id", "left_semi")
    signed = {"programs": "created_by", "audit_events": "actor", "artifacts": "uploaded_by"}
    if action == "insert" and name in signed:
        rows = rows.where(F.col(signed[name]) == user)
    if action == "insert" and name == "artifacts":
        if workspaces is None:
            raise ValueError("artifacts need the workspaces table")
        on = workspaces.where("artifact_storage_enabled").select(F.col("id").alias("workspace_id"))
        rows = rows.join(on, "workspace_id", "left_semi")
    return rows.select(*table.columns)


def list_members(members: DataFrame, users: DataFrame) -> DataFrame:
    """Members with their e-mail, by role then e-mail."""
    return members.join(users.select(F.col("id").alias("user_id"), "email"), "user_id").orderBy("workspace_id", "role", "email")


def list_workspaces(workspaces: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """A user's workspaces with the user's role, oldest first."""
    mine = members.where(F.col("user_id") == user).select(F.col("workspace_id").alias("id"), "role")
    return workspaces.join(mine, "id").withColumn("role", F.coalesce("role", F.lit("viewer"))).orderBy("created_at")


def add_members(requests: DataFrame, users: DataFrame, members: DataFrame, invites: DataFrame, actor: Column, at: Column) -> dict[str, DataFrame]:
    """Requests (workspace_id, email, role) become memberships for known addresses, invites for others."""
    wanted = requests.withColumn("email", F.lower(F.trim("email"))).where(F.col("role").isin(*ROLES))
    known = users.select(F.lower("email").alias("email"), F.col("id").alias("user_id"))
    joined = wanted.join(known, "email", "left")
    added = joined.where("user_id is not null").select("workspace_id", "user_id", "role").join(members.select("workspace_id", "user_id"), ["workspace_id", "user_id"], "left_anti")
    invited = joined.where("user_id is null").select("workspace_id", "email", "role", actor.alias("invited_by"), at.alias("invited_at"))
    event = lambda df, name, kind, subject: df.select(
        "workspace_id", actor.alias("actor"), F.lit(name).alias("event"), F.lit(kind).alias("subject_type"), subject.cast("string").alias("subject_id"),
        F.to_json(F.struct("role")).alias("detail"), at.alias("at"),
    )
    none = F.lit(None)
    return {
        "members": members.unionByName(added),
        "invites": upsert(invites, invited, ["workspace_id", "email"], ["invited_by", "invited_at"]),
        "audit": event(invited, "member.invited", "email", none).unionByName(event(added, "member.added", "user", F.col("user_id"))),
    }


def claim_invites(users: DataFrame, members: DataFrame, invites: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Invites of the given users become memberships and go; every claim is recorded."""
    known = users.select(F.lower("email").alias("email"), F.col("id").alias("user_id"))
    claimed = invites.join(known, "email")
    fresh = claimed.select("workspace_id", "user_id", "role").join(members.select("workspace_id", "user_id"), ["workspace_id", "user_id"], "left_anti")
    audit = claimed.select(
        "workspace_id", F.col("user_id").alias("actor"), F.lit("member.joined").alias("event"), F.lit("user").alias("subject_type"),
        F.col("user_id").cast("string").alias("subject_id"), F.lit(None).cast("string").alias("detail"), at.alias("at"),
    )
    return {"members": members.unionByName(fresh), "invites": invites.join(known.select("email"), "email", "left_anti"), "audit": audit}


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, key) of every row that breaks a rule; tables that are not given are not checked."""
    broken = []

    def check(name: str, rule: str, cond: Column, key: str) -> None:
        if name in tables:
            broken.append(tables[name].where(cond).select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key")))

    check("processes", "status", ~F.col("status").isin(*score.STATUSES), "id")
    check("workspace_members", "role", ~F.col("role").isin(*ROLES), "user_id")
    check("workspace_invites", "role", ~F.col("role").isin(*ROLES), "email")
    check("workspaces", "retention", F.col("retention_days") < 1, "id")
    check("artifacts", "kind", ~F.col("kind").isin(*ARTIFACT_KINDS), "id")
    check("artifacts", "size", F.col("size_bytes") < 0, "id")
    if "artifacts" in tables and "workspaces" in tables:
        off = tables["workspaces"].where(~F.coalesce("artifact_storage_enabled", F.lit(False))).select(F.col("id").alias("workspace_id"))
        dark = tables["artifacts"].join(off, "workspace_id", "left_semi")
        broken.append(dark.select(F.lit("artifacts").alias("table"), F.lit("storage").alias("rule"), F.col("id").cast("string").alias("key")))
    return reduce(DataFrame.unionByName, broken)
