"""Repository queries, stage markers, audit events and approvals over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from .classify import severity

APPROVAL_LEVEL = "high"
EXPIRY_HOURS = 72


def latest(df: DataFrame, key: str, version: str, *ties: str) -> DataFrame:
    """Last writer wins: one row per key, the greatest version."""
    order = [F.desc_nulls_last(version), *(F.col(t) for t in ties)]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    return latest(current.unionByName(incoming), key, version)


def exists_in(rows: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    return rows.join(stored.select(*keys).distinct(), list(keys), "left_semi")


def missing_from(rows: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    return rows.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def newest(df: DataFrame, by: str, limit: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(limit)


def stage_counts(markers: DataFrame, run_id: str | None = None) -> DataFrame:
    """Documents per stage; stages nothing has reached count 0."""
    rows = markers if run_id is None else markers.where(F.col("run_id") == run_id)
    counts = rows.groupBy("stage").agg(F.count_distinct("document_id").alias("n"))
    stages = markers.sparkSession.createDataFrame([(i, s) for i, s in enumerate(rules.STAGES)], "stage_no int, stage string")
    return stages.join(counts, "stage", "left").select("stage_no", "stage", F.coalesce("n", F.lit(0)).alias("n_documents"))


def last_run(markers: DataFrame) -> DataFrame:
    return markers.agg(F.max_by("run_id", "id").alias("run_id"))


def stage_markers(outcomes: DataFrame, run_id: str) -> DataFrame:
    """Markers of (document_id, last_stage): every stage up to the last one reached."""
    stages = F.array(*(F.lit(s) for s in rules.STAGES))
    reached = F.slice(stages, 1, F.array_position(stages, F.col("last_stage")).cast("int"))
    return outcomes.select("document_id", F.explode(reached).alias("stage"), F.lit(run_id).alias("run_id"))


def requires_approval(level: Column, threshold: str = APPROVAL_LEVEL) -> Column:
    return severity(level) >= rules.SEVERITY[threshold]


def approval_requests(scored: DataFrame, as_of: Column, run_id: str = "", threshold: str = APPROVAL_LEVEL, auto: bool = True) -> DataFrame:
    """A request for each scored document (with rationale and actions): pending from the threshold on, else approved by "auto".

    Without ``auto`` documents below the threshold have no request.  Only pending requests carry a
    payload and an end.
    """
    waits = requires_approval(F.col("risk_level"), threshold)
    rows = scored if auto else scored.where(waits)
    action = lambda a: F.struct(a["title"].alias("title"), a["priority"].alias("priority"), a["owner"].alias("owner"))
    payload = F.struct(
        "score", F.left("rationale", F.lit(2000)).alias("rationale"), "impacted_areas", F.transform(F.slice("actions", 1, 10), action).alias("actions")
    )
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit("approval"), "id"), 256).alias("approval_id"),
        F.col("id").alias("document_id"),
        F.sha2(F.concat_ws("|", F.lit("assessment"), "id"), 256).alias("assessment_id"),
        F.lit(run_id).alias("run_id"),
        "risk_level",
        F.when(waits, "pending").otherwise("approved").alias("status"),
        F.when(waits, F.col("title")).otherwise(F.coalesce("title", F.lit("Untitled"))).alias("title"),
        F.when(waits, F.col("summary")).alias("summary"),
        F.size("actions").alias("action_count"),
        F.when(waits, payload).alias("payload"),
        F.when(~waits, "auto").alias("decided_by"),
        F.when(~waits, as_of).alias("decided_at"),
        F.when(~waits, "Auto-approved: risk below threshold").alias("decision_note"),
        as_of.alias("created_at"),
        F.when(waits, as_of + F.expr(f"INTERVAL {EXPIRY_HOURS} HOURS")).alias("expires_at"),
    )


def pending_approvals(requests: DataFrame, run_id: str | None = None) -> DataFrame:
    """Open requests, the newest first."""
    rows = requests.where("status = 'pending'")
    return (rows if run_id is None else rows.where(F.col("run_id") == run_id)).orderBy(F.desc("created_at"), "approval_id")


def is_approved(requests: DataFrame) -> DataFrame:
    """(document_id, approved): whether any request of a document is approved."""
    return requests.groupBy("document_id").agg(F.bool_or(F.col("status") == "approved").alias("approved"))


def audit_events(rows: DataFrame, event: str, entity_type: str, entity_id: Column, actor: str, payload: Column | None, at: Column) -> DataFrame:
    """(event_type, entity_type, entity_id, actor, payload, created_at): one event per row, to be appended to the log."""
    told = F.to_json(payload) if payload is not None else F.lit(None).cast("string")
    return rows.select(
        F.lit(event).alias("event_type"), F.lit(entity_type).alias("entity_type"), entity_id.alias("entity_id"), F.lit(actor).alias("actor"), told.alias("payload"), at.alias("created_at")
    )


def decide(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requests with their latest decision of the log (approval_id, status, decided_by, decided_at); unknown ids change nothing."""
    last = latest(decisions.select("approval_id", "status", "decided_by", "decided_at"), "approval_id", "decided_at", "status")
    d = last.select("approval_id", F.col("status").alias("new_status"), F.col("decided_by").alias("new_by"), F.col("decided_at").alias("new_at"))
    out = requests.join(d, "approval_id", "left")
    put = {"status": F.coalesce("new_status", "status"), "decided_by": F.coalesce("new_by", "decided_by")}
    if "decided_at" in requests.columns:
        put["decided_at"] = F.coalesce("new_at", "decided_at")
    else:
        put["decided_at"] = F.col("new_at")
    return out.withColumns(put).drop("new_status", "new_by", "new_at")


def expire(requests: DataFrame, now: Column) -> DataFrame:
    return requests.withColumn("status", F.when((F.col("status") == "pending") & (now > F.col("expires_at")), "expired").otherwise(F.col("status")))


def run_counters(outcomes: DataFrame) -> DataFrame:
    """processed, duplicate and error counts of (parsed, scored, duplicate, error)."""
    return outcomes.agg(
        F.count_if(F.col("parsed") & F.col("scored")).alias("processed"), F.count_if("duplicate").alias("duplicates"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )
