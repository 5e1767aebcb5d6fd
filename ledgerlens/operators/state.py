"""Changes of row state, as DataFrames in and out: write the result to a new version and swap.

Mutable status is best kept as events (`sinks.latest_status`); these are the row-level forms.
`at` is always a parameter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import vocab
from ledgerlens.functions.score import abuse
from ledgerlens.operators.networks import numbered
from ledgerlens.sources.sinks import upsert


def saved_target(targets: DataFrame, new: DataFrame) -> DataFrame:
    """Targets with those of new in place of their namesakes."""
    return upsert(targets, new, ["name"])


def updated(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """df with columns set where the condition holds; null counts as not."""
    holds = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(holds, v).otherwise(F.col(c)) for c, v in values.items()})


def submission_status(submissions: DataFrame, case_id: str, status: str) -> DataFrame:
    return updated(submissions, F.col("case_id") == case_id, status=F.lit(status))


def verified(submissions: DataFrame, at: Column, case_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Submissions marked as verified, one case or all that are not, and an event for each."""
    open_ = ~F.coalesce(F.col("email_verified"), F.lit(False))
    chosen = (F.col("case_id") == case_id) if case_id is not None else open_
    events = submissions.where(F.coalesce(chosen, F.lit(False))).select("case_id").distinct().select(
        "case_id", F.lit("email_verified").alias("event_type"), F.lit("User confirmed verification link in email").alias("details"), at.alias("created_at")
    )
    return updated(submissions, chosen, email_verified=F.lit(True), verified_at=at, google_status=F.lit("verified")), events


def external_status(submissions: DataFrame, case_id: str, status: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Submissions with a case's external status, and the event."""
    if status not in vocab.EXTERNAL_STATUSES:
        raise ValueError(f"unknown status {status}")
    hit = F.col("case_id") == case_id
    events = submissions.where(hit).select("case_id").distinct().select("case_id", F.lit(f"google_status_{status}").alias("event_type"), F.lit("").alias("details"), at.alias("created_at"))
    return updated(submissions, hit, google_status=F.lit(status), last_checked_at=at), events


def case_status(cases: DataFrame, case_id: int, status: str, at: Column) -> DataFrame:
    if status not in vocab.CASE_STATUSES:
        raise ValueError(f"unknown status {status}")
    return updated(cases, F.col("id") == case_id, status=F.lit(status), updated_at=at)


def checked_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes of known types; others are refused when read."""
    known = F.col("outcome_type").isin(*vocab.OUTCOMES)
    return outcomes.withColumn("outcome_type", F.when(known, F.col("outcome_type")).otherwise(F.raise_error(F.concat(F.lit("unknown outcome "), F.col("outcome_type")))))


def new_cases(requests: DataFrame, existing: int, at: Column, order: str = "title", year: int = 2026) -> DataFrame:
    """Cases with codes after the `existing` ones, in status DISCOVERED."""
    placed = numbered(requests, [order], "n")
    return placed.withColumns({
        "case_code": F.format_string(f"CASE-{year}-%06d", F.col("n") + existing), "status": F.lit("DISCOVERED"), "created_at": at, "updated_at": at,
    }).drop("n")


def profile_edits(edits: DataFrame, at: Column) -> DataFrame:
    """Proposed edits with their defaults."""
    defaults = {"remediation_track": "MAPS_EDIT", "status": "proposed", "screenshot_path": "", "notes": ""}
    return edits.withColumns({c: F.coalesce(c, F.lit(v)) if c in edits.columns else F.lit(v) for c, v in defaults.items()}).withColumn("created_at", at)


def edit_status(edits: DataFrame, edit_id: int, status: str, at: Column, notes: str | None = None) -> DataFrame:
    more = {"notes": F.lit(notes)} if notes is not None else {}
    return updated(edits, F.col("id") == edit_id, status=F.lit(status), last_verified_at=at, **more)


def with_liveness(locations: DataFrame, checks: DataFrame, at: Column) -> DataFrame:
    """Locations with liveness columns (added if absent) from checks(id, status, details)."""
    for c in ("liveness_status", "liveness_details"):
        locations = locations if c in locations.columns else locations.withColumn(c, F.lit(None).cast("string"))
    locations = locations if "liveness_checked_at" in locations.columns else locations.withColumn("liveness_checked_at", F.lit(None).cast("timestamp"))
    found = checks.select("id", F.col("status").alias("__s"), F.to_json("details").alias("__d"))
    hit = F.col("__s").isNotNull()
    return updated(locations.join(found, "id", "left"), hit, liveness_status=F.col("__s"), liveness_details=F.col("__d"), liveness_checked_at=at).drop("__s", "__d")


def untested(locations: DataFrame, limit: int) -> DataFrame:
    return locations.where(F.coalesce("liveness_status", F.lit("untested")) == "untested").orderBy("id").limit(limit)


def risk_profile(locations: DataFrame, shown: int = 10) -> tuple[DataFrame, DataFrame]:
    """One row with the number and mean abuse score of a target's listings, and the first `shown` of them."""
    scored = abuse(locations)
    mean = scored.agg(F.count(F.lit(1)).alias("locations"), F.round(F.avg("abuse.overall_score"), 1).alias("average_score"))
    return mean, scored.orderBy("id").limit(shown).select("id", "name", "city", "abuse.overall_score", "abuse.confidence")


def risk_profiles(locations: DataFrame) -> DataFrame:
    """target_name, locations, average_score of every target."""
    return abuse(locations).groupBy("target_name").agg(F.count(F.lit(1)).alias("locations"), F.round(F.avg("abuse.overall_score"), 1).alias("average_score"))


def with_location(locations: DataFrame, target: str, document: dict[str, object]) -> DataFrame:
    """locations(id, target_name, data) with one more JSON document of a target."""
    return _appended(locations, {"target_name": F.lit(target), "data": F.lit(json.dumps(document))})


def with_event(events: DataFrame, case_id: str, event_type: str, at: Column, details: str = "") -> DataFrame:
    """The event log with one more entry."""
    return _appended(events, {"case_id": F.lit(case_id), "event_type": F.lit(event_type), "details": F.lit(details), "created_at": at})


def _appended(table: DataFrame, row: dict[str, Column]) -> DataFrame:
    one = table.sparkSession.range(1).select(*[c.alias(k) for k, c in row.items()])
    if "id" in table.columns:
        one = one.join(table.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")), how="cross")  # one row each
    return table.unionByName(one, allowMissingColumns=True)
