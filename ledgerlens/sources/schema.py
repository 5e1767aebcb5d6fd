"""Table schemas as DDL; constraints that Parquet lacks are checked by `violations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES: dict[str, str] = {
    "businesses": "id long, place_id string, google_maps_url string, name string, raw_name string, normalized_name string, phone string, normalized_phone string, phone_prefix string, domain string, canonical_url string, address string, street string, house_number string, postal_code string, city string, country string, category string, rating double, review_count int, latitude double, longitude double, service_area string, description string, opening_hours string, source_status string, suspicion_score int, created_at timestamp, updated_at timestamp",
    "business_snapshots": "id long, business_id long, snapshot_timestamp timestamp, name string, address string, phone string, website string, category string, status_visible string, raw_payload_json string, sha256_hash string, created_at timestamp",
    "networks": "id long, network_code string, name string, network_type string, suspicion_score int, score_breakdown struct<total_score:int,severity:string,network_type:string,reasons:array<struct<points:int,reason:string>>,disclaimer:string>, member_count int, address_count int, domain_count int, phone_count int, status string, created_at timestamp, updated_at timestamp",
    "network_members": "id long, network_id long, business_id long, membership_strength double, added_at timestamp",
    "relationships": "id long, source_business_id long, target_business_id long, relationship_type string, weight double, details map<string,string>, created_at timestamp",
    "policies": "policy_id string, category string, title string, description string, official_source_url string, source_date date, last_verified date, severity string, applicable_to array<string>, examples array<string>, counter_examples array<string>, created_at timestamp",
    "evidence": "id long, evidence_code string, case_id long, business_id long, network_id long, evidence_type string, source_url string, source_type string, captured_at timestamp, observation string, policy_relevance string, confidence string, screenshot_path string, sha256_hash string, is_immutable boolean, created_at timestamp",
    "policy_findings": "id long, business_id long, policy_id string, status string, confidence string, observation_text string, reasoning_summary string, supporting_evidence_ids array<long>, created_at timestamp",
    "cases": "id long, case_code string, network_id long, title string, priority string, status string, reviewer_name string, notes string, created_at timestamp, updated_at timestamp",
    "case_businesses": "id long, case_id long, business_id long, role string, created_at timestamp",
    "submissions": "id long, case_id long, submission_type string, google_case_id string, submission_payload_csv string, filled_screenshot_path string, result_screenshot_path string, status string, submitted_at timestamp, created_at timestamp",
    "outcomes": "id long, case_id long, business_id long, outcome_type string, description string, verified_at timestamp, screenshot_proof_path string, created_at timestamp",
    "monitoring_events": "id long, business_id long, event_type string, previous_val string, new_val string, description string, occurred_at timestamp, created_at timestamp",
    "review_actions": "id long, case_id long, business_id long, finding_id long, reviewer string, action string, reason string, created_at timestamp",
    "false_positive_logs": "id long, business_id long, finding_id long, reviewer string, dismissal_reason string, context_notes string, created_at timestamp",
}
#: Columns whose values are unique together.
UNIQUE: dict[str, list[str]] = {
    "businesses": ["place_id"], "business_snapshots": ["business_id", "snapshot_timestamp"], "networks": ["network_code"],
    "network_members": ["network_id", "business_id"], "relationships": ["source_business_id", "target_business_id", "relationship_type"],
    "evidence": ["evidence_code"], "cases": ["case_code"], "case_businesses": ["case_id", "business_id"], "policies": ["policy_id"],
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """The table without rows; unknown names are refused."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table}")
    return spark.createDataFrame([], TABLES[table])


def violations(df: DataFrame, table: str) -> DataFrame:
    """Key values that occur more than once."""
    keys = UNIQUE[table]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
