"""Read queries of a listing service: search, paging, detail, dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.monitoring import ACTIONS


def scan(table: DataFrame, where: str | None = None, order_by: list[str] | None = None, limit: int | None = None, offset: int = 0, params: dict[str, object] | None = None) -> DataFrame:
    """Generic scan: a SQL condition with named :parameters, order, offset, limit."""
    found = table.sparkSession.sql(f"SELECT * FROM {{t}} WHERE {where}", args=params or {}, t=table) if where else table
    if order_by:
        found = found.orderBy(*[F.expr(c[:-5]).desc() if c.lower().endswith(" desc") else F.expr(c) for c in order_by])
    if offset:
        found = found.offset(offset)
    return found.limit(limit) if limit is not None else found


def count(table: DataFrame, where: str | None = None, params: dict[str, object] | None = None) -> int:
    return scan(table, where, params=params).count()


def get(table: DataFrame, key: int, column: str = "id") -> dict[str, object] | None:
    row = table.where(F.col(column) == key).limit(1).first()
    return row.asDict(recursive=True) if row else None


def search(biz: DataFrame, text: str = "", city: str = "", min_score: int = 0) -> DataFrame:
    """Listings by score, text in name, address or domain, and city; ordered by score, then id."""
    if not 0 <= min_score <= 100:
        raise ValueError("min_score is 0 to 100")
    found = biz.where(F.col("suspicion_score") >= min_score)
    if text:
        found = found.where(F.col("name").ilike(f"%{text}%") | F.col("address").ilike(f"%{text}%") | F.col("domain").ilike(f"%{text}%"))
    if city:
        found = found.where(F.col("city").ilike(f"%{city}%"))
    return found.orderBy(F.desc("suspicion_score"), "id")


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of a sorted result and the total."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    return df.offset(offset).limit(limit), df.count()


def niche_filter(locations: DataFrame, niche: str = "", city: str = "") -> DataFrame:
    found = locations
    if niche:
        found = found.where(F.contains(F.lower("name"), F.lit(niche.lower())) | F.contains(F.lower("target_name"), F.lit(niche.lower())))
    if city:
        found = found.where(F.contains(F.lower(F.concat_ws("\n", "address", "name", "target_name")), F.lit(city.lower())))
    return found


def either_end(edges: DataFrame, business_id: int) -> DataFrame:
    return edges.where((F.col("source_business_id") == business_id) | (F.col("target_business_id") == business_id))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members(id)."""
    found = edges.join(members.select(F.col("id").alias("source_business_id")), "source_business_id", "left_semi")
    return found.join(members.select(F.col("id").alias("target_business_id")), "target_business_id", "left_semi")


def dashboard(biz: DataFrame, networks: DataFrame, cases: DataFrame, evidence: DataFrame, submissions: DataFrame, outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """One row of the nine counts of the front page."""
    every = F.count(F.lit(1))
    parts = [
        biz.agg(every.alias("total_businesses_scanned"), F.count_if(F.col("suspicion_score") >= 30).alias("potential_policy_issues")),
        networks.agg(every.alias("networks_detected")),
        cases.agg(F.count_if(F.col("priority").isin("HIGH", "CRITICAL")).alias("high_priority_cases"), F.count_if(F.col("status").isin("DISCOVERED", "NEEDS_REVIEW")).alias("cases_pending")),
        evidence.agg(every.alias("evidence_items")),
        submissions.agg(F.count_if(F.col("status") == "submitted").alias("cases_submitted")),
        outcomes.agg(F.count_if(F.col("outcome_type").isin(*ACTIONS)).alias("cases_with_observed_action")),
        events.agg(F.count_if(F.col("event_type") == "REINCARNATION_SIGNAL").alias("recurrence_signals")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, how="cross")  # one row each
    return out


def business_detail(business_id: int, biz: DataFrame, snapshots: DataFrame, evidence: DataFrame, findings: DataFrame, relationships: DataFrame) -> dict[str, DataFrame] | None:
    """A business and all its rows of the child tables: snapshots, evidence and findings newest first, relationships of either end."""
    found = biz.where(F.col("id") == business_id)
    if found.isEmpty():
        return None
    own = lambda t: t.where(F.col("business_id") == business_id)
    return {
        "business": found, "snapshots": own(snapshots).orderBy(F.desc("snapshot_timestamp"), F.desc("id")), "evidence": own(evidence).orderBy(F.desc("id")),
        "findings": own(findings).orderBy(F.desc("id")), "relationships": either_end(relationships, business_id),
    }


def network_detail(network_id: int, networks: DataFrame, members: DataFrame, biz: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame] | None:
    """A network, its businesses and its graph. members(network_id, business_id); nodes and edges carry the network as component."""
    found = networks.where(F.col("id") == network_id)
    if found.isEmpty():
        return None
    ids = members.where(F.col("network_id") == network_id).select(F.col("business_id").alias("id"))
    of = lambda t: t.where(F.col("component") == network_id)
    return {"network": found, "businesses": biz.join(ids, "id", "left_semi"), "nodes": of(nodes), "edges": of(edges)}


def newest_first(table: DataFrame, by: str = "id") -> DataFrame:
    """Target, submission and edit lists: the latest entry first."""
    return table.orderBy(F.desc(by))
