"""The case ledger: evidence with its finding, lists by owner, and the summary of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.cases import evidence_hash
from ledgerlens.operators.networks import numbered

#: What an observation has where nothing else is said (fixed values).
DEFAULTS = {"evidence_type": "MAPS_PROFILE", "source_url": "", "source_type": "GOOGLE_MAPS", "policy_id": "GBP-POL-NAME-01", "confidence": "HIGH", "screenshot_path": ""}


def recorded(observations: DataFrame, existing: int, top_id: int, at: Column, order: str = "seq", year: int = 2026) -> tuple[DataFrame, DataFrame]:
    """(evidence, findings) to append for new observations, in the order of a unique column.

    observations: order, business_id, observation and any of DEFAULTS, case_id, network_id,
    reasoning_summary. Codes go on after the `existing` rows, ids after top_id. Every piece
    of evidence has the hash of its parts and one finding in status POTENTIAL.
    """
    of = lambda c: F.col(c) if c in observations.columns else F.lit(None)
    filled = {c: F.coalesce(of(c).cast("string"), F.lit(v)) for c, v in DEFAULTS.items()}
    filled |= {c: of(c).cast("long") for c in ("case_id", "network_id")} | {"reasoning_summary": F.nullif(of("reasoning_summary").cast("string"), F.lit(""))}
    placed = numbered(observations.withColumns(filled), [order], "__n").withColumns({"id": F.col("__n") + top_id, "captured_at": at})
    evidence = placed.select(
        "id", F.format_string(f"EVD-{year}-%06d", F.col("__n") + existing).alias("evidence_code"), "case_id", "business_id", "network_id", "evidence_type", "source_url", "source_type",
        "captured_at", "observation", F.concat(F.lit("Supports evaluation of "), "policy_id").alias("policy_relevance"), "confidence", "screenshot_path",
        evidence_hash(*[F.col(c) for c in ("business_id", "evidence_type", "observation", "source_url", "captured_at")]).alias("sha256_hash"), F.lit(True).alias("is_immutable"),
    )
    findings = placed.select(
        "business_id", "policy_id", F.lit("POTENTIAL").alias("status"), "confidence", F.col("observation").alias("observation_text"),
        F.coalesce("reasoning_summary", F.concat(F.lit("Automated observation logged via "), "evidence_type")).alias("reasoning_summary"), F.array("id").alias("supporting_evidence_ids"), F.col("captured_at").alias("created_at"),
    )
    return evidence, findings


def listed(table: DataFrame, owner: str, key: int, order: str = "id") -> DataFrame:
    """Rows of one business, network or case, newest first."""
    return table.where(F.col(owner) == key).orderBy(F.desc(order))


def newest(table: DataFrame, status: str | None = None, order: str = "created_at", tie: str = "id") -> DataFrame:
    """Targets, submissions or edits, newest first; of one status if named."""
    return (table.where(F.col("status") == status) if status is not None else table).orderBy(F.desc(order), F.desc(tie))


def case_summary(case_id: int, cases: DataFrame, biz: DataFrame, links: DataFrame, evidence: DataFrame, submissions: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """A case with its businesses, evidence, submissions and outcomes; sections of an unknown case are empty.

    A business that is linked to the case several times comes once.
    """
    case = cases.where(F.col("id") == case_id)
    known = case.select(F.col("id").alias("case_id"))
    linked = links.join(known, "case_id", "left_semi").select(F.col("business_id").alias("id"))
    of = lambda t: t.join(F.broadcast(known), "case_id", "left_semi")  # noqa: E731 - one row
    return {"case": case, "businesses": biz.join(linked, "id", "left_semi"), "evidence": of(evidence), "submissions": of(submissions), "outcomes": of(outcomes)}


def section_counts(sections: dict[str, DataFrame]) -> DataFrame:
    """section, n of a summary."""
    counted = [rows.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n")) for name, rows in sections.items()]
    every = counted[0]
    for part in counted[1:]:
        every = every.union(part)
    return every
