from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cases, ledger, networks, state
from ledgerlens.sources import readers, sinks

AT = "2024-01-01 00:00:00"


def test_verification_and_status(spark):
    at = F.lit(AT).cast("timestamp")
    s = spark.createDataFrame([("1", True, "x"), ("2", False, None), ("3", None, None)], "case_id string, email_verified boolean, google_status string").withColumns({"verified_at": F.lit(None).cast("timestamp"), "last_checked_at": F.lit(None).cast("timestamp")})
    done, events = state.verified(s, at)
    assert {r["case_id"]: r["google_status"] for r in done.collect()} == {"1": "x", "2": "verified", "3": "verified"}
    assert {r["case_id"] for r in events.collect()} == {"2", "3"}
    moved, event = state.external_status(s, "2", "resolved", at)
    assert event.first()["event_type"] == "google_status_resolved" and moved.where("google_status = 'resolved'").count() == 1
    with pytest.raises(ValueError):
        state.external_status(s, "2", "odd", at)


def test_cases_edits_and_liveness(spark):
    at = F.lit(AT).cast("timestamp")
    new = state.new_cases(spark.createDataFrame([("b",), ("a",)], "title string"), 7, at)
    assert {r["title"]: r["case_code"] for r in new.collect()} == {"a": "CASE-2026-000008", "b": "CASE-2026-000009"}
    edits = state.profile_edits(spark.createDataFrame([(1, None)], "id long, status string"), at)
    assert edits.first()["remediation_track"] == "MAPS_EDIT" and edits.first()["status"] == "proposed"
    loc = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    checks = spark.createDataFrame([(1, "REMOVED", {"k": "v"})], "id long, status string, details map<string,string>")
    live = state.with_liveness(loc, checks, at)
    assert {r["id"]: r["liveness_status"] for r in live.collect()} == {1: "REMOVED", 2: None} and [r["id"] for r in state.untested(live, 5).collect()] == [2]
    targets = spark.createDataFrame([("a", 1)], "name string, kvk int")
    assert state.saved_target(targets, spark.createDataFrame([("a", 2)], "name string, kvk int")).collect()[0]["kvk"] == 2


def test_ledger(spark):
    at = F.lit(AT)
    seen = spark.createDataFrame([(2, 5, "b", None), (1, 5, "a", 9)], "seq int, business_id long, observation string, case_id long")
    evidence, findings = ledger.recorded(seen, 41, 100, at)
    got = {r["observation"]: r for r in evidence.collect()}
    assert got["a"]["evidence_code"] == "EVD-2026-000042" and got["b"]["id"] == 102 and got["a"]["case_id"] == 9
    assert cases.evidence_intact(evidence).where("not intact").isEmpty()
    assert {(r["status"], r["supporting_evidence_ids"][0]) for r in findings.collect()} == {("POTENTIAL", 101), ("POTENTIAL", 102)}
    assert [r["id"] for r in ledger.listed(evidence, "business_id", 5).collect()] == [102, 101]
    assert ledger.recorded(seen.limit(0), 0, 0, at)[0].isEmpty()


def test_case_summary_of_known_and_unknown_cases(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    known, biz = table([(1,)], "id long"), table([(10, "x"), (11, "y")], "id long, name string")
    links, of_case = table([(1, 10), (1, 10), (2, 11)], "case_id long, business_id long"), table([(1, 1), (2, 2), (None, 3)], "case_id long, id long")
    counts = lambda case: {r["section"]: r["n"] for r in ledger.section_counts(ledger.case_summary(case, known, biz, links, of_case, of_case, of_case)).collect()}
    assert counts(1) == {"case": 1, "businesses": 1, "evidence": 1, "submissions": 1, "outcomes": 1}
    assert set(counts(2).values()) == {0}


def test_deleted_flagged_and_named_syndicates(spark):
    rows = spark.createDataFrame([(1, "F"), (2, None), (3, "O")], "id long, status string")
    assert {r["id"] for r in sinks.deleted(rows, F.col("status") == "F").collect()} == {2, 3}
    dossier = spark.createDataFrame([("None",), (None,), ("Stuffed",)], "policy_violation_details string")
    assert [r["is_fraud"] for r in readers.flagged(dossier).collect()] == [False, True, True]
    p = spark.createDataFrame([(1, "085 123 4567", "Delft"), (2, None, "Delft")], "id long, phone string, city string")
    members = spark.createDataFrame([("ring", 1), ("ring", 1), ("ring", 2)], "syndicate string, id long")
    got = {r["syndicate"]: r for r in networks.syndicate_rows(members, p, {"ring": ("A", "HIGH"), "empty": ("B", "LOW")}).collect()}
    assert (got["ring"]["locations_count"], got["ring"]["phone_blocks"], got["ring"]["towns"], got["empty"]["locations_count"]) == (2, 1, 1, 0)


def test_evidence_codes_are_those_of_the_sql_beyond_six_digits(spark):
    import duckdb

    from ledgerlens.plans import catalog

    numbers = [8, 999_999, 1_000_000, 1_000_009, 23_456_789]
    codes = spark.createDataFrame([(f"EVD-2026-{n:06d}",) for n in numbers], "c string")
    got = [r[0] for r in codes.select(catalog._sql_code(codes["c"])).collect()]  # noqa: SLF001
    assert got == [duckdb.connect().execute(f"SELECT 'EVD-2026-' || lpad(CAST({n} AS VARCHAR), 6, '0')").fetchone()[0] for n in numbers]


def _two_categories(spark, d):
    """Reviewed listings in place of the catalogue's: 1,011 batches of one category, two of another."""
    return spark.range(20_260).select(
        "id", F.when(F.col("id") < 20_220, "a-b").otherwise("c").alias("violation_category"), F.lit("ready_for_review").alias("review_status"),
        F.lit(True).alias("is_reportable"), F.array(F.lit("s")).alias("evidence_signals"),
    )


#: Batch ids of those as the catalogue's SQL writes them.
BATCHED = "SELECT id, c || '-' || lpad(CAST((row_number() OVER (PARTITION BY c ORDER BY id) - 1) // 20 + 1 AS VARCHAR), 3, '0') AS batch_id FROM (SELECT range AS id, CASE WHEN range < 20220 THEN 'a-b' ELSE 'c' END AS c FROM range(20260))"


def test_batch_ids_beyond_three_digits_are_those_of_the_sql(spark, monkeypatch):
    import duckdb

    from ledgerlens.plans import catalog

    monkeypatch.setattr(catalog, "_reviewed", _two_categories)
    got = [tuple(r) for r in catalog.QUERIES["campaign_batches"](spark, "").select("id", "batch_id").orderBy("id").collect()]
    assert got == duckdb.connect().execute(f"{BATCHED} ORDER BY id").fetchall()
    assert cases.batches(_two_categories(spark, "")).select("batch_id").distinct().count() == 1_013  # the operator's stay whole


def test_the_manifest_counts_batches_by_the_ids_of_the_sql(spark, monkeypatch):
    import duckdb

    from ledgerlens.plans import catalog

    monkeypatch.setattr(catalog, "_reviewed", _two_categories)
    got = [tuple(r) for r in catalog.QUERIES["campaign_manifest"](spark, "").select("batch_id", "locations").orderBy("batch_id").collect()]
    assert got == duckdb.connect().execute(f"SELECT batch_id, count(*) FROM ({BATCHED}) GROUP BY 1 ORDER BY 1").fetchall()
    assert sum(n for _, n in got) == 20_260 and cases.manifest(cases.batches(_two_categories(spark, ""))).count() == 1_013
