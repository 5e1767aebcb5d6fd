"""Case report, franchise file, policy records, review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.plans import catalog
from ledgerlens.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_case_report(spark):
    cases = spark.createDataFrame([(1, "CASE-1", "Ring", "REPORTED", None, "ann")], "id long, case_code string, title string, status string, priority string, reviewer_name string")
    listings = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "case_id long, business_id long")
    sent = spark.createDataFrame([(k, 1, "2024-01-%02d" % k, None, "7-123" if k == 1 else None) for k in range(1, 4)] + [(9, 2, "2024-02-01", "X", "other")], "id long, case_id long, created_at string, status string, google_case_id string")
    seen = spark.createDataFrame([(1, 1, "PROFILE_REMOVED", None, "2024-02-01")], "id long, case_id long, outcome_type string, description string, verified_at string")
    text = sinks.case_report(1, cases, listings, sent, seen, shown=2)
    for part in ("# Case: CASE-1", "## Executive summary", "2 listings, 3 submissions, 1 outcomes", "2 of 3 rows.", "- PROFILE_REMOVED (2024-02-01): no description", "## Recommended action", sinks.REPORT_ACTION, "priority: none, reviewer: ann"):
        assert part in text
    assert "other" not in text and text.index("2024-01-03") < text.index("2024-01-02")
    bare = sinks.case_report(1, cases, listings.limit(0), sent.limit(0), seen.limit(0))
    assert "0 listings" in bare and "## Submissions" not in bare and "## Outcomes" not in bare
    assert "no case 4" in sinks.case_report(4, cases, listings, sent, seen)


def test_franchise_rows_of_bare_branches(spark):
    b = spark.createDataFrame([("a", "Delft", None, None, "Laan 1, Delft", None, "u")], "slug string, city string, h1 string, schema_name string, address string, telephone string, url string")
    judged = spark.createDataFrame([("a", "RENAME", [])], "slug string, action string, shared_with array<string>")
    r = sinks.franchise_rows(b, judged, "Keten").first()
    assert r.asDict() == dict(zip(sinks.FRANCHISE_COLUMNS, ["a", "Delft", "Keten | Delft", "", "RENAME", "Keywords added to the title", "Laan 1, Delft", None, "u", "Heading of the landing page: ''"], strict=True))


def test_policies_are_sound_and_told_apart(spark):
    p = readers.policies(spark)
    assert readers.policy_faults(p).count() == 0
    assert p.select("description").distinct().count() == p.count() == p.where(F.size("examples") > 0).count()


def test_review_queue_is_numbered_in_its_order(spark):
    rows = catalog.QUERIES["cluster_queue"](spark, SF).collect()
    by = sorted(rows, key=lambda r: int(r["cluster_id"].rpartition("-")[2]))
    assert [int(r["cluster_id"].rpartition("-")[2]) for r in by] == list(range(1, len(rows) + 1))
    ranks = [(-r["profiles"], -len(r["shared_indicators"].split(" | "))) for r in by]
    assert ranks == sorted(ranks)
