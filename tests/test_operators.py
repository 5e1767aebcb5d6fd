from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import sanitize
from ledgerlens.operators import cases, linkage, monitoring, networks, pages, read_model, state
from ledgerlens.operators.components import connected_components
from ledgerlens.sources import migration, readers, schema, sinks


def reach(pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components_are_the_transitive_closure(spark, pairs):
    for small in (200_000, 2):  # in one task, and by contraction
        got = connected_components(spark.createDataFrame(pairs, "a long, b long"), small=small)
        assert {r["id"]: r["component"] for r in got.collect()} == reach(pairs)


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(chain).where("component <> 0").count() == 0
    assert connected_components(chain, small=50).where("component <> 0").count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def biz(spark, rows):
    return linkage.businesses(spark.createDataFrame(rows, "id long, name string, city string, category string, address string, phone string, website string, target_name string"))


ROWS = [
    (1, "Alfa B.V.", "Delft", "", "Laan 1, 1111 AA Delft", "020-1234567", None, "T"), (2, "Beta", "Delft", "", "Laan 2, 1111 AA Delft", "+31 20 1234567", "https://b.nl/x", "T"),
    (3, "Gamma", "Delft", "", "Laan 3, 1111 AB Delft", None, "http://www.b.nl", "T"), (4, "Delta", "Breda", "", "Kade 9, 2222 BB Breda", "030-7654321", "", "T"), (5, None, None, None, None, None, None, None),
]


def test_edges_are_canonical_and_networks_chain(spark):
    b = biz(spark, ROWS)
    keyed = linkage.keys(b)
    edges = {(r[0], r[1], r[2]) for r in linkage.edges(keyed).collect()}
    assert edges == {(1, 2, "SAME_PHONE"), (2, 3, "SAME_DOMAIN"), (1, 2, "SHARED_VOIP_BLOCK")}
    member = networks.members(keyed)
    assert {r["id"]: r["component"] for r in member.collect()} == {1: 1, 2: 1, 3: 1}
    n = networks.coded(networks.scored(member, b)).first()
    assert (n["network_code"], n["member_count"], n["domain_count"], n["phone_count"], n["suspicion_score"]) == ("NETWORK-00001", 3, 1, 1, 53)
    assert {r["id"]: r["suspicion_score"] for r in networks.propagated(b, member, networks.scored(member, b)).collect()}[4] == 0
    assert networks.graph_edges(member, b).where("relation = 'USES_DOMAIN'").count() == 2
    assert read_model.induced(linkage.edges(keyed), spark.createDataFrame([(1,), (2,)], "id long")).count() == 2


def test_duplicates_exempt_branches_at_other_addresses(spark):
    rows = [(1, "Laan 1", "020", "a.nl", False), (2, "Laan 1", "020", None, False), (3, "Kade 2", "030", "c.nl", True), (4, "Kade 3", "030", "c.nl", False)]
    got = linkage.duplicates(spark.createDataFrame(rows, "id long, address string, phone string, website string, official_branch boolean"))
    assert {r["id"]: r["score"] for r in got.collect()} == {1: 30, 2: 30}


def test_recurrence_flags(spark):
    s = "id long, normalized_phone string, domain string, postal_code string"
    gone = spark.createDataFrame([(1, "020", "a.nl", "1111 AA")], s)
    every = spark.createDataFrame([(1, "020", "a.nl", "1111 AA"), (2, "020", "b.nl", ""), (3, "030", None, None)], s)
    assert [tuple(r) for r in linkage.recurrence(gone, every).collect()] == [(1, 2, True, False, False)]


def test_changes_and_latest(spark):
    rows = [(1, 1, "Foo"), (1, 2, "FOO"), (1, 3, "Bar"), (1, 4, None)]
    snaps = spark.createDataFrame(rows, "business_id long, snapshot_timestamp int, name string")
    got = monitoring.changes(snaps, ["name"]).collect()
    assert [(r["event_type"], r["previous_val"], r["new_val"]) for r in got] == [("NAME_CHANGED", "FOO", "Bar")]
    assert monitoring.latest(snaps).first()["snapshot_timestamp"] == 4


def test_liveness_default_and_compatible(spark):
    df = spark.createDataFrame([("https://m/place/x", "Open", "Alfa", None, "Alfa")], "u string, b string, t string, a string, e string")
    cols = [F.col(c) for c in "ubtae"]
    r = df.select(monitoring.liveness(*cols).alias("x"), monitoring.liveness(*cols, compat=True).alias("y")).first()
    assert (r["x"]["status"], r["y"]["status"]) == ("ACTIVE_ADDRESS_HIDDEN", "CONFIRMED_REMOVED")


def test_batches_follow_up_and_colocation(spark):
    rows = [(i, "ready_for_review", True, "virtual_office" if i % 2 else "odd", ["x"]) for i in range(50)]
    loc = spark.createDataFrame(rows, "id long, review_status string, is_reportable boolean, violation_category string, evidence_signals array<string>")
    m = {r["batch_id"]: (r["route"], r["locations"]) for r in cases.manifest(cases.batches(loc)).collect()}
    assert m == {"odd-001": ("manual_review", 20), "odd-002": ("manual_review", 5), "virtual_office-001": ("google_redressal", 20), "virtual_office-002": ("google_redressal", 5)}
    with pytest.raises(ValueError):
        cases.batches(loc, 0)
    subs = spark.createDataFrame([(1, "SUBMITTED", "not-a-date"), (2, "submitted", "2024-01-30 00:00:00"), (3, "closed", "2020-01-01 00:00:00")], "id long, status string, created_at string")
    assert [r["id"] for r in cases.follow_up(subs, F.lit("2024-02-01 00:00:00").cast("timestamp")).collect()] == [1]
    branches = spark.createDataFrame([("a", "Delft", "Laan 1 Delft"), ("b", "Breda", "laan 1 delft"), ("c", "Ede", "Kade 3 Ede")], "slug string, city string, address string")
    assert {r["slug"]: r["action"] for r in cases.colocation(branches).collect()} == {"a": "MERGE_DUPLICATE", "b": "REMOVE_OR_MERGE", "c": "RENAME"}


def test_evidence_is_recomputed(spark):
    row = spark.createDataFrame([(1, "L", "o", "u", "t")], "business_id long, evidence_type string, observation string, source_url string, captured_at string")
    good = row.withColumn("sha256_hash", cases.evidence_hash(*[F.col(c) for c in row.columns]))
    assert cases.evidence_intact(good).first()["intact"] and not cases.evidence_intact(good.withColumn("observation", F.lit("z"))).first()["intact"]


PAGE = """<html><head><title> T </title><script type="application/ld+json">{"@type": "LocalBusiness", "name": "Alfa", "telephone": "020", "address": {"streetAddress": "Laan 1", "addressLocality": "Delft", "postalCode": "1111 AA"}}</script></head>
<body><h1>Alfa <b>Fit</b></h1>GTM-ABC1 KvK: 12345678 bel 085-123 4567, eigen monteurs <a href="https://goo.gl/x">kaart</a><a href="/branches/den-bosch/">x</a></body></html>"""


def test_pages(spark):
    p = spark.createDataFrame([("https://www.a.nl/", PAGE), ("https://b.nl", "GTM-ABC1"), ("https://c.nl", None)], "url string, html string")
    f = pages.footprints(p)
    a = f.where("domain = 'a.nl'").first()
    assert (a["title"], a["gtm"], a["kvk"], a["phones"], a["deceptive_claims"]) == ("T", ["GTM-ABC1"], ["12345678"], ["085-123 4567"], ["Claimt eigen monteurs"])
    assert {r["domain"] for r in pages.matching(f).collect()} == {"a.nl", "b.nl"} and pages.matching(f, kvk="12345678").count() == 1
    assert pages.shared_id_clusters(f).groupBy("cluster").count().first()["count"] == 2
    m = pages.metadata(p).where("schema_name <> ''").first()
    assert (m["h1"], m["schema_name"], m["address"], m["maps_url"]) == ("Alfa Fit", "Alfa", "Laan 1, 1111 AA Delft", "https://goo.gl/x")
    assert pages.branch_links(p, "/branches/", "a.nl").first()["city_guess"] == "Den Bosch"


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "T", '{"title": "A", "telephone": "020", "odd": 1}'), (2, "T", "not json")], "id long, target_name string, data string")
    docs = readers.documents(rows)
    assert [(r["id"], r["name"], r["phone"]) for r in docs.collect()] == [(1, "A", "020")]
    assert readers.formatted(docs).first()["website"] == "unknown"
    assert schema.empty(spark, "cases").count() == 0
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.write_csv(old, f"file://{tmp_path}/x")
    assert readers.csv(spark, f"file://{tmp_path}/x").count() == 2
    with pytest.raises(ValueError):
        sinks.write_csv(old.limit(0), f"file://{tmp_path}/y", allow_empty=False)
    assert "not found" in sinks.network_report({}, old, old)
    assert len(sinks.explanation(["x" * 300] * 5)) <= 1000


def test_migration_config_and_reports(spark, tmp_path):
    from ledgerlens.plans import config
    from ledgerlens.sources import migration

    rows = [(1, "T", '{"title": "A B.V.", "telephone": "+31 20 1234567", "address": "Laan 1, 1111 AA Delft", "website": "www.a.nl"}'), (2, "T", '{"title": "A B.V.", "telephone": "020", "address": "Laan 1, 1111 AA Delft"}')]
    docs = readers.documents(spark.createDataFrame(rows, "id long, target_name string, data string"))
    made = migration.businesses(docs)
    r = made.first()
    assert made.count() == 1 and (r["id"], r["normalized_phone"], r["house_number"], r["normalized_name"], r["domain"]) == (1, "0201234567", "1", "a", "a.nl")
    assert migration.snapshots(docs.withColumn("snapshot_timestamp", F.lit("2024-01-01").cast("timestamp")), made).count() == 1  # unique by business and time
    snaps = migration.snapshots(docs.withColumn("snapshot_timestamp", F.timestamp_seconds("id")), made)
    assert snaps.count() == 2 and snaps.select("business_id").distinct().first()[0] == 1
    assert migration.verification(made).first()["phones"] == 1
    assert config.load("/nowhere")["batch_size"] == 20
    (tmp_path / "c.json").write_text('{"batch_size": 5}')
    assert config.load(str(tmp_path / "c.json"))["batch_size"] == 5
    hubs = spark.createDataFrame([("H", 6, 2, ["a", "b"])], "hub_name string, total_profiles int, unique_trades_count int, sample_trades array<string>")
    assert "H: 6 profiles" in sinks.intelligence_report({"total_locations": 6}, hubs)
    named = networks.named_syndicates(spark.createDataFrame([(1, "Skibox NL"), (2, "x")], "id long, target_name string"), {"boxes": ["Skibox", "Topspace"]})
    assert [tuple(r) for r in named.collect()] == [("boxes", 1)]


def test_hot_key_classes_are_linear(spark):
    """Half of all listings share one phone: one row a carrier, and as many links as pairs would give."""
    rows = [(i, f"Naam {i}", "Delft", "", f"Laan {i}, {1000 + i} AA Delft", "020-1234567" if i % 2 else None, None, "T") for i in range(400)]
    keyed = linkage.keys(biz(spark, rows))
    found = linkage.classes(keyed.where("type = 'SAME_PHONE'")).collect()
    assert len(found) == 200 and {(r["head"], r["n_links"]) for r in found} == {(1, 199)}
    b = biz(spark, rows)
    links = linkage.recurrence_links(b.where("id < 100"), b)
    by = {r["id"]: r["phone_links"] for r in links.collect()}
    assert len(by) == 200 and by[1] == 49 and by[399] == 50
    assert linkage.recurrence_events(links, F.current_timestamp()).select("event_type").distinct().collect()[0][0] == "REINCARNATION_SIGNAL"


def test_policies_are_sound_and_faults_are_named(spark):
    good = readers.policies(spark)
    assert readers.policy_faults(good).count() == 0
    bad = good.limit(1).withColumns({"severity": F.lit("LOW"), "source_date": F.lit("2024-13-01"), "examples": F.array(F.lit(" "))})
    assert readers.policy_faults(bad).first()["broken"] == ["source_date", "severity", "examples"]
    changed = good.where("policy_id = 'GBP-POL-DUP-01'").withColumn("title", F.lit("new"))
    out = readers.upserted_policies(good.withColumn("created_at", F.current_timestamp()), changed, F.current_timestamp())
    assert out.count() == good.count() and out.where("title = 'new'").count() == 1


def test_sanitizer_knows_every_service_and_town(spark):
    rows = [("Vermeer | Laser ontharen",), ("Boerhof - Bomen snoeien Arnhem Noord",), ("Financiele planning Haarlem Zuid",)]
    none = F.lit(None).cast("string")
    got = [r[0] for r in spark.createDataFrame(rows, "name string").select(sanitize.sanitized(F.col("name"), none, none, none).alias("s")).collect()]
    assert got[0]["action"] == "RENAME" and got[0]["clean_name"] == "Vermeer"
    assert got[1]["clean_name"] == "Boerhof" and got[2]["action"] in ("REMOVE", "RENAME")


def test_ingest_inserts_updates_and_snapshots(spark):
    existing = spark.createDataFrame([(1, "p1", "Alfa", "old", None, None), (2, None, "Beta", None, "1", None)], "id long, place_id string, name string, address string, phone string, canonical_url string")
    rows = [(1, "p1", "Anders", "new", "", None), (2, None, "Beta", "adres", "2", None), (3, None, "Beta", None, "3", None), (4, "p4", "Gamma", "x", "4", "w"), (5, "p4", "Gamma 2", "y", None, None), (6, None, None, "z", "6", None)]
    raw = spark.createDataFrame(rows, "seq long, place_id string, title string, formatted_address string, phone string, domain string")
    fields = readers.profile_fields(raw, F.lit("2024-01-01"))
    assert fields.where("seq = 6").first()["business_name"] == "unknown" and fields.where("seq = 4").first()["website"] == "w"
    kept, snapshots, counters = cases.ingested(existing, fields, F.lit("2024-01-01").cast("timestamp"))
    assert counters.first().asDict() == {"snapshots_created": 5, "inserted_businesses": 2, "updated_businesses": 3}
    by = {r["id"]: (r["place_id"], r["name"], r["address"], r["phone"]) for r in kept.collect()}
    assert by == {1: ("p1", "Alfa", "new", None), 2: (None, "Beta", "adres", "2"), 3: (None, "Beta", None, "3"), 4: ("p4", "Gamma", "y", "4")}
    assert snapshots.count() == 5 and snapshots.where("length(sha256_hash) = 64").count() == 5


def test_details_locations_and_events(spark):
    b = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    child = spark.createDataFrame([(i, 1, f"2024-01-{i % 9 + 1:02d}") for i in range(450)], "id long, business_id long, snapshot_timestamp string")
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "source_business_id long, target_business_id long")
    found = read_model.business_detail(1, b, child, child, child, links)
    assert found["snapshots"].count() == 450 and found["snapshots"].first()["snapshot_timestamp"] == "2024-01-09"
    assert found["relationships"].count() == 2 and read_model.business_detail(9, b, child, child, child, links) is None
    locations = spark.createDataFrame([(4, "T", "{}")], "id long, target_name string, data string")
    assert state.with_location(locations, "T", {"name": "x"}).orderBy("id").collect()[1].asDict() == {"id": 5, "target_name": "T", "data": '{"name": "x"}'}
    events = spark.createDataFrame([], "case_id string, event_type string, details string, created_at timestamp")
    assert state.with_event(events, "c", "opened", F.current_timestamp()).first()["event_type"] == "opened"


def test_files_of_syndicates_and_chains(spark):
    prints = spark.createDataFrame([("loden-dak.nl", ["GTM-1"], [], ["x", "y"]), ("a.be", [], ["12345678"], [])], "domain string, gtm array<string>, kvk array<string>, deceptive_claims array<string>")
    rows = sinks.syndicate_rows(prints, "Noord").collect()
    assert rows[0][0] == "Loden Dak" and rows[0][4] == "KvK: Unregistered" and "x; y" in rows[0][5] and "Leadgen portal front" in rows[1][5]
    audits = spark.createDataFrame([("c", "u", "h", "s", "t", "p", "RENAME", "HIGH", ["a", "b"], "g")], ", ".join(f"{c} {'array<string>' if c == 'stuffed_parts' else 'string'}" for c in sinks.CHAIN_COLUMNS))
    assert sinks.chain_audit(audits).first()["stuffed_parts"] == "a | b" and sinks.rename_share(audits).first()["percent"] == "100.0"


def test_snapshots_stand_under_their_own_place(spark):
    rows = [(1, "T", '{"name": "A", "address": "x", "place_id": "p1"}'), (2, "T", '{"name": "A", "address": "x", "place_id": "p2"}')]
    docs = readers.documents(spark.createDataFrame(rows, "id long, target_name string, data string")).withColumn("snapshot_timestamp", F.lit("2024-01-01"))
    made = migration.businesses(docs)
    shots = migration.snapshots(docs, made).collect()
    assert {r["business_id"] for r in shots} == {1, 2} and {r["raw_payload_json"] for r in shots} == {r[2] for r in rows}
    subs = spark.createDataFrame([("T", "c1", "submitted", "2024"), ("T", "c1", "submitted", "2025"), ("U", "c2", "draft", "2024")], "target_name string, case_id string, status string, created_at string")
    found, kept = migration.cases_of(subs)
    assert migration.verification(made, migration.snapshots(docs, made), found, kept).first().asDict() | {"x": 0} == {"businesses": 2, "domains": 0, "phones": 0, "postal_codes": 0, "snapshots": 2, "cases": 2, "submissions": 3, "x": 0}


def test_listings_of_a_small_file_are_dealt_over_tasks(spark):
    from ledgerlens.plans.profiles import profiles

    found = profiles(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_gate_does_not_repeat_the_audit(spark):
    """The filter on an audit's columns reads them; pushed below, the audit would be worked out several times a row and its plan take minutes."""
    from ledgerlens.plans import catalog

    plan = cases.reportable(catalog._reviewed(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "ArrowEvalPython" not in plan and "transform" not in plan


def test_conditions_on_listings_stay_behind_the_deal(spark):
    """The one task that reads customer judges no listing, whatever is asked of them."""
    from ledgerlens.functions.normalize import any_contained
    from ledgerlens.operators import networks
    from ledgerlens.plans.profiles import profiles

    p = profiles(spark, "/root/testdata/sf0.001")
    for asked in (networks.syndicate(p, {"weena": "Weena"}, ["Target 3 "]), networks.named_syndicates(p, {"a": ["Target 7 "]}), p.where(any_contained(F.col("phone"), ["085"]))):
        scans = [line for line in asked._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "c_custkey" in line]
        assert not scans


def test_a_haystack_is_made_once_for_all_words(spark):
    from ledgerlens.functions.normalize import any_contained, first_contained

    made = []
    df = spark.createDataFrame([("Kerkstraat",), (None,), ("plein",)], "a string")
    for found in (any_contained, first_contained):
        asked = df.select(found(F.lower("a"), ["straat", "plein"]).alias("x"))
        inside = asked._jdf.queryExecution().analyzed().toString().split("lambdafunction(", 1)[1]
        assert "lower(a" not in inside[: inside.rindex("lambda")]
        made.append([r.x for r in asked.collect()])
    assert made == [[True, None, True], ["straat", None, "plein"]]
