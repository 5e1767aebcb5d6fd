from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import normalize, score
from ledgerlens.functions.sanitize import generic, sanitize


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "digits"), [
    ("020-123 4567", "0201234567"), ("+31 20 1234567", "0201234567"), ("0031201234567", "0201234567"), ("+31 (0)20 1234567", "0201234567"),
    ("tel: 06 12345678 ext. 4", "0612345678"), ("31201234567", "0201234567"), ("+49 30 1234", ""), (None, ""), ("", ""),
])
def test_phone_digits(spark, raw, digits):
    assert one(spark, raw, normalize.phone)["digits"] == digits


def test_phone_parts_and_compatible_zero(spark):
    p = one(spark, "0855-123456", normalize.phone)
    assert (p["is_voip"], p["area_code"], p["pbx_prefix_6"], p["e164"]) == (True, "085", "085512", "+31855123456")
    assert one(spark, "+31 (0)20 1234567", lambda c: normalize.phone(c, trunk_zero=False))["digits"] == "00201234567"
    assert one(spark, "0412-345678", normalize.phone)["area_code"] == "0412"


def test_address(spark):
    a = one(spark, "Laan 12-B, 1234ab Breda", normalize.address)
    assert (a["postal_code"], a["house_number"], a["addition"], a["street"], a["city"], a["normalized_key"]) == ("1234 AB", "12", "B", "Laan", "Breda", "1234ab12b")
    b = one(spark, "Kade 3, Delft", normalize.address)
    assert (b["postal_code"], b["city"], b["street"]) == ("", "Delft", "Kade")
    assert one(spark, "Laan 1, 1111 AA Delft, Nederland", normalize.address)["city"] == "Delft"
    assert one(spark, None, normalize.address)["normalized_key"] == ""


def test_domain(spark):
    u = one(spark, "https://www.Foo.nl/x/?utm_source=a&id=1", normalize.domain)
    assert (u["domain"], u["subdomain"], u["canonical_url"]) == ("foo.nl", "", "https://www.foo.nl/x?id=1")
    assert one(spark, "shop.a.co.uk/b", normalize.domain)["domain"] == "a.co.uk"
    assert one(spark, "https://bücher.nl", lambda c: normalize.domain(c, international=True))["domain"] == "xn--bcher-kva.nl"


def test_name_and_overlap(spark):
    assert normalize.split_name("Ａcme | Bouw B.V.")["brand_guess"] == "Acme Bouw"
    rows = spark.createDataFrame([("Bakkerij Molen", "Bakkerij Molen Delft"), ("Bakkerij Molen", "Slotenmaker Snel"), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(normalize.names_differ(F.col("a"), F.col("b"))).collect()] == [False, True, False]


@pytest.mark.parametrize(("name", "city", "points", "level"), [
    ("Bakkerij Molen", "Delft", 0, "clean"), ("Acme Utrecht | 24/7 spoed", "Utrecht", 100, "extreme"), ("Noord Dak - beste service", "Breda", 35, "suspicious"),
])
def test_keyword_score(spark, name, city, points, level):
    k = spark.createDataFrame([(name, city)], "n string, c string").select(score.keyword_stuffing(F.col("n"), F.col("c")).alias("k")).first()["k"]
    assert (k["score"], k["level"]) == (points, level)


def test_audit_headquarters_and_gate(spark):
    schema = "name string, address string, snippet string, phone string, city string, actual_occupant string, site_address string, kvk_status string, network_cluster_size int"
    rows = [("A", "Hoofd 1", None, None, "X", None, None, None, None), ("B", "Regus Plein 1", "", "020", "X", "", "", "", 1), ("C - d", "Laan 1", "", "", "X", "", "", "", 1)]
    out = score.audited(spark.createDataFrame(rows, schema), hq="hoofd 1").orderBy("name").collect()
    assert [r["violation_category"] for r in out] == ["headquarters", "virtual_office", "needs_review"]
    assert [r["is_reportable"] for r in out] == [False, True, False]
    assert out[0]["spam_score"] is None and out[2]["review_status"] == "needs_evidence"


def test_detectors(spark):
    df = spark.createDataFrame([("Dakdekker Delft - spoed", "Weena 5, Rotterdam", "https://dakdelft.nl", "085512")], "n string, a string, w string, p string")
    r = df.select(score.keyword_detector(F.col("n")).alias("k"), score.office_detector(F.col("n"), F.col("a"), F.lit(""), F.lit("woning"), F.lit(True)).alias("v"), score.leadgen_detector(F.col("w"), F.col("p")).alias("l")).first()
    assert (r["k"]["score"], r["v"]["score"], r["v"]["policy_id"], r["l"]["score"], r["l"]["city"]) == (38, 90, "GBP-POL-SAB-01", 70, "delft")


@pytest.mark.parametrize(("title", "h1", "action", "name"), [
    ("", None, "IGNORE", ""), ("Jansen Bouw", None, "KEEP", "Jansen Bouw"), ("Loodgieter Utrecht", None, "REMOVE", ""), ("Jansen | Dakdekker", None, "RENAME", "Jansen"),
    ("Dakdekker | Slotenmaker", None, "REMOVE", ""), ("Jansen Bouw Delft", None, "RENAME", "Jansen Bouw"), ("Acme Fit | Hypotheek", "Acme Fit", "RENAME", "Acme Fit"), ("acme fit", "Acme Fit", "KEEP", "acme fit"),
])
def test_sanitizer(title, h1, action, name):
    out = sanitize(title, None, h1)
    assert (out["action"], out["clean_name"]) == (action, name)


def test_generic_is_vetoed_by_the_domain():
    assert generic("Dakservice") and not generic("Dakservice", "dakservice")
