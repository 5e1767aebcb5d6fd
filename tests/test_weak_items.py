"""Folding, brand and occupant guesses, explanations, overlaps of sets, JSON-LD of any shape, niche harvest."""

from __future__ import annotations

import json
import random
import unicodedata
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import normalize, score, vocab
from ledgerlens.operators import networks, pages
from ledgerlens.plans import catalog
from ledgerlens.sources import sinks

SF = "/root/testdata/sf0.001"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_folding_equals_the_unicode_rule(spark):
    words = ["Café Zoë", "ŠKODA Łódź", "naïve Ñandú", "Ångström", "", None, "日本 ß"]
    got = column(spark, words, normalize.folded)
    plain = ["".join(c for c in unicodedata.normalize("NFKD", w or "") if not unicodedata.combining(c)).lower() for w in words]
    assert got[:1] + got[2:] == plain[:1] + plain[2:] and got[1] == "skoda łodz"


def test_marks_do_not_hide_towns_and_providers(spark):
    r = spark.range(1).select(score.keyword_detector(F.lit("Jansen Zwólle")).alias("k"), score.office_detector(F.lit("Jansen"), F.lit("Régus Plein 1"), F.lit(""), F.lit(""), F.lit(True)).alias("v")).first()
    assert (r["k"]["cities"], r["v"]["hub_name"], r["v"]["occupant_guess"]) == (["zwolle"], "Regus", "Regus (Commercial Coworking & Business Center)")


@pytest.mark.parametrize(("title", "reference", "guess"), [
    ("Jansen | Delft", None, "Jansen"), ("Jansen Bouw Utrecht", None, "Jansen Bouw"), ("Jansen, Den Haag", None, "Jansen"), ("Utrecht", None, "Utrecht"), ("Utrechtse Bank", None, "Utrechtse Bank"),
    ("Iets Utrecht - x", "Jansen Utrecht", "Jansen"), ("Iets - x", "Jansen", "Jansen"), ("", None, ""), (None, None, ""),
])
def test_brand_guess(spark, title, reference, guess):
    df = spark.createDataFrame([(title, reference)], "t string, r string")
    assert df.select(score.keyword_detector(F.col("t"), F.col("r")).alias("k")).first()["k"]["brand_guess"] == guess


def test_keyword_detector_with_references_equals_plain_python(spark):
    """The registered query on whole tables, similarity included."""
    rows = {r["id"]: r for r in catalog.profiles(spark, SF).collect()}
    for got in catalog.QUERIES["kw_detector"](spark, SF).collect():
        row = rows[got["id"]]
        title, low, reference = row["name"], row["name"].lower(), row["target_name"] if row["id"] % 3 == 0 else None
        towns = [c for c in vocab.DETECTOR_CITIES if any(not low[i - 1 : i].isalpha() and not low[i + len(c) : i + len(c) + 1].isalpha() for i in range(len(low)) if low.startswith(c, i))]
        n = [len(towns), sum(m in low for m in vocab.DETECTOR_MODIFIERS), sum(d in title for d in vocab.DETECTOR_DELIMITERS)]
        alike = SequenceMatcher(None, normalize.compact(title), normalize.compact(reference)).ratio() if reference else None
        points = (0 if alike is None else 30 if alike < 0.72 else 15 if alike < 0.88 else 0) + (min(35, 15 + (n[0] - 1) * 8) if n[0] else 0) + (min(35, 15 + (n[1] - 1) * 7) if n[1] else 0) + min(20, 8 * n[2])
        assert (got["score"], got["signal_found"]) == (min(points, 100), bool(any(n) or alike is not None and alike < 0.72))


def test_explanations_fit_and_lose_whole_bullets(spark):
    many = [f"rule {k} " + "x" * 90 for k in range(30)]
    for violations, kept in ((many, None), (["one", "two"], 2), ([], len(vocab.EXPLANATION_RULES)), (None, len(vocab.EXPLANATION_RULES)), (["y" * 2000], 0)):
        df = spark.createDataFrame([("Acme", None, " ", 7, violations)], "n string, r string, s string, t long, v array<string>")
        text = df.select(sinks.explained(F.col("n"), F.col("r"), F.col("s"), F.col("t"), F.col("v")).alias("x")).first()["x"]
        bullets = [x for x in text.split("\n") if x.startswith("- ")]
        assert len(text) <= 1000 and text.endswith("all 7 audited places.") and "register number unknown" in text and "seat is not known" in text
        assert kept is None or len(bullets) == kept
        assert bullets == [f"- {v}" for v in (violations or vocab.EXPLANATION_RULES)][: len(bullets)]


def test_overlaps_of_sets_equal_plain_sets(spark):
    r = random.Random(3)
    sets = {n: {r.randint(0, 100_000) for _ in range(300)} | set(range(k * 50, 200)) for k, n in enumerate("abcde")}
    rows = [(n, i) for n, ids in sets.items() for i in ids] + [("a", -5), ("a", None), (None, 3), ("a", 60), ("gone", -1)]
    got = {(x["a"], x["b"]): (x["common"], x["only_a"], x["only_b"]) for x in networks.set_overlaps(spark.createDataFrame(rows, "name string, id long")).collect()}
    sets["a"].add(60)
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a] - sets[b]), len(sets[b] - sets[a])) for a, b in combinations("abcde", 2)}


SHOP = {"@type": "LocalBusiness", "name": "Acme", "telephone": "020", "address": {"streetAddress": "Laan 1", "addressLocality": "Delft", "postalCode": "1111 AA"}}


@pytest.mark.parametrize("shape", [
    SHOP, [SHOP], {"@graph": [SHOP]}, {"@graph": [{"@type": "WebPage"}, {"@graph": [[SHOP]]}]}, {**SHOP, "@type": ["Organization", "LocalBusiness"]}, [[{"@graph": SHOP}]],
    {**SHOP, "address": [SHOP["address"]], "department": {**SHOP, "name": "Other"}},
])
def test_businesses_in_json_of_any_shape(spark, shape):
    html = f'<h1> Kop <b>x</b></h1><script type="application/ld+json">{{broken</script><script type="application/ld+json">{json.dumps(shape)}</script>'
    r = pages.metadata(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).orderBy("url").collect()
    assert (r[0]["schema_name"], r[0]["telephone"], r[0]["address"], r[0]["city"], r[0]["h1"]) == ("Acme", "020", "Laan 1, 1111 AA Delft", "Delft", "Kop x")
    assert (r[1]["schema_name"], r[1]["address"]) == ("", "")


def test_deep_json_and_the_last_filled_value():
    deep = SHOP
    for _ in range(300):
        deep = {"@graph": [deep]}
    assert pages.facts([json.dumps(deep)])["name"] == "Acme"
    assert pages.facts([json.dumps([SHOP, {**SHOP, "name": "Later", "telephone": ""}]), "null", "[1, \"x\"]"])["name"] == "Later"
    assert pages.facts([json.dumps([SHOP, {**SHOP, "name": "Later", "telephone": ""}])])["telephone"] == "020"
