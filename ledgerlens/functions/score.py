"""Scores and detectors of single listings, as columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import matching, vocab
from ledgerlens.functions.normalize import any_contained, compact, first_contained, folded, let, literals, once, plain_address, plain_host, text


def _escape(word: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}/" else c for c in word)


def _sum(flags: list[Column]) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + f
    return total


def _points(condition: Column, n: int | Column) -> Column:
    return F.when(condition, n).otherwise(0)


def _clamped(c: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), c)).cast("int")


def occurrences(value: Column, part: str) -> Column:
    """Times that a literal part occurs, without overlap."""
    return ((F.length(value) - F.length(F.replace(value, F.lit(part), F.lit("")))) / len(part)).cast("int")


def keyword_stuffing(name: Column, city: Column) -> Column:
    """struct(score, level, delimiters, modifiers, city_added, words) of a listing's title."""
    def found(x: Column) -> Column:
        title, lower, town = x["title"], F.lower(x["title"]), x["town"]
        rest = F.btrim(F.regexp_replace(title, F.concat(F.lit(r"(?i)\Q"), town, F.lit(r"\E")), F.lit("")), F.lit(" -|:–—/"))
        return F.struct(
            _sum([occurrences(title, d) for d in vocab.SCORE_DELIMITERS]).alias("delimiters"),
            F.filter(literals(vocab.SCORE_MODIFIERS), lambda m: F.regexp_like(lower, F.concat(F.lit(r"\b\Q"), m, F.lit(r"\E\b")))).alias("modifiers"),
            ((town != "") & F.contains(lower, F.lower(town)) & (F.length(rest) >= 3)).alias("added"),
            F.regexp_count(title, F.lit(r"(?U)\b\w+\b")).alias("words"),
        )

    def total(x: Column) -> Column:
        points = F.when(x["delimiters"] >= 2, 35).when(x["delimiters"] == 1, 15).otherwise(0) + 20 * F.size(x["modifiers"])
        return F.struct(_clamped(points + _points(x["added"], 25) + _points(x["words"] >= 6, 20)).alias("score"), x.alias("x"))

    def shown(y: Column) -> Column:
        score, x = y["score"], y["x"]
        level = F.when(score < 20, "clean").when(score < 50, "suspicious").when(score < 75, "highly_suspicious").otherwise("extreme")
        return F.struct(
            score.alias("score"), level.alias("level"), x["delimiters"].alias("delimiters"), x["modifiers"].alias("modifiers"),
            x["added"].alias("city_added"), x["words"].alias("words"),
        )

    return let(let(let(F.struct(text(name).alias("title"), text(city).alias("town")), found), total), shown)


def abuse(df: DataFrame, into: str = "abuse") -> DataFrame:
    """Adds struct(overall_score, confidence, evidence_points, keyword) to listings.

    Reads name, city, address, phone, actual_occupant, site_address, kvk_status,
    network_cluster_size.
    """
    keyword = F.col("__kw")
    address, occupant, site = (F.lower(text(F.col(c))) for c in ("address", "actual_occupant", "site_address"))
    phone = F.coalesce(F.col("phone").cast("string"), F.lit(""))
    flex = any_contained(address, vocab.FLEX_KEYWORDS) | any_contained(occupant, vocab.FLEX_KEYWORDS) | any_contained(site, vocab.FLEX_KEYWORDS) | F.contains(occupant, F.lit("unstaffed"))
    block = any_contained(F.regexp_replace(phone, r"\D", ""), vocab.PBX_BLOCKS)
    national = F.substring(F.trim(phone), 1, 3).isin(*vocab.NON_GEOGRAPHIC)
    ghost = any_contained(F.lower(text(F.col("kvk_status"))), ["unregistered", "onbekend", "ghost"])
    cloned = F.coalesce(F.col("network_cluster_size"), F.lit(0)) > 1
    # whole points of 30 % of the keyword score, cut off
    score = _clamped(F.floor(keyword["score"] * 3 / 10) + _points(flex, 35) + F.when(block, 25).when(national, 15).otherwise(0) + _points(ghost, 15) + _points(cloned, 15))
    level = lambda s: F.when(s >= 80, "CRITICAL").when(s >= 55, "HIGH").when(s >= 30, "MEDIUM").otherwise("LOW")
    t = vocab.TRIGGERS
    own = F.col("actual_occupant")
    evidence = F.array_compact(F.array(
        F.when(keyword["delimiters"] >= 2, F.format_string(t["delimiters"], keyword["delimiters"])).when(keyword["delimiters"] == 1, t["delimiter"]),
        F.when(F.size(keyword["modifiers"]) > 0, F.format_string(t["modifiers"], F.array_join(keyword["modifiers"], ", "))),
        F.when(keyword["city_added"], F.format_string(t["city"], F.concat(F.upper(F.substring(F.col("city"), 1, 1)), F.lower(F.substr(F.col("city"), F.lit(2)))))),
        F.when(keyword["words"] >= 6, F.format_string(t["words"], keyword["words"])),
        F.when(flex, F.format_string(t["flex"], F.coalesce(F.nullif(text(own), F.lit("")), F.lit("Regus/Spaces")))),
        F.when(block, F.format_string(t["block"], phone)).when(national, F.format_string(t["national"], phone)),
        F.when(ghost, t["ghost"]), F.when(cloned, F.format_string(t["cloned"], F.col("network_cluster_size").cast("string"))),
    ))
    made = let(score, lambda s: F.struct(s.alias("overall_score"), level(s).alias("confidence"), evidence.alias("evidence_points"), keyword.alias("keyword")))
    return df.withColumn("__kw", keyword_stuffing(F.col("name"), F.col("city"))).withColumn(into, made).drop("__kw")


def audited(df: DataFrame, hq: str = "", registration: str = "") -> DataFrame:
    """Listings with violation_category, review_status, is_reportable, evidence_signals and scores.

    Later categories override earlier ones; all evidence stays.
    """
    full = F.lower(F.concat_ws(" ", text(F.col("name")), text(F.col("address")), text(F.col("snippet"))))
    address = F.lower(text(F.col("address")))
    office = any_contained(full, [k.lower() for k in vocab.VIRTUAL_KEYWORDS]) | any_contained(address, [a.lower() for a in vocab.VIRTUAL_ADDRESSES])
    parcel = any_contained(full, vocab.PARCEL_CHAINS)
    home = any_contained(full, vocab.RESIDENTIAL_TERMS)
    stuffed = any_contained(text(F.col("name")), vocab.AUDIT_DELIMITERS) & ~office & ~parcel & ~home
    head = F.contains(address, F.lit(hq.lower())) if hq else F.lit(False)
    scored = abuse(df, "__abuse").withColumns({"__office": office, "__parcel": parcel, "__home": home, "__stuffed": stuffed, "__head": head})
    spam, word_score = F.col("__abuse.overall_score"), F.col("__abuse.keyword.score")
    base = F.array_compact(F.array(
        F.when(F.col("__office"), "known_virtual_office"), F.when(F.col("__parcel"), "parcel_or_partner_location"),
        F.when(F.col("__home"), "residential_address_indicator"), F.when(F.col("__stuffed"), "possible_keyword_stuffing"),
    ))
    evidence = once(F.when((spam >= 50) | (word_score >= 50), F.array_distinct(F.concat(base, F.col("__abuse.evidence_points")))).otherwise(base))
    reportable = F.col("__office") | F.col("__parcel") | (spam >= 65)
    category = F.when(F.col("__stuffed"), "keyword_stuffing").when(F.col("__home"), "residential").when(F.col("__parcel"), "parcel_dropoff").when(F.col("__office"), "virtual_office").otherwise("clean")
    scored = scored.withColumn("__evidence", evidence)
    evidence = F.col("__evidence")
    some = F.size(evidence) > 0
    head = F.col("__head")
    known = F.nullif(text(F.col("kvk_status")), F.lit(""))
    absent = F.lit(f"Not registered at this address ({registration} registered at {hq or 'HQ'})" if registration else "No commercial registration at this address")
    out = scored.withColumns({
        "is_reportable": ~head & reportable,
        "evidence_signals": F.when(head, F.array().cast("array<string>")).otherwise(evidence),
        "violation_category": F.when(head, "headquarters").when(~reportable & some, "needs_review").otherwise(category),
        "review_status": F.when(head, "clean").when(reportable, "ready_for_review").when(some, "needs_evidence").otherwise("clean"),
        "registration_status": F.when(head, F.lit(f"Legally registered ({registration})")).otherwise(F.coalesce(known, absent)),
        "spam_score": F.when(~head, spam), "keyword_score": F.when(~head, word_score), "abuse_confidence": F.when(~head, F.col("__abuse.confidence")),
    })
    return out.drop("__abuse", "__office", "__parcel", "__home", "__stuffed", "__head", "__evidence")


def confidence(score: Column, signal: Column) -> Column:
    return F.when(~signal, "LOW").when(score >= 75, "HIGH").when(score >= 45, "MEDIUM").otherwise("LOW")


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Longest-matching-block ratio of compacted strings; 0 if either is empty. Edit distance is not the same."""

    def ratio(a: str | None, b: str | None) -> float:
        x, y = compact(a), compact(b)
        return SequenceMatcher(None, x, y).ratio() if x and y else 0.0

    return pd.Series([ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def _bounded(haystack: Column, words: list[str]) -> Column:
    """The words, longest first, that stand between non-letters."""
    ordered = sorted(words, key=len, reverse=True)
    if len(words) >= matching.AUTOMATON_FROM:
        return matching.contained(haystack, ordered, bounded=True)
    return F.filter(literals(ordered), lambda w: F.regexp_like(haystack, F.concat(F.lit(r"(?<![a-z])\Q"), w, F.lit(r"\E(?![a-z])"))))


def keyword_detector(title: Column, reference: Column | None = None) -> Column:
    """struct(signal_found, confidence, score, cities, modifiers, brand_guess, policy_id).

    brand_guess: the reference, else what stands before the first separator, without a town at its end.
    """
    lower = folded(title)
    cities = _bounded(lower, vocab.DETECTOR_CITIES)
    modifiers = F.filter(literals(vocab.DETECTOR_MODIFIERS), lambda m: F.contains(lower, m))
    delimiters = F.filter(literals(vocab.DETECTOR_DELIMITERS), lambda d: F.contains(text(title), d))
    alike = F.when(text(reference) != "", similarity(text(title), text(reference))) if reference is not None else F.lit(None).cast("double")
    grown = lambda xs, step: F.when(F.size(xs) > 0, F.least(F.lit(35), 15 + (F.size(xs) - 1) * step)).otherwise(0)
    score = _clamped(F.when(alike < 0.72, 30).when(alike < 0.88, 15).otherwise(0) + grown(cities, 8) + grown(modifiers, 7) + F.least(F.lit(20), 8 * F.size(delimiters)))
    signal = (F.size(cities) > 0) | (F.size(modifiers) > 0) | (F.size(delimiters) > 0) | F.coalesce(alike < 0.72, F.lit(False))
    return F.struct(
        signal.alias("signal_found"), confidence(score, signal).alias("confidence"), score.alias("score"),
        cities.alias("cities"), modifiers.alias("modifiers"), _brand_guess(title, reference, cities).alias("brand_guess"), F.lit("GBP-POL-NAME-01").alias("policy_id"),
    )


def _brand_guess(title: Column, reference: Column | None, cities: Column) -> Column:
    first = F.trim(F.get(F.split(text(title), vocab.GUESS_SEPARATOR, 2), 0))
    guess = F.when(text(reference) != "", text(reference)).otherwise(first) if reference is not None else first
    town = F.concat(F.lit(vocab.GUESS_BEFORE_TOWN + r"(?:\Q"), F.array_join(cities, r"\E|\Q"), F.lit(r"\E)\s*$"))
    bare = F.when(F.size(cities) > 0, F.btrim(F.regexp_replace(guess, town, F.lit("")), F.lit(vocab.GUESS_EDGE))).otherwise(guess)
    return F.coalesce(F.nullif(bare, F.lit("")), text(title))


def service_business(category: Column, title: Column, flagged: Column) -> Column:
    return (
        F.when(text(category) != "", any_contained(F.lower(text(category)), vocab.SERVICE_CATEGORIES))
        .when(text(title) != "", any_contained(F.lower(text(title)), vocab.SERVICE_TITLES)).otherwise(F.coalesce(flagged, F.lit(False)))
    )


def truthy(c: Column) -> Column:
    return F.lower(text(c)).isin("1", "true", "yes", "y", "on")


def office_detector(title: Column, address: Column, category: Column, address_type: Column, public: Column, hub: Column | None = None, description: Column | None = None, occupant: Column | None = None) -> Column:
    """struct(signal_found, confidence, score, hub_name, occupant_guess, policy_id).

    A provider is looked for in title, address, the given hub's name and the description; a
    given hub's name, and a given occupant, stand in the answer as they are.
    """
    where, none = folded(address), F.lit("")
    given, kept = (text(c) if c is not None else none for c in (hub, occupant))
    looked = F.concat_ws(" ", folded(title), where, folded(hub) if hub is not None else none, folded(description) if description is not None else none)
    chain = F.get(_bounded(looked, vocab.FLEX_CHAINS), 0)
    street = first_contained(where, vocab.FLEX_STREETS)
    home = any_contained(folded(address_type), vocab.RESIDENTIAL_TYPES) & F.coalesce(public, F.lit(True)) & service_business(category, title, F.lit(False))
    score = _clamped(_points(chain.isNotNull(), 55) + _points(street.isNotNull(), 45) + _points(home, 45))
    signal = score > 0
    name = F.coalesce(F.when(chain.isNotNull() & (given != ""), given), F.initcap(F.coalesce(chain, street, none)))
    guess = F.when(kept != "", kept).when(name != "", F.format_string(vocab.OCCUPANT_GUESS, name)).otherwise(vocab.OCCUPANT_UNKNOWN)
    return F.struct(
        signal.alias("signal_found"), confidence(score, signal).alias("confidence"), score.alias("score"), name.alias("hub_name"),
        guess.alias("occupant_guess"), F.when(home, "GBP-POL-SAB-01").otherwise("GBP-POL-VO-01").alias("policy_id"),
    )


GEO_DOMAIN = r"(?i)([a-z0-9-]{3,20})(?:[-_]?)(" + "|".join(vocab.GEO_DOMAIN_CITIES) + r")\.(?:nl|com|net)"


def leadgen_detector(website: Column, prefix: Column) -> Column:
    """struct(signal_found, confidence, score, trade, city, footprint_type)."""
    host = F.coalesce(plain_host(website), F.lit(""))
    trade, city = F.regexp_extract(host, GEO_DOMAIN, 1), F.regexp_extract(host, GEO_DOMAIN, 2)
    hit = city != ""
    score = _clamped(_points(hit, 45) + _points(any_contained(text(prefix), vocab.NON_GEOGRAPHIC), 25))
    signal = score >= 35
    return F.struct(
        signal.alias("signal_found"), confidence(score, signal).alias("confidence"), score.alias("score"), trade.alias("trade"), city.alias("city"),
        F.when(hit, "TEMPLATED_GEO_DOMAIN").otherwise("STANDARD_LOCAL").alias("footprint_type"),
    )


def duplicate_keys(df: DataFrame) -> DataFrame:
    """id, address_key, phone_key, domain_key, branch: what duplicate detection compares."""
    digits = F.nullif(F.regexp_replace(text(F.col("phone")), r"\D", ""), F.lit(""))
    return df.select(
        "id", plain_address(F.col("address")).alias("address_key"), digits.alias("phone_key"), plain_host(F.col("website")).alias("domain_key"),
        F.coalesce(F.col("official_branch"), F.lit(False)).alias("branch"),
    )


