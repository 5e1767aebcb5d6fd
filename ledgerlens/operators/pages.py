"""Footprints and metadata of supplied web pages. Nothing is fetched: pages are an input table."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import vocab
from ledgerlens.functions.normalize import any_contained, plain_host, text
from ledgerlens.functions.sanitize import sanitized
from ledgerlens.operators.components import connected_components


def _all(html: Column, pattern: str, group: int = 0) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(group))))


def footprints(pages: DataFrame) -> DataFrame:
    """url, domain, title and the sorted distinct tracking ids, registry numbers, phones and claims of a page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    lower = F.lower(html)
    title = F.btrim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(" \t\r\n"))
    claims = F.array_compact(F.array(*[F.when(any_contained(lower, words), label) for words, label in vocab.CLAIMS]))
    return pages.select(
        "url", plain_host(F.col("url")).alias("domain"), F.when(title != "", title).otherwise(plain_host(F.col("url"))).alias("title"),
        _all(html, "GTM-[A-Z0-9]+").alias("gtm"), _all(html, "G-[A-Z0-9]{8,12}").alias("ga4"), _all(html, "ca-pub-[0-9]+").alias("adsense"),
        _all(html, r"(?i)(?:kvk|handelsregister|dossier)[^\d]{0,25}([0-9]{8})\b", 1).alias("kvk"), _all(html, vocab.PAGE_PHONE, 1).alias("phones"),
        claims.alias("deceptive_claims"), F.length(html).alias("html_length"),
    )


def matching(found: DataFrame, gtm: str | None = None, kvk: str | None = None, phone: str | None = None) -> DataFrame:
    """Footprints with a target's id, number or phone; without targets, those with any marker."""
    if not (gtm or kvk or phone):
        return found.where((F.size("deceptive_claims") > 0) | (F.size("gtm") > 0) | (F.size("phones") > 0))
    hit = F.lit(False)
    if gtm:
        hit = hit | F.array_contains("gtm", gtm)
    if kvk:
        hit = hit | F.array_contains("kvk", kvk)
    if phone:
        hit = hit | F.exists("phones", lambda p: F.contains(F.regexp_replace(p, "[ -]", ""), F.lit(phone)))
    return found.where(hit)


def shared_id_clusters(found: DataFrame) -> DataFrame:
    """(domain, cluster): domains joined by tracking ids, registry numbers or phones; cluster is the least hash."""
    ids = F.concat(*[F.transform(c, lambda x, c=c: F.concat(F.lit(f"{c}:"), x)) for c in ("gtm", "ga4", "adsense", "kvk", "phones")])
    carried = found.select("domain", F.explode(ids).alias("key")).distinct().withColumn("id", F.xxhash64("domain"))
    heads = carried.groupBy("key").agg(F.min("id").alias("a"))
    joined = connected_components(carried.join(heads, "key").select("a", F.col("id").alias("b")))
    return carried.select("domain", "id").distinct().join(joined, "id").select("domain", F.col("component").alias("cluster"))


def metadata(pages: DataFrame) -> DataFrame:
    """url, h1, and name, telephone, address, city of a page's JSON-LD business, first maps link.

    Root objects and those of lists and @graph count if typed FinancialService or LocalBusiness; the last filled value wins.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    h1 = F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", "")
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    links = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"']*(?:google\.com/maps|goo\.gl)[^"']*)"""), F.lit(1))
    base = pages.select("url", F.btrim(h1, F.lit(" \t\r\n")).alias("h1"), F.coalesce(F.get(links, 0), F.lit("")).alias("maps_url"), business_facts(scripts).alias("b"))
    place = F.btrim(F.concat("b.street", F.lit(", "), "b.postal_code", F.lit(" "), "b.city"), F.lit(", "))
    return base.select("url", "h1", F.col("b.name").alias("schema_name"), "b.telephone", place.alias("address"), "b.city", "maps_url")


FACTS = ["name", "telephone", "street", "city", "postal_code"]


def facts(scripts: list[str]) -> dict[str, str]:
    """The last filled values of the businesses in JSON-LD texts, wherever they lie in them.

    Looked at are root objects, those in root and nested lists, and those in @graph, which may be nested as well; not what
    a business names as parent or department. One is a business if its @type, or one of a
    list of types, is. What is not JSON is passed over. Depth has no limit, since nothing recurses.
    """
    found = dict.fromkeys(FACTS, "")
    for script in scripts:
        try:
            open_ = [json.loads(script)]
        except (ValueError, RecursionError):
            continue
        while open_:
            node = open_.pop()
            if isinstance(node, list):
                open_.extend(reversed(node))
            elif isinstance(node, dict):
                types = node.get("@type")
                if not {"FinancialService", "LocalBusiness"}.isdisjoint(t for t in (types if isinstance(types, list) else [types]) if isinstance(t, str)):
                    place = node.get("address")
                    place = next((p for p in place if isinstance(p, dict)), {}) if isinstance(place, list) else place if isinstance(place, dict) else {}
                    told = [node.get("name"), node.get("telephone"), place.get("streetAddress"), place.get("addressLocality"), place.get("postalCode")]
                    found |= {k: str(v) for k, v in zip(FACTS, told, strict=True) if v and isinstance(v, str | int | float)}
                open_.append(node.get("@graph"))
    return found


@F.pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in FACTS]))
def business_facts(scripts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([facts([] if s is None else list(s)) for s in scripts], columns=FACTS)


def branch_links(pages: DataFrame, section: str, host: str) -> DataFrame:
    """slug, url, city_guess of a chain's branch pages linked from its overview pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.filter(F.regexp_extract_all(html, F.lit(r"""href=["']([^"']+)["']"""), F.lit(1)), lambda x: F.contains(x, F.lit(section)) & (x != section))
    found = pages.select(F.explode(links).alias("link")).distinct()
    url = F.when(F.col("link").startswith("http"), F.col("link")).otherwise(F.concat(F.lit(f"https://{host}"), F.col("link")))
    found = found.select(url.alias("url")).distinct().where(~F.col("url").isin(f"https://{host}{section}"))
    slug = F.substring_index(F.regexp_replace("url", "/+$", ""), "/", -1)
    return found.select(slug.alias("slug"), "url", F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))).alias("city_guess"))


def niche_matches(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """First live candidate domain of each niche and city whose page has a tel link in a known block."""
    digits = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""href=["']tel:([^"']+)"""), F.lit(1)), lambda t: F.regexp_replace(t, r"\D", ""))
    hosted = pages.select(plain_host(F.col("url")).alias("domain"), F.exists(digits, lambda d: any_contained(d, vocab.PBX_BLOCKS)).alias("hit")).groupBy("domain").agg(F.bool_or("hit").alias("hit"))
    live = candidates.join(hosted, "domain")
    return live.groupBy("niche", "city").agg(F.min_by(F.struct("domain", "hit"), "rank").alias("f")).where("f.hit").select("niche", "city", "f.domain")


def candidate_matrix(niches: DataFrame, cities: DataFrame, tlds: list[str]) -> DataFrame:
    """niche, city, domain, rank: the domains to look for. Both sides are short reference lists."""
    both = niches.join(F.broadcast(cities), how="cross")
    at = both.select("niche", "city", F.posexplode(F.array(*[F.lit(t) for t in tlds])).alias("rank", "tld"))
    return at.select("niche", "city", F.concat(F.lower(text(F.col("niche"))), F.replace(F.lower(F.col("city")), F.lit(" "), F.lit("")), F.lit("."), F.col("tld")).alias("domain"), "rank").distinct()


def branch_audit(listings: DataFrame, branches: DataFrame) -> DataFrame:
    """Listings(id, name, gbp_url) against branches(id, url, h1, schema_name, city), the metadata of their landing pages.

    A listing without a branch is judged by its title alone; a branch without a listing is left out.
    """
    met = listings.join(branches, "id", "left")
    told = met.withColumn("s", sanitized(F.col("name"), F.col("url"), F.col("h1"), F.col("schema_name")))
    return told.select(
        "id", F.col("url").alias("branch_url"), "city", F.col("h1").alias("landing_h1"), "schema_name", F.col("name").alias("gbp_title"), "gbp_url",
        "s.action", F.col("s.clean_name").alias("proposed_name"), "s.confidence", F.col("s.removed_parts").alias("stuffed_parts"), "s.reasons",
    )
