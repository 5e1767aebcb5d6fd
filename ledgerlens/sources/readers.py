"""Readers: JSON listing documents, CSV dossiers, reference lists, pages, policies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import vocab
from ledgerlens.functions.normalize import first_filled, text
from ledgerlens.sources.sinks import upsert

LISTING = (
    "name string, title string, business_name string, address string, formatted_address string, phone string, telephone string, website string, url string, google_maps_url string, "
    "snippet string, description string, category string, rating double, review_count int, review_status string, is_reportable boolean, actual_occupant string, kvk_status string, place_id string"
)


def documents(rows: DataFrame, target: str | None = None, strict: bool = False) -> DataFrame:
    """Rows (id, target_name, data JSON) as typed listings; rows that are not JSON are skipped, or fail the read.

    Unknown keys stay available in `raw`, as a variant.
    """
    found = rows.where(F.col("target_name") == target) if target else rows
    parsed = F.from_json("data", LISTING, {"mode": "FAILFAST"} if strict else {})
    kept = found.withColumns({"d": parsed, "raw": F.try_parse_json("data")})
    kept = kept if strict else kept.where("raw is not null")
    name = first_filled(text(F.col("d.business_name")), text(F.col("d.name")), text(F.col("d.title")))
    return kept.select(
        "id", "target_name", name.alias("name"), first_filled(text(F.col("d.address")), text(F.col("d.formatted_address"))).alias("address"),
        first_filled(text(F.col("d.phone")), text(F.col("d.telephone"))).alias("phone"), F.col("d.website").alias("website"),
        first_filled(text(F.col("d.google_maps_url")), text(F.col("d.url"))).alias("url"), F.col("d.snippet").alias("snippet"), F.col("d.category").alias("category"),
        F.col("d.rating").alias("rating"), F.col("d.review_count").alias("review_count"), F.col("d.review_status").alias("review_status"),
        F.col("d.is_reportable").alias("is_reportable"), F.col("d.actual_occupant").alias("actual_occupant"), F.col("d.kvk_status").alias("kvk_status"),
        F.col("d.place_id").alias("place_id"), F.col("data").alias("payload"), "raw",
    )


def formatted(listings: DataFrame) -> DataFrame:
    """Listing fields with `unknown` where nothing is known (for display only)."""
    return listings.select("id", *[F.coalesce(F.nullif(text(F.col(c)), F.lit("")), F.lit("unknown")).alias(c) for c in ("name", "address", "phone", "website", "url", "category")])


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def flagged(dossier: DataFrame) -> DataFrame:
    """Rows of a dossier file with is_fraud: whether the violation details lack the word None; blank details count as fraud."""
    return dossier.withColumn("is_fraud", ~F.contains(F.coalesce("policy_violation_details", F.lit("")), F.lit("None")))


def reference_list(spark: SparkSession, path: str, key: str) -> list[str]:
    """Lower-cased words of a small JSON reference list; empty if there is no such file or key. A file that is not JSON is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    lines = [r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect()]
    return [str(w).lower() for w in json.loads(lines[0]).get(key, [])] if lines else []


def targets_with_locations(targets: DataFrame, locations: DataFrame, target: str | None = None) -> DataFrame:
    """Locations with their target; a location without a website has its target's."""
    chosen = targets.where(F.col("name") == target) if target else targets
    site = chosen.select(F.col("name").alias("target_name"), F.col("website").alias("__site"))
    return locations.join(site, "target_name").withColumn("website", F.coalesce(F.nullif("website", F.lit("")), "__site")).drop("__site")


#: Where official policy texts are published (fixed value).
POLICY_SOURCE = "https://support.google.com/"
POLICY = (
    "policy_id string, category string, title string, severity string, description string, official_source_url string, source_date string, last_verified string, "
    "applicable_to array<string>, examples array<string>, counter_examples array<string>"
)


def policies(spark: SparkSession) -> DataFrame:
    """The policy records, in all columns."""
    told = vocab.POLICY_TEXTS
    rows = [(*p, told[p[0]][0], f"{POLICY_SOURCE}business/answer/3038177", "2024-01-01", "2024-01-01", *told[p[0]][1:]) for p in vocab.POLICIES]
    return spark.createDataFrame(rows, POLICY)


def _broken() -> Column:
    """The rules that a policy record breaks."""
    filled = lambda c: text(F.col(c)) != ""
    dated = lambda c: F.regexp_like(text(F.col(c)), F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(F.col(c).cast("string")).isNotNull()
    listed = lambda c: F.coalesce(F.forall(c, lambda x: text(x) != ""), F.lit(False))
    rules = {c: filled(c) for c in ("policy_id", "category", "title", "description")}
    rules |= {"official_source_url": F.startswith(text(F.col("official_source_url")), F.lit(POLICY_SOURCE)), "source_date": dated("source_date"), "last_verified": dated("last_verified")}
    rules |= {"severity": F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM")} | {c: listed(c) for c in ("applicable_to", "examples", "counter_examples")}
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def policy_faults(records: DataFrame) -> DataFrame:
    """Policy records that break a rule, with the rules broken."""
    return records.withColumn("broken", _broken()).where(F.size("broken") > 0)


def upserted_policies(existing: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """existing with sound records of new in the place of those with their id; a faulty record fails the read."""
    fault = F.raise_error(F.concat(F.lit("faulty policy: "), F.array_join("broken", ", ")))
    checked = new.withColumn("broken", _broken()).withColumn("policy_id", F.when(F.size("broken") > 0, fault).otherwise(F.col("policy_id")))
    return upsert(existing, checked.drop("broken").withColumn("created_at", at), ["policy_id"])


#: Aliases of the fields of a found profile, in order (fixed values).
PROFILE_FIELDS = {
    "google_maps_url": ["google_maps_url", "url"], "place_identifier": ["place_identifier", "place_id", "cid"], "business_name": ["business_name", "name", "title"],
    "address": ["address", "formatted_address"], "phone": ["phone", "telephone"], "website": ["website", "domain"], "category": ["category", "types"], "rating": ["rating"],
    "review_count": ["review_count", "reviews", "user_ratings_total"], "coordinates": ["coordinates", "location"], "service_area": ["service_area"],
    "description": ["description", "snippet"], "opening_hours": ["opening_hours"], "source_timestamp": ["source_timestamp"],
}


def profile_fields(raw: DataFrame, now: Column) -> DataFrame:
    """All fourteen fields of found profiles as text: the first filled alias, `unknown` where none is (source_timestamp: now)."""
    def field(name: str) -> Column:
        values = [F.col(c).cast("string") for c in PROFILE_FIELDS[name] if c in raw.columns]
        filled = F.coalesce(*[F.when(~v.isin("", "None"), v) for v in values]) if values else F.lit(None).cast("string")
        return F.coalesce(filled, now.cast("string") if name == "source_timestamp" else F.lit("unknown"))

    return raw.select(*[c for c in raw.columns if c == "seq"], *[field(f).alias(f) for f in PROFILE_FIELDS])
