"""From JSON listing documents to the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.normalize import address, domain, phone, place_id, place_key, text
from ledgerlens.operators.cases import evidence_hash, first_by
from ledgerlens.operators.linkage import brand
from ledgerlens.operators.networks import numbered


def keyed(listings: DataFrame) -> DataFrame:
    """Listings with the place that each belongs to."""
    key = F.when(F.regexp_like(text(F.col("url")), F.lit("1s0x")), place_key(F.col("url")))
    return listings.withColumn("place_id", place_id(F.coalesce(F.nullif(text(F.col("place_id")), F.lit("")), key), F.lit(""), F.col("name"), F.col("address")))


def businesses(listings: DataFrame) -> DataFrame:
    """One business a place, the first listing by id winning; national digits are the phone key."""
    first = first_by(keyed(listings).drop("raw"), "place_id", "id")
    made = first.withColumns({"__p": phone(F.col("phone")), "__a": address(F.col("address")), "__d": domain(F.col("website"))})
    has_site = text(F.col("website")) != ""
    return made.select(
        "id", "place_id", F.col("url").alias("google_maps_url"), "name", F.col("name").alias("raw_name"), F.lower(brand(F.col("name"))).alias("normalized_name"),
        "phone", F.nullif(F.col("__p.digits"), F.lit("")).alias("normalized_phone"), F.nullif(F.col("__p.pbx_prefix_6"), F.lit("")).alias("phone_prefix"),
        F.when(has_site, F.col("__d.domain")).alias("domain"), F.when(has_site, F.col("__d.canonical_url")).alias("canonical_url"), "address",
        *[F.nullif(F.col(f"__a.{c}"), F.lit("")).alias(c) for c in ("street", "house_number", "postal_code", "city")], F.col("__a.country").alias("country"),
        "category", "rating", "review_count", "target_name",
    )


def snapshots(listings: DataFrame, migrated: DataFrame, at: str = "snapshot_timestamp") -> DataFrame:
    """One snapshot of a business and time, under the business of its own place, with the hash of its payload.

    The payload is the stored document where there is one. Several listings of a place at
    one time leave the snapshot of the least id.
    """
    found = keyed(listings).join(migrated.select("place_id", F.col("id").alias("business_id")), "place_id")
    fields = ["name", "address", "phone", "website", "category"]
    made = F.to_json(F.struct(*[F.col(c) for c in fields]))
    payload = F.coalesce(F.col("payload"), made) if "payload" in listings.columns else made
    rows = found.select("id", "business_id", *fields, at, payload.alias("raw_payload_json"))
    rest = [*fields, "raw_payload_json"]
    one = rows.groupBy("business_id", at).agg(F.min_by(F.struct(*rest), "id").alias("r")).select("business_id", at, "r.*")
    return one.withColumn("sha256_hash", evidence_hash(F.col("raw_payload_json")))


def cases_of(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, submissions): a case for each distinct case id of stored submissions, and every submission under its case."""
    first = submissions.where("case_id is not null").groupBy(F.col("case_id").alias("case_code")).agg(F.min("target_name").alias("title"), F.min("created_at").alias("created_at"))
    cases = numbered(first, ["case_code"], "id").select("id", "case_code", "title", F.lit("REPORTED").alias("status"), "created_at")
    kept = submissions.join(cases.select(F.col("id").alias("__case"), "case_code"), submissions["case_id"] == F.col("case_code"))
    return cases, kept.select(F.col("__case").alias("case_id"), F.col("case_code").alias("google_case_id"), "status", F.col("created_at").alias("submitted_at"))


def verification(migrated: DataFrame, snapshots: DataFrame | None = None, cases: DataFrame | None = None, submissions: DataFrame | None = None) -> DataFrame:
    """One row of counts that a migration is checked by."""
    distinct = {"domains": "domain", "phones": "normalized_phone", "postal_codes": "postal_code"}
    out = migrated.agg(F.count(F.lit(1)).alias("businesses"), *[F.count_distinct(F.nullif(F.col(c), F.lit(""))).alias(n) for n, c in distinct.items()])
    for name, t in (("snapshots", snapshots), ("cases", cases), ("submissions", submissions)):
        if t is not None:
            out = out.join(t.agg(F.count(F.lit(1)).alias(name)), how="cross")  # one row each
    return out
