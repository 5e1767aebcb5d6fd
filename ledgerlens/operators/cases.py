"""Evidence, cases, campaigns, follow-up and remediation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import vocab
from ledgerlens.functions.normalize import text
from ledgerlens.operators.networks import numbered

DOSSIER = [
    "business_name_on_profile", "google_maps_url", "physical_address", "actual_occupant_and_business_type",
    "commercial_register_kvk_status", "policy_violation_details",
]


def evidence_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |, nulls empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def evidence_intact(ledger: DataFrame) -> DataFrame:
    """The ledger with intact: whether each stored hash is that of its row (recomputed)."""
    fresh = evidence_hash(*[F.col(c) for c in ("business_id", "evidence_type", "observation", "source_url", "captured_at")])
    return ledger.withColumn("intact", F.coalesce(F.col("sha256_hash") == fresh, F.lit(False)))


def reportable(locations: DataFrame) -> DataFrame:
    """Locations that have passed the evidence gate."""
    return locations.where((F.col("review_status") == "ready_for_review") & F.coalesce(F.col("is_reportable"), F.lit(False)))


def batches(locations: DataFrame, size: int = 20, order: str = "id") -> DataFrame:
    """Reportable locations with batch_id, route: consecutive runs of `size` within a category.

    The place in the category is a count over sorted ranges, so a category may be of any size.
    """
    if not 1 <= size <= 100:
        raise ValueError("a batch has 1 to 100 locations")
    gated = reportable(locations).withColumn("violation_category", F.coalesce("violation_category", F.lit("needs_review")))
    placed = numbered(gated, ["violation_category", order], "__n")
    first = placed.groupBy("violation_category").agg(F.min("__n").alias("__first"))
    number = F.floor((F.col("__n") - F.col("__first")) / size) + 1
    routes = F.create_map(*[F.lit(x) for kv in vocab.ROUTES.items() for x in kv])
    return placed.join(first, "violation_category").withColumns({
        "batch_id": F.format_string("%s-%03d", "violation_category", number.cast("long")),
        "route": F.coalesce(F.try_element_at(routes, F.col("violation_category")), F.lit("manual_review")),
    }).drop("__n", "__first")


def manifest(batched: DataFrame) -> DataFrame:
    """One row a batch: locations and the sorted union of their evidence signals."""
    return batched.groupBy("batch_id", "route", "violation_category").agg(
        F.count(F.lit(1)).alias("locations"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_signals")))).alias("evidence_signals")
    )


def parts(batched: DataFrame, group: str, size: int = 18, order: str = "id") -> DataFrame:
    """Rows with part 1, 2, … of `size` rows in a group, labelled only where a group has several."""
    placed = numbered(batched, [group, order], "__n")
    bounds = placed.groupBy(group).agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    number = (F.floor((F.col("__n") - F.col("__first")) / size) + 1).cast("long")
    label = F.when(F.col("__rows") > size, F.concat(F.lit("Part "), number.cast("string"))).otherwise("")
    return placed.join(bounds, group).withColumns({"part": number, "part_label": label}).drop("__n", "__first", "__rows")


def dossier(locations: DataFrame) -> DataFrame:
    """The six dossier columns of reportable locations, with their defaults."""
    flagged = F.coalesce("is_reportable", "is_fraud", F.lit(False)) if "is_fraud" in locations.columns else F.coalesce("is_reportable", F.lit(False))
    source = ["name", "url", "address", "actual_occupant", "kvk_status", "violation_details"]
    return locations.where(flagged).select(*[F.coalesce(F.nullif(text(F.col(c)), F.lit("")), F.lit(d)).alias(n) for c, d, n in zip(source, vocab.DOSSIER_DEFAULTS, DOSSIER, strict=True)])


def follow_up(submissions: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Open submissions of `days` days or more; dates that cannot be read count as old."""
    if days < 1:
        raise ValueError("days must be 1 or more")
    made = F.coalesce(F.try_to_timestamp(F.col("created_at")), F.timestamp_seconds(F.lit(0)))
    return submissions.where(F.lower(text(F.col("status"))).isin(*vocab.FOLLOW_UP_STATUSES) & (made <= now - F.expr(f"INTERVAL {int(days)} DAYS")))


def tally(df: DataFrame, column: str, missing: str) -> DataFrame:
    """Rows by value of a column, most first; case matters."""
    return df.groupBy(F.coalesce(column, F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def verification(submissions: DataFrame) -> DataFrame:
    """One row: total, verified, pending."""
    return submissions.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("email_verified")).alias("verified")).withColumn("pending", F.col("total") - F.col("verified"))


def pending(submissions: DataFrame) -> DataFrame:
    return submissions.where((F.col("email_verified") == False) | (F.col("google_status") == "pending_email_verification"))  # noqa: E712


def case_groups(targets: DataFrame, submissions: DataFrame, locations: DataFrame) -> DataFrame:
    """target, case, status, verified and the number of the target's locations."""
    counted = locations.groupBy("target_name").agg(F.count("id").alias("locations"))  # before the join: one row a target
    return submissions.join(targets.select("target_name"), "target_name").join(counted, "target_name", "left").groupBy("target_name", "case_id", "status", "email_verified").agg(F.sum(F.coalesce("locations", F.lit(0))).alias("locations"))


def case_listings(biz: DataFrame, case_businesses: DataFrame, case_id: int) -> DataFrame:
    return biz.join(case_businesses.where(F.col("case_id") == case_id).select(F.col("business_id").alias("id")), "id", "left_semi")


def reviewed(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Findings with the status of their last review: VERIFIED if approved, else REJECTED."""
    last = actions.groupBy(F.col("finding_id").alias("id")).agg(F.max_by("action", "created_at").alias("action"))
    status = F.when(F.col("action").isNull(), F.col("status")).when(F.upper("action") == "APPROVE", "VERIFIED").otherwise("REJECTED")
    return findings.join(last, "id", "left").withColumn("status", status).drop("action")


def dismissals(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action") == "REJECT")


def remediation(sanitized: DataFrame) -> DataFrame:
    """Proposed edits: RENAME goes to MAPS_EDIT, REMOVE to REDRESSAL."""
    track = F.when(F.col("action") == "RENAME", "MAPS_EDIT").when(F.col("action") == "REMOVE", "REDRESSAL")
    return sanitized.withColumn("remediation_track", track).where("remediation_track is not null").withColumn("status", F.lit("proposed"))


def remediation_counts(sanitized: DataFrame) -> DataFrame:
    """One row: all listings, renames, removals and those kept."""
    of = lambda a: F.count_if(F.col("action") == a)
    total, renames, removals = F.count(F.lit(1)), of("RENAME"), of("REMOVE")
    return sanitized.agg(total.alias("total"), renames.alias("renames"), removals.alias("removals"), (total - renames - removals).alias("kept"))


def quality_metrics(scored: DataFrame, flagged: str = "flagged", expected: str = "expected") -> DataFrame:
    """True and false positives and negatives of flags over labelled listings."""
    f, e = F.col(flagged), F.col(expected)
    kinds = {"true_positives": f & e, "false_positives": f & ~e, "false_negatives": ~f & e, "true_negatives": ~f & ~e}
    return scored.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])


def colocation(branches: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """slug, action, shared_with: branches at one address merge, or go if another town is claimed.

    Grouped by address rather than a window over it: the slugs of an address meet once.
    """
    key = F.lower(text(F.col("address")))
    keyed = branches.withColumn("__key", F.when(F.length(key) > 5, key))
    groups = keyed.where("__key is not null").groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_set("slug")).alias("__slugs"))
    shared = F.coalesce(F.col("__n") > 1, F.lit(False))
    away = ~F.contains(key, F.lower(text(F.col("city")))) & ~F.col("slug").isin(*(exempt or [""]))
    action = F.when(shared & away, "REMOVE_OR_MERGE").when(shared, "MERGE_DUPLICATE").otherwise("RENAME")
    joined = keyed.join(groups, "__key", "left")
    others = F.when(shared, F.array_except("__slugs", F.array("slug"))).otherwise(F.array().cast("array<string>"))
    return joined.select("slug", "city", "address", action.alias("action"), others.alias("shared_with"))


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the least `order` of each key, kept by a combinable aggregate."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*df.columns)


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*df.columns)


def ingest(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows with matched_id: by place_id, else by exact name; null for new ones."""
    by_place = existing.where("place_id is not null").groupBy("place_id").agg(F.min("id").alias("__a"))
    by_name = existing.where("name is not null").groupBy("name").agg(F.min("id").alias("__b"))
    found = incoming.join(by_place, "place_id", "left").join(by_name, "name", "left")
    return found.withColumn("matched_id", F.coalesce("__a", "__b")).drop("__a", "__b")




def ingested(existing: DataFrame, incoming: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(businesses, snapshots, counters) after an ingest of incoming profiles, in the order of seq.

    existing: id, place_id, name, address, phone, canonical_url. incoming: seq and the
    fields of readers.profile_fields. Profiles without a name are passed over. A profile
    that meets a business by place, else (its address known) by name, updates it; of those
    that meet none, the first of a place and of a name is inserted and the others update
    it. The last known address, phone and website stand. Every profile leaves a snapshot.
    """
    known = lambda c: F.when(F.col(c) != "unknown", F.col(c))
    rows = incoming.where("business_name <> 'unknown'").withColumns({"place_id": known("place_identifier"), "name": F.col("business_name")})
    by_place = existing.where("place_id is not null").groupBy("place_id").agg(F.min("id").alias("__a"))
    by_name = existing.where("name is not null").groupBy("name").agg(F.min("id").alias("__b"))
    found = rows.join(by_place, "place_id", "left").join(by_name, "name", "left")
    found = found.withColumn("matched", F.coalesce("__a", F.when(F.col("address") != "unknown", F.col("__b")))).drop("__a", "__b")
    new = found.where("matched is null")
    first_place = new.where("place_id is not null").groupBy("place_id").agg(F.min("seq").alias("__p"))
    first_name = new.where("address <> 'unknown'").groupBy("name").agg(F.min("seq").alias("__n"))
    told = new.join(first_place, "place_id", "left").join(first_name, "name", "left")
    head = F.least(F.coalesce("__p", "seq"), F.when(F.col("address") != "unknown", F.col("__n")).otherwise(F.col("seq")), F.col("seq"))
    told = told.withColumn("head", head).drop("__p", "__n")
    numbers = numbered(told.where("seq = head").select("seq"), ["seq"], "__n").select(F.col("seq").alias("head"), "__n")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    roots = told.select("seq", "head").join(numbers, "head", "left").join(F.broadcast(top), how="cross")  # one row
    made = told.join(roots.where("__n is not null").select("seq", (F.col("__top") + F.col("__n")).alias("business_id")), "seq", "left")
    placed = found.where("matched is not null").withColumn("business_id", F.col("matched").cast("long")).drop("matched").unionByName(made.drop("matched", "head"))
    last = {"address": "address", "phone": "phone", "canonical_url": "website"}
    latest = placed.groupBy(F.col("business_id").alias("id")).agg(
        F.min_by("place_id", "seq").alias("__place"), F.min_by("name", "seq").alias("__name"),
        *[F.max_by(known(c), F.when(F.col(c) != "unknown", F.col("seq"))).alias(f"__{k}") for k, c in last.items()],
    )
    kept = existing.join(latest, "id", "full").select(
        "id", F.coalesce("place_id", "__place").alias("place_id"), F.coalesce("name", "__name").alias("name"), *[F.coalesce(f"__{k}", k).alias(k) for k in last],
        F.when(F.col("__name").isNotNull(), at).alias("updated_at"),
    )
    body = F.to_json(F.struct(*[c for c in incoming.columns if c != "seq"]))
    fields = ["business_name", "address", "phone", "website", "category"]
    snapshots = placed.select("business_id", F.col("source_timestamp").alias("snapshot_timestamp"), *fields, F.lit("ACTIVE").alias("status_visible"), body.alias("raw_payload_json"))
    counters = placed.agg(F.count(F.lit(1)).alias("snapshots_created")).join(numbers.agg(F.count(F.lit(1)).alias("inserted_businesses")), how="cross")  # one row each
    counters = counters.withColumn("updated_businesses", F.col("snapshots_created") - F.col("inserted_businesses"))
    return kept, snapshots.withColumn("sha256_hash", F.sha2("raw_payload_json", 256)), counters
