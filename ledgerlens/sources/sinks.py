"""Sinks: CSV, manifests, Markdown reports, and changes of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import vocab
from ledgerlens.operators.networks import numbered


def write_csv(df: DataFrame, path: str, allow_empty: bool = True) -> None:
    """CSV with a header; lists joined with ' | '."""
    if not allow_empty and df.isEmpty():
        raise ValueError("there is nothing to write")
    flat = df.select(*[F.array_join(F.col(c).cast("array<string>"), " | ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_batches(batched: DataFrame, manifest: DataFrame, path: str) -> None:
    """One folder a batch, its manifest as JSON, and the queue as CSV."""
    batched.drop("evidence_signals").write.mode("overwrite").partitionBy("batch_id").option("header", True).csv(f"{path}/batches")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    write_csv(manifest.drop("evidence_signals"), f"{path}/queue")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the rows of new in place of those with their keys; of several new rows of a key, one by the hash of its columns."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.xxhash64(*rest)).alias("__r")).select(*keys, "__r.*") if rest else new.distinct()
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(one.select(*new.columns), allowMissingColumns=True)


def deleted(existing: DataFrame, condition: Column) -> DataFrame:
    """existing without the rows that meet the condition; where it is null the row stays."""
    return existing.where(~F.coalesce(condition, F.lit(False)))


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Replaces the partitions of df's values of column and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def latest_status(events: DataFrame, key: str = "case_id") -> DataFrame:
    """Status of each key from an append-only event log."""
    return events.groupBy(key).agg(F.max_by("status", F.struct("created_at", "status")).alias("status"), F.max("created_at").alias("updated_at"))


def network_report(network: dict[str, object], members: DataFrame, edges: DataFrame, shown: int = 50) -> str:
    """Markdown of a network: headline, members and links, each table cut at `shown` rows with the total named."""
    if not network:
        return "# Network report\n\nThis network was not found.\n"
    lines = [f"# Network report: {network['name']}", "", f"Score {network['suspicion_score']} ({network['severity']}), type {network['network_type']}.", "", "## Members", ""]

    def table(df: DataFrame, columns: list[str], order: list[str]) -> None:
        rows, total = df.orderBy(*order).limit(shown).collect(), df.count()
        if not total:
            lines.extend(["None on record.", ""])
            return
        lines.extend(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)])
        lines.extend("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows)
        lines.extend(["", f"{min(shown, total)} of {total} rows.", ""])

    table(members, ["id", "name", "city"], ["id"])
    lines.extend(["## Links", ""])
    table(edges, ["source_business_id", "target_business_id", "relationship_type"], ["source_business_id", "target_business_id", "relationship_type"])
    lines.extend(["## Note", "", str(network.get("disclaimer", "")), ""])
    return "\n".join(lines)


#: What a report recommends (fixed value).
REPORT_ACTION = "Consider submitting this evidence through Google's official reporting process for review."


def case_report(case_id: int, cases: DataFrame, case_businesses: DataFrame, submissions: DataFrame, outcomes: DataFrame, shown: int = 200) -> str:
    """Markdown of a case: headline, summary, its submissions and outcomes, each cut at `shown` rows with the total named."""
    found = cases.where(F.col("id") == case_id).limit(1).collect()
    if not found:
        return f"# Case not found\n\nThere is no case {case_id}.\n"
    of = lambda df: df.where(F.col("case_id") == case_id)
    case, sent, seen, listings = found[0].asDict(), of(submissions), of(outcomes), of(case_businesses).count()
    told = lambda *names: next((str(case[n]) for n in names if case.get(n)), "none")
    n_sent, n_seen = sent.count(), seen.count()
    lines = [
        f"# Case: {case.get('case_code') or f'CASE-{case_id:05d}'}", "", f"Title: {told('title')}", f"Status: {told('status')}, priority: {told('priority')}, reviewer: {told('reviewer_name')}", "",
        "## Executive summary", "", f"{listings} listings, {n_sent} submissions, {n_seen} outcomes; status {told('status')}.", "",
    ]
    when = lambda r, *names: next((str(r[n]) for n in names if n in r and r[n] is not None), "unknown")
    newest = lambda df: [F.desc_nulls_last(c) for c in ("created_at", "id") if c in df.columns] or [F.lit(1)]
    if n_sent:
        lines += ["## Submissions", "", "| When | Type | Status | Case number |", "| --- | --- | --- | --- |"]
        for r in (x.asDict() for x in sent.orderBy(*newest(sent)).limit(shown).collect()):
            lines.append(f"| {when(r, 'submitted_at', 'created_at')} | {r.get('submission_type') or 'REDRESSAL_FORM'} | {r.get('status') or 'PREPARED'} | {r.get('google_case_id') or 'pending'} |")
        lines += ["", f"{min(shown, n_sent)} of {n_sent} rows.", ""]
    if n_seen:
        lines += ["## Outcomes", ""]
        for r in (x.asDict() for x in seen.orderBy(*newest(seen)).limit(shown).collect()):
            lines.append(f"- {r['outcome_type']} ({when(r, 'verified_at', 'created_at')}): {r.get('description') or 'no description'}")
        lines += ["", f"{min(shown, n_seen)} of {n_seen} rows.", ""]
    return "\n".join([*lines, "## Recommended action", "", REPORT_ACTION, ""])


#: Columns of the franchise file (fixed values).
FRANCHISE_COLUMNS = ["slug", "stad", "officiële_naam_h1", "schema_handelsnaam", "aanbevolen_handhaving", "overtredingen", "fysiek_adres", "telefoonnummer", "landingspagina_url", "bewijslast_h1"]


def franchise_rows(branches: DataFrame, judged: DataFrame, chain: str) -> DataFrame:
    """The ten columns of a chain's file: branches(slug, city, h1, schema_name, address, telephone, url) as judged(slug, action, shared_with).

    A branch without heading is named after the chain and its town. Violations are told in
    words: branches at one address, an address in another town, or else added keywords.
    """
    told = branches.join(judged.select("slug", "action", "shared_with"), "slug")
    here = F.col("action") != "RENAME"
    shared = F.when(here, F.format_string("One of %d branches at one address", F.size("shared_with") + 1))
    away = F.when(F.col("action") == "REMOVE_OR_MERGE", F.concat(F.lit("Claims "), "city", F.lit(" from an address elsewhere ("), "address", F.lit(")")))
    violations = F.array_join(F.array_compact(F.array(shared, away, F.when(~here, "Keywords added to the title"))), " | ")
    name = F.when(F.trim(F.coalesce("h1", F.lit(""))) != "", F.col("h1")).otherwise(F.concat(F.lit(f"{chain} | "), "city"))
    proof = F.concat(F.lit("Heading of the landing page: '"), F.coalesce("h1", F.lit("")), F.lit("'"))
    made = [F.col("slug"), F.col("city"), name, F.coalesce("schema_name", F.lit("")), F.col("action"), violations, F.col("address"), F.col("telephone"), F.col("url"), proof]
    return told.select(*[c.alias(n) for c, n in zip(made, FRANCHISE_COLUMNS, strict=True)])


def intelligence_report(metrics: dict[str, object], hubs: DataFrame, shown: int = 8, trades: int = 4) -> str:
    """Markdown of the corpus metrics and the densest hubs, each with some of its trades."""
    lines = ["# Network intelligence", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in metrics.items()], "", "## Dense hubs", ""]
    for r in hubs.orderBy(F.desc("total_profiles"), "hub_name").limit(shown).collect():
        lines.append(f"- {r['hub_name']}: {r['total_profiles']} profiles, {r['unique_trades_count']} trades ({', '.join(r['sample_trades'][:trades])})")
    return "\n".join([*lines, ""])


def master_report(groups: DataFrame, shown: int = 500) -> str:
    """Markdown table of case groups, cut at `shown` rows with the total named."""
    head = ["target_name", "case_id", "status", "email_verified", "locations"]
    rows, total = groups.orderBy("target_name", "case_id").limit(shown).collect(), groups.count()
    lines = ["# Cases", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join([*lines, *["| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows], "", f"{min(shown, total)} of {total} rows.", ""])


#: Columns of the syndicate and of the franchise file, and the texts of the former's constant columns (fixed values).
SYNDICATE_COLUMNS = ["Business Name on Profile", "Google Maps URL", "Reported Address", "Actual Occupant / True Business", "KvK Commercial Registry Status", "Specific Policy Violation Details"]
SYNDICATE_PLACE, SYNDICATE_SEARCH = "Netherlands (National / Virtual Dispatch)", "https://www.google.com/maps/search/"
CHAIN_COLUMNS = ["city", "branch_url", "landing_h1", "schema_name", "gbp_title", "proposed_name", "action", "confidence", "stuffed_parts", "gbp_url"]


def syndicate_rows(footprints: DataFrame, syndicate: str) -> DataFrame:
    """The syndicate file: one row a footprint(domain, gtm, kvk, deceptive_claims), with defaults where nothing was found."""
    bare = F.regexp_replace("domain", r"\.(nl|be)", "")
    listed = lambda c, separator, default: F.when(F.size(c) > 0, F.array_join(c, separator)).otherwise(default)
    details = F.concat(F.lit("Lead-generation portal ("), "domain", F.lit("). GTM: "), listed("gtm", ", ", "None"), F.lit(". Violations: "), listed("deceptive_claims", "; ", "Leadgen portal front"))
    made = [
        F.initcap(F.replace(bare, F.lit("-"), F.lit(" "))), F.concat(F.lit(SYNDICATE_SEARCH), bare), F.lit(SYNDICATE_PLACE), F.lit(f"{syndicate} - Affiliate Leadgen Front"),
        F.concat(F.lit("KvK: "), listed("kvk", ", ", "Unregistered")), details,
    ]
    return footprints.select(*[c.alias(name) for c, name in zip(made, SYNDICATE_COLUMNS, strict=True)])


def review_queue(clusters: DataFrame) -> DataFrame:
    """The review queue of indicator clusters: numbered in their order, lists joined with ' | '."""
    order = ["__profiles", "__signals", "component"]
    ranked = numbered(clusters.withColumns({"__profiles": -F.col("profiles"), "__signals": -F.size("signals")}), order, "__n")
    code = F.format_string("cluster-%03d", "__n")
    return ranked.select(
        code.alias("cluster_id"), "profiles", F.array_join("targets", " | ").alias("targets"), F.col("review_ready").alias("review_ready_profiles"),
        (F.col("review_ready") < F.col("profiles")).alias("requires_manual_review"), F.array_join("signals", " | ").alias("shared_indicators"),
    )


def chain_audit(audits: DataFrame) -> DataFrame:
    """The ten columns of a chain's audit file."""
    return audits.withColumn("stuffed_parts", F.array_join("stuffed_parts", " | ")).select(*CHAIN_COLUMNS)


def rename_share(audits: DataFrame) -> DataFrame:
    """One row: audited listings, renames, and their share in percent with one decimal."""
    counted = audits.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "RENAME").alias("renames"))
    return counted.withColumn("percent", F.when(F.col("total") > 0, F.format_string("%.1f", 100 * F.col("renames") / F.col("total"))))


def explanation(points: list[str], limit: int = 1000) -> str:
    """Bullets that fit the limit, cut at a line end."""
    text = "\n".join(f"- {p}" for p in points)
    return text if len(text) <= limit else text[:limit].rpartition("\n")[0]


def explained(name: Column, register: Column, seat: Column, total: Column, violations: Column, limit: int = 1000) -> Column:
    """A dossier's explanation as a column, at most `limit` characters: bullets go from the end, whole ones first.

    violations is a list of texts; null or empty stands for the usual three. An opening that fills the limit alone stays whole.
    """
    t = vocab.EXPLANATION
    said = F.when(F.size(violations) > 0, violations).otherwise(F.array(*[F.lit(r) for r in vocab.EXPLANATION_RULES]))
    filled = lambda c, default: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(t[default]))
    opening = F.format_string(t["opening"], name, filled(register, "register"), filled(seat, "seat"), total.cast("long"))
    closing = F.format_string(t["closing"], total.cast("long"))
    bullets = F.array_join(F.transform(said, lambda v: F.concat(F.lit("- "), v, F.lit("\n"))), "")
    room = F.greatest(F.lit(limit) - F.length(opening) - F.length(closing), F.lit(0))
    fitting = F.when(F.length(bullets) <= room, bullets).otherwise(F.regexp_extract(F.substr(bullets, F.lit(1), room), r"(?s)^(.*\n)", 1))
    return F.concat(opening, fitting, closing)
