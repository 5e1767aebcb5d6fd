"""Networks of linked listings: clustering, score, projection, indicator clusters, hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import vocab
from ledgerlens.functions.normalize import any_contained, hub_address, let, plain_address, plain_host, plain_phone, text
from ledgerlens.operators.components import connected_components
from ledgerlens.operators.linkage import star_edges
from ledgerlens.plans.storage import checkpointed


def members(keyed: DataFrame, least: int = 2) -> DataFrame:
    """(component, id) of all components of `least` or more businesses; component is the least id."""
    found = connected_components(star_edges(keyed))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return found.join(sizes.select("component"), "component", "left_semi").select("component", "id")


def _points(condition: Column, n: int, reason: str, *values: Column) -> Column:
    said = F.format_string(vocab.NETWORK_REASONS[reason], *values) if values else F.lit(vocab.NETWORK_REASONS[reason])
    return F.when(condition, F.struct(F.lit(n).alias("points"), said.alias("reason")))


def scored(member: DataFrame, biz: DataFrame) -> DataFrame:
    """One row a network: counts, suspicion score, severity, type and the reasons' points.

    address_count is the number of distinct postal codes.
    """
    filled = lambda c: F.nullif(text(F.col(c)), F.lit(""))
    prefix = F.coalesce(F.col("phone_prefix"), F.lit(""))
    joined = member.join(biz, "id")
    group = joined.groupBy("component").agg(
        F.count(F.lit(1)).alias("member_count"), F.count_distinct(filled("domain")).alias("domain_count"),
        F.count_distinct(filled("normalized_phone")).alias("phone_count"), F.count_distinct(filled("postal_code")).alias("address_count"),
        F.bool_or(F.substring(prefix, 1, 3).isin(*vocab.NON_GEOGRAPHIC)).alias("has_voip"), F.bool_or(F.contains(prefix, F.lit("369"))).alias("has_block"),
        F.min_by("name", "id").alias("name"),
    )
    m, d, p, a = (F.col(f"{x}_count") for x in ("member", "domain", "phone", "address"))
    reasons = F.array_compact(F.array(
        F.coalesce(_points(m >= 10, 25, "large", m), _points(m >= 5, 15, "linked", m), _points(m >= 2, 8, "shared", m)),
        F.coalesce(_points((d == 1) & (m >= 3), 25, "one_domain"), _points((d > 1) & (d <= 3) & (m >= 5), 15, "few_domains", d, m)),
        F.coalesce(_points((p == 1) & (m >= 2), 20, "one_phone"), _points((p > 1) & (p <= m / 2), 12, "few_phones")),
        F.coalesce(_points(F.col("has_block"), 15, "block"), _points(F.col("has_voip"), 10, "voip")),
        _points((a == 1) & (m >= 3), 20, "one_place", m),
    ))
    total = F.least(F.lit(100), F.aggregate(F.col("reasons"), F.lit(0), lambda s, r: s + r["points"]))
    severity = F.when(F.col("suspicion_score") >= 70, "CRITICAL").when(F.col("suspicion_score") >= 50, "HIGH").when(F.col("suspicion_score") >= 30, "MEDIUM").otherwise("LOW")
    kind = (
        F.when((d == 1) & (m >= 4), "LEAD_GEN_CLONE").when(F.col("has_block") | (F.col("has_voip") & (m >= 5)), "CROSS_NICHE_PBX")
        .when((a == 1) & (m >= 3), "VIRTUAL_OFFICE_HUB").otherwise("COORDINATED_CLUSTER")
    )
    return (
        group.withColumn("reasons", reasons).withColumn("suspicion_score", total.cast("int"))
        .withColumns({"severity": severity, "network_type": kind, "disclaimer": F.lit(vocab.DISCLAIMER)})
    )


def coded(networks: DataFrame) -> DataFrame:
    """Adds network_code NETWORK-00001 … in order of the least member.

    Numbering is the running count over sorted ranges, not one window over all rows.
    """
    return numbered(networks, ["component"], "n").withColumn("network_code", F.format_string("NETWORK-%05d", F.col("n"))).drop("n")


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Adds 1, 2, 3 … in the order of columns whose values are unique together.

    Ranges are sorted side by side, their sizes summed (one row a range), and each row's
    place in its range added, so no window runs over all rows.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    ranged = checkpointed(ranged)
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    within = Window.partitionBy("__range").orderBy(*order)
    return ranged.join(starts, "__range").withColumn(into, F.col("__before") + F.row_number().over(within)).drop("__range", "__before")


def propagated(biz: DataFrame, member: DataFrame, networks: DataFrame) -> DataFrame:
    """Businesses with their network's score; 0 for those in none, so no stale score stays."""
    scores = member.join(networks.select("component", "suspicion_score"), "component").select("id", "suspicion_score")
    return biz.join(scores, "id", "left").withColumn("suspicion_score", F.coalesce("suspicion_score", F.lit(0)))


def graph_nodes(member: DataFrame, biz: DataFrame) -> DataFrame:
    """(component, node, kind, label): businesses and the domains, phones and postal codes they use."""
    joined = member.join(biz, "id")
    kinds = {"domain": "domain", "phone": "normalized_phone", "postal": "postal_code"}
    own = joined.select("component", F.concat(F.lit("b:"), F.col("id").cast("string")).alias("node"), F.lit("business").alias("kind"), F.col("name").alias("label"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()])
    shared = joined.select("component", "id", "city", F.explode(pairs).alias("x")).where("x.value is not null and x.value <> ''")
    shared = shared.groupBy("component", F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(F.min_by("city", "id").alias("city"))
    label = F.when(F.col("kind") == "postal", F.concat_ws(" ", "value", "city")).otherwise(F.col("value"))
    return own.union(shared.select("component", F.concat_ws(":", "kind", "value").alias("node"), "kind", label.alias("label")))


def graph_edges(member: DataFrame, biz: DataFrame) -> DataFrame:
    """(component, source, target, relation): who uses which domain, phone and postal code."""
    joined = member.join(biz, "id")
    uses = [("domain", "domain", "USES_DOMAIN"), ("phone", "normalized_phone", "USES_PHONE"), ("postal", "postal_code", "LOCATED_AT")]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"), F.lit(r).alias("relation")) for k, c, r in uses])
    found = joined.select("component", "id", F.explode(each).alias("x")).where("x.value is not null and x.value <> ''")
    return found.select("component", F.concat(F.lit("b:"), F.col("id").cast("string")).alias("source"), F.concat_ws(":", "x.kind", "x.value").alias("target"), F.col("x.relation").alias("relation"))


def indicators(profiles: DataFrame) -> DataFrame:
    """(id, kind, value) of phone, website and address, in the key forms of the review queue."""
    pairs = [("phone", plain_phone(F.col("phone"))), ("website", plain_host(F.col("website"))), ("address", plain_address(F.col("address")))]
    exploded = profiles.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in pairs])).alias("x"))
    return exploded.select("id", "x.kind", "x.value").where("value is not null")


def indicator_clusters(profiles: DataFrame, min_shared: int = 2) -> DataFrame:
    """One row a cluster of records joined by indicators that min_shared or more records carry.

    cluster (least id), profiles, targets, signals, review_ready, sorted as a review queue:
    profiles, then signals, both falling.
    """
    found = indicators(profiles)
    shared = found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_shared).drop("n")
    linked = found.join(shared, ["kind", "value"])
    component = connected_components(star_edges(linked.select("id", F.col("kind").alias("type"), F.col("value").alias("key"))))
    signals = linked.join(component, "id").groupBy("component").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "value"))).alias("signals"))
    rows = profiles.join(component, "id").groupBy("component").agg(
        F.count(F.lit(1)).alias("profiles"), F.array_sort(F.collect_set("target_name")).alias("targets"),
        F.count_if(F.col("review_status") == "ready_for_review").alias("review_ready"),
    )
    return rows.join(signals, "component").orderBy(F.desc("profiles"), F.desc(F.size("signals")), "component")


def syndicate(profiles: DataFrame, hubs: dict[str, str], excluded: list[str]) -> DataFrame:
    """Ids of the national syndicate: VoIP-block or flexible-hub listings less those of excluded targets."""
    digits = plain_phone(F.col("phone"), least=1, rewrite_from=2)
    block = any_contained(let(digits, lambda d: F.when(F.length(d) >= 6, F.substring(d, 1, 6))), vocab.SYNDICATE_BLOCKS)
    where = F.concat_ws("\n", F.lower(text(F.col("address"))), F.lower(text(F.col("site_address"))))
    voip = profiles.where(block).select("id")
    hub = profiles.where(any_contained(where, list(hubs))).select("id")
    out = profiles.where(any_contained(text(F.col("target_name")), excluded)).select("id")
    return voip.union(hub).distinct().join(out, "id", "left_anti")


def named_syndicates(profiles: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """(syndicate, id): listings whose target's name holds one of a syndicate's words."""
    target = text(F.col("target_name"))
    each = F.array_compact(F.array(*[F.when(any_contained(target, words), name) for name, words in names.items()]))
    return profiles.select(F.explode(each).alias("syndicate"), "id")


def syndicate_rows(members: DataFrame, profiles: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a syndicate of kinds (name: type, severity): its listings, and how many phone blocks and towns they use.

    members: syndicate, id, repeats allowed. A syndicate without members has zeros; members stay rows, never a list.
    """
    digits = plain_phone(F.col("phone"), least=1, rewrite_from=2)
    used = profiles.select("id", let(digits, lambda d: F.when(F.length(d) >= 6, F.substring(d, 1, 6))).alias("block"), F.col("city").alias("town"))
    counted = members.distinct().join(used, "id").groupBy("syndicate").agg(F.count(F.lit(1)).alias("locations_count"), F.count_distinct("block").alias("phone_blocks"), F.count_distinct("town").alias("towns"))
    named = members.sparkSession.createDataFrame([(n, *k) for n, k in kinds.items()], "syndicate string, network_type string, severity string")
    return named.join(counted, "syndicate", "left").fillna(0, ["locations_count", "phone_blocks", "towns"])


def dense_hubs(profiles: DataFrame, hubs: dict[str, str], least: int = 5, shown: int = 8) -> DataFrame:
    """hub_name, total_profiles, unique_trades_count, sample_trades of hubs with `least` profiles or more."""
    where = F.concat_ws("\n", F.lower(text(F.col("address"))), F.lower(text(F.col("site_address"))))
    cases = None
    for pattern, name in hubs.items():
        hit = F.contains(where, F.lit(pattern))
        cases = F.when(hit, name) if cases is None else cases.when(hit, name)
    trade = F.substring_index(text(F.col("target_name")), " (", 1)
    placed = profiles.select(cases.alias("hub_name"), trade.alias("trade")).where("hub_name is not null")
    found = placed.groupBy("hub_name").agg(F.count(F.lit(1)).alias("total_profiles"), F.array_sort(F.collect_set("trade")).alias("trades")).where(F.col("total_profiles") >= least)
    return found.select("hub_name", "total_profiles", F.size("trades").alias("unique_trades_count"), F.slice("trades", 1, shown).alias("sample_trades"))


def corpus_metrics(profiles: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: listings, distinct websites, phones, prefixes, shared addresses, mean abuse score."""
    digits = plain_phone(F.col("phone"), least=1, rewrite_from=2)
    keyed = profiles.select(plain_host(F.col("website")).alias("host"), digits.alias("digits"), F.when(F.length(digits) >= 6, F.substring(digits, 1, 6)).alias("prefix"))
    counts = keyed.agg(F.count(F.lit(1)).alias("total_locations"), F.count_distinct("host").alias("unique_websites"), F.count_distinct("digits").alias("unique_phones"), F.count_distinct("prefix").alias("voip_prefix_clusters"))
    shared = profiles.select(hub_address(F.col("address")).alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_address_clusters"))
    mean = scores.agg(F.round(F.coalesce(F.avg("overall_score"), F.lit(0.0)), 1).alias("average_abuse_score"))
    return counts.join(shared, how="cross").join(mean, how="cross")  # one row each


def set_overlaps(sets: DataFrame) -> DataFrame:
    """(a, b, common, only_a, only_b) of every two of the named sets(name, id), a < b, in one pass over them.

    Ids become bitmaps of Spark's id ranges, 4 kB a set and range, merged by or on the
    map side; what two sets have in common is |a| + |b| - |a or b|, summed over ranges, so no
    ids are joined. Names are few (their pairs are the rows); negative and null ids have no place in a bitmap and are left out,
    repeats count once; a name whose ids are all left out has no row.
    """
    bit = sets.where("id >= 0 AND name IS NOT NULL").select("name", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"))
    maps = checkpointed(bit.groupBy("name", "bucket").agg(F.bitmap_construct_agg("bit").alias("m")))
    sizes = maps.groupBy("name").agg(F.sum(F.bitmap_count("m")).alias("n"))
    names = F.broadcast(sizes.select("name"))  # one row a set
    sides = maps.join(names.withColumnRenamed("name", "other"), F.col("name") != F.col("other"))
    either = sides.groupBy(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b"), "bucket").agg(F.bitmap_count(F.bitmap_or_agg("m")).alias("n"))
    whole = either.groupBy("a", "b").agg(F.sum("n").alias("both"))
    found = whole.join(F.broadcast(sizes.select(F.col("name").alias("a"), F.col("n").alias("na"))), "a").join(F.broadcast(sizes.select(F.col("name").alias("b"), F.col("n").alias("nb"))), "b")
    return found.select("a", "b", (F.col("na") + F.col("nb") - F.col("both")).alias("common"), (F.col("both") - F.col("nb")).alias("only_a"), (F.col("both") - F.col("na")).alias("only_b"))


def indicator_members(profiles: DataFrame, min_shared: int = 2) -> DataFrame:
    """(component, id, url): the records of the clusters of indicator_clusters with their addresses, a row each, however large a cluster."""
    found = indicators(profiles)
    shared = found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_shared).drop("n")
    component = connected_components(star_edges(found.join(shared, ["kind", "value"]).select("id", F.col("kind").alias("type"), F.col("value").alias("key"))))
    return component.join(profiles.select("id", "url"), "id").select("component", "id", "url")
