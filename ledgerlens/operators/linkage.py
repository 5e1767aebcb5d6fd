"""Links between listings that share infrastructure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import vocab
from ledgerlens.functions.normalize import address, domain, first_contained, phone, text
from ledgerlens.functions.score import duplicate_keys
from ledgerlens.plans.storage import checkpointed

#: Relationship types and their weights (fixed values).
WEIGHTS = {
    "SAME_PHONE": 1.0, "SAME_DOMAIN": 1.0, "SAME_ADDRESS": 0.95, "SHARED_VOIP_BLOCK": 0.75, "SHARED_FLEX_HUB": 0.85,
    "SHARED_PARCEL_CHAIN": 0.85, "SIMILAR_NAME": 0.70,
}


def brand(name: Column) -> Column:
    """Brand guess of a name with built-ins only: full-width letters and signs count as their plain forms (see normalize.business_name for all of Unicode)."""
    edge = F.lit(" \t\r\n,;|:-/")
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
    narrow = F.translate(text(name), wide, "".join(map(chr, range(0x21, 0x7F))) + " ")
    clean = F.btrim(F.regexp_replace(F.regexp_replace(narrow, r"[|]+", " "), r"\s+", " "), edge)
    bare = F.btrim(F.regexp_replace(clean, f"(?i){vocab.LEGAL_SUFFIX}", ""), edge)
    return F.btrim(F.regexp_replace(bare, r"(?i)\s*[-|,:/]\s*(?:in|te|bij|regio)\s+(.+)$", ""), edge)


def businesses(profiles: DataFrame) -> DataFrame:
    """Profiles with normalised phone, domain, address and name: the relational record of a listing."""
    made = profiles.withColumns({"__p": phone(F.col("phone")), "__a": address(F.col("address")), "__d": domain(F.col("website"))})
    return made.select(
        "id", "name", "city", "category", "address", "phone", "website", "target_name",
        F.nullif(F.col("__p.digits"), F.lit("")).alias("normalized_phone"), F.nullif(F.col("__p.pbx_prefix_6"), F.lit("")).alias("phone_prefix"),
        F.col("__p.is_voip").alias("is_voip"), F.when(text(F.col("website")) != "", F.col("__d.domain")).alias("domain"),
        F.when(text(F.col("website")) != "", F.col("__d.canonical_url")).alias("canonical_url"),
        F.nullif(F.col("__a.postal_code"), F.lit("")).alias("postal_code"), F.nullif(F.col("__a.house_number"), F.lit("")).alias("house_number"),
        F.nullif(F.lower(brand(F.col("name"))), F.lit("")).alias("normalized_name"),
    )


def keys(biz: DataFrame) -> DataFrame:
    """(id, type, key): one row for every shared-infrastructure key that a business carries."""
    raw = F.lower(text(F.col("address")))
    digits = F.regexp_replace(text(F.col("normalized_phone")), r"\D", "")
    host = F.lower(text(F.col("domain")))
    place = F.concat(F.upper(text(F.col("postal_code"))), F.lit("_"), text(F.col("house_number")))
    found = {
        "SAME_PHONE": F.when(F.length(digits) >= 8, digits),
        "SHARED_VOIP_BLOCK": F.when(F.length(text(F.col("phone_prefix"))) == 6, text(F.col("phone_prefix"))),
        "SAME_DOMAIN": F.when((host != "") & ~host.isin(*vocab.PLATFORM_HOSTS), host),
        "SAME_ADDRESS": F.when((text(F.col("postal_code")) != "") & (text(F.col("house_number")) != ""), place),
        "SIMILAR_NAME": F.when(F.length(text(F.col("normalized_name"))) >= 4, F.lower(text(F.col("normalized_name")))),
        "SHARED_PARCEL_CHAIN": first_contained(raw, vocab.PARCEL_CHAINS),
    }
    pairs = [F.struct(F.lit(t).alias("type"), k.alias("key")) for t, k in found.items()]
    pairs += [F.struct(F.lit("SHARED_FLEX_HUB").alias("type"), first_contained(raw, [w.lower() for w in ws]).alias("key")) for ws in (vocab.VIRTUAL_KEYWORDS, vocab.VIRTUAL_ADDRESSES)]
    return biz.select("id", F.explode(F.array(*pairs)).alias("k")).select("id", F.col("k.type").alias("type"), F.col("k.key").alias("key")).where("key is not null")


#: Carriers of a key that meet in one task; a key of more is dealt over tiles.
TILE = 2_048


def pairs(keyed: DataFrame, tile: int = TILE, once: bool = False) -> DataFrame:
    """(type, key, a, b), a < b: every pair of distinct carriers of a key, once; with `once`, only under the least key of a type that the two share.

    Carriers of a key of n are dealt over ceil(n / tile) parts, and the pairs of parts i <= j
    are one tile with a place in the shuffle of its own: no task joins more than two parts
    of a key, whatever the key. The rows that come out are as many as there are pairs; where
    their number is enough, `classes` is linear. A carrier brings the other keys that it has of the type, so `once`
    is seen at the pair itself: pairs are neither shuffled nor held.
    """
    listed = keyed.groupBy("type", "id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    carried = checkpointed(listed.select("type", "id", F.explode("keys").alias("key"), F.when(F.size("keys") > 1, F.col("keys")).alias("keys")))
    shared = carried.groupBy("type", "key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    dealt = carried.join(shared, ["type", "key"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = dealt.select("type", "key", F.col("id").alias("x"), F.col("keys").alias("xs"), F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    right = dealt.select("type", "key", F.col("id").alias("y"), F.col("keys").alias("ys"), F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"))
    met = left.join(right, ["type", "key", "i", "j"]).where("x < y OR (i < j AND x <> y)")
    if once:
        met = met.where("xs IS NULL OR ys IS NULL OR key = array_min(array_intersect(xs, ys))")
    return met.select("type", "key", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _weighed(found: DataFrame) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return found.withColumn("weight", F.try_element_at(weight, F.col("relationship_type")))


def _edge_rows(found: DataFrame) -> DataFrame:
    return _weighed(found.groupBy(F.col("a").alias("source_business_id"), F.col("b").alias("target_business_id"), F.col("type").alias("relationship_type")).agg(F.min("key").alias("shared_key")))


def edges(keyed: DataFrame, kinds: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """The published edge table: every pair that shares a key, once for each type, source < target."""
    met = pairs(keyed.where(F.col("type").isin(*kinds)) if kinds else keyed, tile, once=True)
    return _weighed(met.select(F.col("a").alias("source_business_id"), F.col("b").alias("target_business_id"), F.col("type").alias("relationship_type"), F.col("key").alias("shared_key")))


def neighbourhood(keyed: DataFrame, business_id: int, kinds: list[str] | None = None) -> DataFrame:
    """The edges of one business: its own keys, a handful, are broadcast, and the others' rows are only filtered by them."""
    part = keyed.where(F.col("type").isin(*kinds)) if kinds else keyed
    own = part.where(F.col("id") == business_id).select("type", "key").distinct()
    others = part.where(F.col("id") != business_id).join(F.broadcast(own), ["type", "key"], "left_semi")
    me = F.lit(business_id).cast("long")
    return _edge_rows(others.select("type", "key", F.least("id", me).alias("a"), F.greatest("id", me).alias("b")))


def classes(keyed: DataFrame) -> DataFrame:
    """(id, type, key, head, n_links): the least carrier of a shared key and how many others carry it.

    All links of `edges` in one row a carrier: linear however many share a key.
    """
    carried = keyed.distinct()
    heads = carried.groupBy("type", "key").agg(F.min("id").alias("head"), (F.count(F.lit(1)) - 1).alias("n_links")).where("n_links > 0")
    return carried.join(heads, ["type", "key"]).select("id", "type", "key", "head", "n_links")


def star_edges(keyed: DataFrame) -> DataFrame:
    """(a, b): each carrier of a key with the least carrier. Same components, linear in the carriers of a hot key.

    Keys are read twice here, and are dear to make: they are made once.
    """
    carried = checkpointed(keyed)
    heads = carried.groupBy("type", "key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return carried.join(heads, ["type", "key"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()


def duplicates(profiles: DataFrame) -> DataFrame:
    """id, matches_count, score, confidence: other profiles with two or more equal identities.

    Official branches at distinct addresses do not count. No pair is written: those that
    share two of address A, phone P and site D number AP + AD + PD - 2 APD, and the pairs
    that the exception takes out lie in PD alone, with two different addresses, one of a
    branch, so they are a difference of counts as well. Equal profiles are counted once and
    carry their number, so a key shared by half the table is one row a combination.
    Cases: an id that repeats with equal identities is one profile; null identities equal nothing.
    """
    keys = ["address_key", "phone_key", "domain_key"]
    rows = duplicate_keys(profiles).distinct()
    cells = checkpointed(rows.groupBy(*keys, "branch").agg(F.count(F.lit(1)).alias("n")))
    branches = F.sum(F.when(F.col("branch"), F.col("n")).otherwise(0))
    placed = lambda c: F.sum(F.when(F.col("address_key").isNotNull(), c).otherwise(0))
    found = cells
    for name, on, more in (
        ("ap", keys[:2], []), ("ad", keys[::2], []), ("apd", keys, [branches.alias("apd_branches")]),
        ("pd", keys[1:], [placed(F.col("n")).alias("pd_placed"), placed(F.when(F.col("branch"), F.col("n")).otherwise(0)).alias("pd_branches")]),
    ):
        counted = cells.dropna(subset=on).groupBy(*on).agg(F.sum("n").alias(name), *more).where(F.col(name) > 1)
        found = found.join(counted, on, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    others = lambda c: F.greatest(n(c) - 1, F.lit(0))
    elsewhere = F.when(F.col("branch"), n("pd_placed") - F.when(n("pd") > 0, F.greatest(n("apd"), F.lit(1))).otherwise(0)).otherwise(n("pd_branches") - n("apd_branches"))
    exempt = F.when(F.col("address_key").isNotNull(), elsewhere).otherwise(0)
    matches = found.select(*keys, "branch", (others("ap") + others("ad") + others("pd") - 2 * others("apd") - exempt).alias("matches_count")).where("matches_count > 0")
    same = [rows[k].eqNullSafe(matches[k]) for k in [*keys, "branch"]]
    score = F.least(F.lit(100), F.col("matches_count") * 30 + F.when(F.col("matches_count") >= 2, 25).otherwise(0)).cast("int")
    return rows.join(matches, same).select("id", "matches_count", score.alias("score"), F.when(score >= 75, "HIGH").when(score >= 45, "MEDIUM").otherwise("LOW").alias("confidence"))


def duplicate_pairs(profiles: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs that `duplicates` counts, for looking into some of them; their number is the square of a group's."""
    keyed = checkpointed(duplicate_keys(profiles).distinct())
    names = {"address_key": "A", "phone_key": "P", "domain_key": "D"}
    twos = [("address_key", "phone_key"), ("address_key", "domain_key"), ("phone_key", "domain_key")]
    both = F.array(*[F.struct(F.lit(names[x] + names[y]).alias("type"), F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.to_json(F.struct(x, y))).alias("key")) for x, y in twos])
    met = pairs(keyed.select("id", F.explode(both).alias("k")).select("id", "k.type", "k.key").where("key is not null")).select("type", "a", "b").distinct()
    at = keyed.select(F.col("id").alias("a"), F.col("branch").alias("a_branch"), F.col("address_key").alias("a_address")).dropDuplicates(["a"])
    to = keyed.select(F.col("id").alias("b"), F.col("branch").alias("b_branch"), F.col("address_key").alias("b_address")).dropDuplicates(["b"])
    apart = (F.col("a_branch") | F.col("b_branch")) & F.coalesce(F.col("a_address") != F.col("b_address"), F.lit(False))
    return met.join(at, "a").join(to, "b").where(~apart).select("a", "b").distinct()


#: What a candidate can share with a removed business.
KINDS = {"phone": "normalized_phone", "domain": "domain", "postal": "postal_code"}


#: Removed, and candidates, of a key that meet in one task: no more than MEETING, as a join holds them; LEAST and more even where smaller tiles would keep more tasks busy, as a part is copied to every part of the other side.
MEETING, LEAST = 8_192, 1_024
#: Slots of key hashes whose rows are counted: a task sends no more counts than these, and a slot of small keys passes MEETING only from two thousand million rows on.
SLOTS = 1 << 18


def _met(removed: DataFrame, candidates: DataFrame, tile: int, seconds: int | None = None) -> DataFrame:
    """Pairs of rows with removed_id, candidate_id, the shared_ flags and, within seconds, waited_us (over at, in microseconds, and bucket).

    An or of equalities would compare all with all; here rows meet in equi-joins by kind and
    key, under the first kind that they share, which the pair itself tells: pairs come once
    and are neither shuffled nor held. A key that many carry is dealt over tiles of at most
    about `tile` removed and `tile` candidates, with a place in the shuffle of their own; of
    fewer if a tile would be more than a quarter of a task's share of all pairs.
    Rows are shuffled once: only the slots (of key hashes) of more rows are known
    beforehand and broadcast. Keys of a slot are dealt alike, which changes no pair.
    """
    on = ["kind", "key"] if seconds is None else ["kind", "key", "bucket"]
    values = list(KINDS)

    def listed(df: DataFrame, side: str, until: int) -> DataFrame:
        at = [] if seconds is None else [F.col("at").alias(f"{side}_at")]
        own = df.select(F.col("id").alias(f"{side}_id"), *at, *([] if seconds is None else ["bucket"]), *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in KINDS.items()])
        each = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(k).alias("key")) for n, k in enumerate(values)])
        found = own.withColumn("x", F.explode(each)).where("x.key is not null").withColumns({"kind": F.col("x.kind"), "key": F.col("x.key")}).drop("x")
        if until:
            found = found.withColumn("bucket", F.explode(F.sequence("bucket", F.col("bucket") + until)))
        later = [F.when(F.col("kind") > n, F.col(k)).alias(f"{side}_{k}") for n, k in enumerate(values[:-1])]  # what may be shared by an earlier kind
        rest = [F.when(F.col("kind") < n, F.col(k)).alias(f"{side}_more_{k}") for n, k in enumerate(values) if n]
        kept = [f"{side}_id", *([] if seconds is None else [f"{side}_at"])]
        return found.select(*kept, *on, *later, *rest, F.pmod(F.xxhash64(*on), F.lit(SLOTS)).cast("int").alias("slot"))

    gone, new = listed(removed, "removed", 0 if seconds is None else 1), listed(candidates, "candidate", 0)
    tasks = int(removed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda df, n: df.groupBy("slot").agg(F.count(F.lit(1)).alias(n))
    counted = checkpointed(count(gone, "is").join(count(new, "js"), "slot"))
    met_rows = counted.agg(F.sum(F.col("is").cast("double") * F.col("js"))).first()[0] or 0.0
    side = min(tile, max(LEAST, int((met_rows / (4 * tasks)) ** 0.5)))
    dealt = F.broadcast(counted.where((F.col("is") > side) | (F.col("js") > side)).select("slot", *[F.ceil(F.col(c) / side).cast("int").alias(c) for c in ("is", "js")]))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    placed = lambda df: df.drop("slot", "is", "js").repartition(tasks, *on, "i", "j")
    left = placed(gone.join(dealt, "slot", "left").withColumns({"i": part("removed_id", F.col("is")), "j": every(F.col("js"))}))
    right = placed(new.join(dealt, "slot", "left").withColumns({"j": part("candidate_id", F.col("js")), "i": every(F.col("is"))}))
    equal = lambda k: F.coalesce(F.col(f"removed_{k}") == F.col(f"candidate_{k}"), F.lit(False))
    met = left.join(right.hint("merge"), [*on, "i", "j"]).where(F.col("removed_id") != F.col("candidate_id"))
    waited = F.col("candidate_at") - F.col("removed_at")
    if seconds is not None:
        met = met.where((waited > 0) & (waited <= seconds * 1_000_000))
    for k in values[:-1]:
        met = met.where(~equal(k))
    flags = [((F.col("kind") == n) | equal(f"more_{k}") if n else F.col("kind") == n).alias(f"shared_{k}") for n, k in enumerate(values)]
    return met.select("removed_id", "candidate_id", *([] if seconds is None else [waited.alias("waited_us")]), *flags)


def _by_ids(removed: DataFrame, candidates: DataFrame, met: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Pairs of ids out of pairs of rows. Only the pairs of ids that come in several rows are grouped; of the others the row is the answer."""

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        often = checkpointed(df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
        if often.isEmpty():
            return df, None
        return df.join(often, "id", "left_anti"), df.join(often, "id", "left_semi")

    (gone, gone_often), (new, new_often) = split(removed), split(candidates)
    found = met(gone, new)
    for r, c in ((gone_often, candidates), (gone, new_often)):
        if r is not None and c is not None:
            several = met(r, c)
            waits = [F.min("waited_us").alias("waited_us")] if "waited_us" in several.columns else []
            found = found.unionByName(several.groupBy("removed_id", "candidate_id").agg(*waits, *[F.bool_or(f"shared_{k}").alias(f"shared_{k}") for k in KINDS]))
    return found


def recurrence(removed: DataFrame, candidates: DataFrame, tile: int = MEETING) -> DataFrame:
    """Candidates that share phone, domain or postal code with a removed business, a row for each two; see _met."""
    needed = ["id", *KINDS.values()]
    gone, new = checkpointed(removed.select(*needed)), checkpointed(candidates.select(*needed))
    return _by_ids(gone, new, lambda r, c: _met(r, c, tile))


def recurrence_within(removed: DataFrame, candidates: DataFrame, seconds: int, tile: int = MEETING) -> DataFrame:
    """As recurrence, for candidates first seen in (t, t + seconds] after a removal at t.

    removed and candidates carry `at`. Time is cut into buckets of `seconds`; a removal
    answers in its own bucket and the next, so the interval is an equi-join on (kind, key,
    bucket), and a key that many share is spread over its buckets and over tiles. Rows without a time meet nothing.
    """
    needed = ["id", "at", *KINDS.values()]
    timed = lambda df: checkpointed(df.where("at is not null").select(*needed).withColumn("at", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("bucket", F.floor(F.col("at") / (seconds * 1_000_000))))
    return _by_ids(timed(removed), timed(candidates), lambda r, c: _met(r, c, tile, seconds))


def recurrence_links(removed: DataFrame, candidates: DataFrame) -> DataFrame:
    """id and the number of other removed businesses of equal phone, domain and postal code, for candidates with any.

    The removed are counted by key first, so a key that many share costs one row a candidate.
    """
    kinds = {"phone": "normalized_phone", "domain": "domain", "postal": "postal_code"}
    pairs = lambda df: df.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in kinds.items()])).alias("x")).select("id", "x.kind", "x.key").where("coalesce(key, '') <> ''")
    gone = pairs(removed).distinct()
    counted = gone.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    hits = pairs(candidates).join(counted, ["kind", "key"]).join(gone.withColumn("own", F.lit(1)), ["id", "kind", "key"], "left")
    hits = hits.withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).where("n > 0")
    return hits.groupBy("id").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_links") for k in kinds])


def recurrence_events(links: DataFrame, at: Column) -> DataFrame:
    """A REINCARNATION_SIGNAL event for every business with links to removed ones."""
    said = F.format_string("shares with removed listings: %d by phone, %d by domain, %d by postal code", "phone_links", "domain_links", "postal_links")
    return links.select(F.col("id").alias("business_id"), F.lit("REINCARNATION_SIGNAL").alias("event_type"), said.alias("description"), at.alias("occurred_at"))
