"""Networks that keep their identity as the graph of listings changes.

Labels (id, component), the component being its least id, are stored. A delta of links is
merged into them through the quotient graph: each end is replaced by its stored label, and
only labels that the delta touches are joined up, so the work grows with the delta and not with
the graph (plus one join to relabel). Where links went away, the components that held
them are taken apart and found anew from their own links alone.

Codes pass from one snapshot's networks to the next's by largest overlap. All pairs of an
old and a new network with common members are ranked by (common members, code, component); pairs
that are best for both sides are settled together, their networks leave, and so on: the
same answer as going down the ranked list one by one, in a few rounds. What evidence and cases hang on, the
code, so follows the larger part of a network whatever becomes of its least member.

Cases: null ids and null ends are left out; repeated links count once, self-loops give a
component of one. A link that both comes and goes in one delta goes. Labels without a link
stay as they are. Ties of overlap go to the lower code, then to the lower component. No
rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.components import connected_components
from ledgerlens.operators.networks import numbered
from ledgerlens.plans.storage import checkpointed

CODE = "NETWORK-%05d"


def _links(edges: DataFrame) -> DataFrame:
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    return edges.select(a.alias("a"), b.alias("b")).dropna().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged(labels: DataFrame, added: DataFrame) -> DataFrame:
    """labels(id, component) after the links added(a, b): labels joined by them take the least one."""
    known = labels.select("id", "component")
    ends = _links(added).select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a"), F.col("b")), F.struct(F.col("b").alias("id"), F.col("a"), F.col("b")))).alias("e")).select("e.*")
    named = checkpointed(ends.join(known, "id", "left").withColumn("label", F.coalesce("component", "id")))
    quotient = named.groupBy("a", "b").agg(F.min("label").alias("least"), F.max("label").alias("most")).select(F.col("least").alias("a"), F.col("most").alias("b"))
    found = checkpointed(connected_components(quotient).select(F.col("id").alias("component"), F.col("component").alias("now")))
    kept = known.join(found.where("component <> now"), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    fresh = named.where("component is null").select("id").distinct().join(found.withColumnRenamed("component", "id"), "id").select("id", F.col("now").alias("component"))
    return kept.unionByName(fresh)


def changed(labels: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """labels after links went and came; edges(a, b) are the links before.

    Ids that have lost their last link are components of their own.
    """
    gone = checkpointed(_links(removed))
    known = labels.select("id", "component")
    ends = gone.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    torn = checkpointed(known.join(ends, "id", "left_semi").select("component").distinct())
    inside = checkpointed(known.join(torn, "component", "left_semi"))
    left = _links(edges).join(gone, ["a", "b"], "left_anti").join(inside.select(F.col("id").alias("a")), "a", "left_semi")
    again = connected_components(left.unionByName(inside.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    whole = checkpointed(known.join(torn, "component", "left_anti").select("id", "component").unionByName(again))
    return merged(whole, _links(added).join(gone, ["a", "b"], "left_anti"))


def overlaps(before: DataFrame, now: DataFrame) -> DataFrame:
    """(code, component, common) of networks with common members; before(code, id), now(component, id)."""
    return before.select("code", "id").distinct().join(now.select("component", "id").distinct(), "id").groupBy("code", "component").agg(F.count(F.lit(1)).alias("common"))


def _best(pairs: DataFrame, of: str, other: str) -> DataFrame:
    """(of, other) with most in common for each of; ties go to the least other."""
    return pairs.groupBy(of).agg(F.min(F.struct((-F.col("common")).alias("rank"), F.col(other))).alias("b")).select(of, f"b.{other}")


def matched(pairs: DataFrame) -> DataFrame:
    """(code, component) of the greedy matching of pairs(code, component, common) by falling overlap; each code and component at most once."""
    left, settled = checkpointed(pairs.select("code", "component", "common")), pairs.select("code", "component").limit(0)
    while not left.isEmpty():
        both = checkpointed(_best(left, "code", "component").join(_best(left, "component", "code"), ["code", "component"]))
        settled = settled.unionByName(both)
        left = checkpointed(left.join(both.select("code"), "code", "left_anti").join(both.select("component"), "component", "left_anti"))
    return settled


def inherited(before: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(coded, lineage) of now(component, id) after before(code, id).

    coded(component, code): an inherited code, or the next free number. lineage(code, event,
    other): KEPT; MERGED into other or GONE for codes that no network bears any more;
    SPLIT from other or NEW for networks that bear a new one.
    """
    pairs = checkpointed(overlaps(before, now))
    kept = checkpointed(matched(pairs))
    highest = before.agg(F.max(F.regexp_extract("code", r"(\d+)$", 1).cast("long"))).first()[0] or 0
    bare = now.select("component").distinct().join(kept, "component", "left_anti")
    fresh = checkpointed(numbered(bare, ["component"], "n").select("component", F.format_string(CODE, F.col("n") + highest).alias("code")))
    coded = kept.select("component", "code").unionByName(fresh)
    into = _best(pairs.join(kept.select("code"), "code", "left_anti"), "code", "component")
    codes = before.select("code").distinct().join(kept.select("code"), "code", "left_anti")
    ended = codes.join(into, "code", "left").join(coded.withColumnRenamed("code", "other"), "component", "left")
    ended = ended.select("code", F.when(F.col("other").isNull(), "GONE").otherwise("MERGED").alias("event"), "other")
    source = _best(pairs.join(fresh.select("component"), "component"), "component", "code").withColumnRenamed("code", "other")
    begun = fresh.join(source, "component", "left").select("code", F.when(F.col("other").isNull(), "NEW").otherwise("SPLIT").alias("event"), "other")
    same = kept.select("code", F.lit("KEPT").alias("event"), F.lit(None).cast("string").alias("other"))
    return coded, same.unionByName(ended).unionByName(begun)
