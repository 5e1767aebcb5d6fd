"""Mixing sources to target weights, with DataFrame functions only.

A source's share of the tokens is raised to an exponent and normalised. The exponent is
found by bisection on [0, 1]: the largest with the target entropy (a share of the entropy
of equal weights), raised where needed so that no source is repeated more than
`max_repeat` times within the budget. The budget is the least that shows every source
once in full ("cover", nothing is left out), or a number of tokens.

Weights are realised as budgeted block permutations. Each source's documents fall by a hash
of id and text into blocks, `blocks` of them or, in a large table, one for every `PER_BLOCK`
rows; every epoch orders the blocks, and the documents of a block, by
fresh hashes. Whole epochs take all; the last, partial epoch takes blocks while the
running total stays within what is left of the budget, and of the block at the border
the documents that still fit. The windows run over the blocks of a source, or over one
block's documents, never over a source.

Cases: tokens are words; null and empty texts have none. A null source is a source of its
own. A source without tokens has weight 0 and is shown once, as it costs nothing. Rows
with a null doc_id, and repeated rows, are documents like others (their ties are broken
by text hash, then arbitrarily among equal rows). Extra columns, whatever their names, are
ignored by the schedule and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.plans.storage import checkpointed

ENTROPY_SHARE = 0.97
MAX_REPEAT = 2.0
BLOCKS, PER_BLOCK = 1024, 4096
#: So many blocks (about 40 bytes each) are broadcast at most; beyond, rows are shuffled to them.
BROADCAST_BLOCKS = 500_000
STEPS = 60
WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts: str | int | Column) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _described(docs: DataFrame, seed: int) -> dict[str, Column]:
    """source_key, n_tokens, doc_name and spot (a 32-bit hash of id and text) of a row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    name = F.concat_ws("|", F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    return {
        "source_key": F.coalesce(docs["source"].cast("string"), F.lit("\0")),
        "n_tokens": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "doc_name": name,
        "spot": F.conv(F.substring(_hash("block", seed, name), 1, 8), 16, 10).cast("long"),
    }


def measured(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source_key, n_tokens, doc_name, spot: one narrow row a document."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), *[c.alias(k) for k, c in _described(docs, seed).items()])


def exponent(shares: Column, entropy_share: float, max_repeat: float, cover: bool, budget_share: Column) -> Column:
    """The exponent for an array of shares (positive, summing to 1), by two bisections.

    Entropy falls and repetition falls as the exponent grows. budget_share: budget
    over all tokens, where the budget is not "cover".
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    powers = lambda t: F.transform(shares, lambda p: F.pow(p, t))

    def entropy(t: Column) -> Column:
        # H = ln Z - t/Z * sum p^t ln p
        z = total(powers(t))
        inner = total(F.transform(shares, lambda p: F.pow(p, t) * F.log(p)))
        return F.log(z) - t * inner / z

    def repeats(t: Column) -> Column:
        # times a source is shown: budget * w / n, most for the smallest share
        ratio = F.transform(shares, lambda p: F.pow(p, t - 1))
        if cover:
            return F.array_max(ratio) / F.array_min(ratio)
        return F.array_max(ratio) / total(powers(t)) * budget_share

    def bisect(low_ok: bool, ok) -> Column:  # noqa: ANN001
        """low_ok: ok holds up to the answer, else from the answer on."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        def step(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            up = ok(mid) if low_ok else ~ok(mid)
            return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
        return end["lo"] if low_ok else end["hi"]

    target = entropy_share * F.log(F.size(shares).cast("double"))
    one = F.lit(1.0)
    by_entropy = F.when(entropy(one) >= target, one).otherwise(bisect(True, lambda t: entropy(t) >= target))
    by_repeats = F.when(repeats(F.lit(0.0)) <= max_repeat, F.lit(0.0)).otherwise(bisect(False, lambda t: repeats(t) <= max_repeat))
    return F.greatest(by_entropy, by_repeats)


def weights(rows: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeat: float = MAX_REPEAT, budget: int | None = None) -> DataFrame:
    """source_key, tokens, exponent, weight, quota (tokens), epochs (whole), part (tokens of the last epoch).

    One row a source; the list of sources, not of documents, is gathered to find the exponent.
    """
    totals = checkpointed(rows.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens")))
    listed = totals.where("tokens > 0").agg(
        F.array_sort(F.collect_list("tokens")).alias("ns"), F.sum("tokens").cast("double").alias("all")
    )
    share = listed.select("all", F.transform("ns", lambda n: n.cast("double") / F.col("all")).alias("shares"))
    asked = F.lit(float(budget or 0)) / F.col("all")
    found = share.select(
        "all", "shares",
        F.coalesce(exponent(F.col("shares"), entropy_share, max_repeat, budget is None, asked), F.lit(1.0)).alias("exponent"),
    )
    z = F.aggregate(F.transform("shares", lambda p: F.pow(p, F.col("exponent"))), F.lit(0.0), lambda a, x: a + x)
    most = F.array_max(F.transform("shares", lambda p: F.pow(p, 1 - F.col("exponent"))))
    tokens = F.lit(float(budget)) if budget is not None else F.col("all") * z * most
    one = checkpointed(found.select("all", "exponent", z.alias("z"), tokens.alias("budget"), F.lit(1).alias("one")))
    joined = totals.withColumn("one", F.lit(1)).join(one, "one", "left")  # one has a single row
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all"), F.col("exponent")) / F.col("z")).otherwise(F.lit(0.0))
    priced = joined.select("source_key", "tokens", "exponent", weight.alias("weight"), F.floor(weight * F.col("budget") + 1e-6).cast("long").alias("quota"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("long")
    return checkpointed(priced.select("*", whole.alias("epochs")).withColumn("part", F.col("quota") - F.col("epochs") * F.col("tokens")))


def _placed(rows: DataFrame, plan: DataFrame, seed: int, blocks: int) -> DataFrame:
    """The blocks that each epoch of a source shows; at most one of them, at the border, in part."""
    sizes = rows.groupBy("source_key", (F.col("spot") % blocks).cast("int").alias("blk")).agg(F.sum("n_tokens").alias("block_tokens"))
    last = F.col("epochs") + F.when(F.col("part") > 0, 0).otherwise(-1)
    epochs = plan.where(last >= 0).select("source_key", "exponent", "weight", "epochs", "part", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("epoch"))
    order = W.partitionBy("source_key", "epoch").orderBy("block_key", "blk")
    return checkpointed(
        sizes.join(epochs, "source_key")
        .withColumn("block_key", _hash("order", seed, F.col("epoch"), F.col("source_key"), F.col("blk")))
        .withColumns({"block_rank": F.row_number().over(order), "upto": F.sum("block_tokens").over(order.rowsBetween(W.unboundedPreceding, 0))})
        .withColumn("left", F.when(F.col("epoch") < F.col("epochs"), F.col("block_tokens")).otherwise(F.col("part") - F.col("upto") + F.col("block_tokens")))
        .where("left >= 0 and (epoch < epochs or left > 0 or block_tokens = 0)")
        .select("source_key", "blk", "epoch", "block_rank", "exponent", "weight", "left", (F.col("left") < F.col("block_tokens")).alias("border"))
    )


def _plan(docs: DataFrame, entropy_share: float, max_repeat: float, budget: int | None, seed: int, blocks: int) -> tuple[DataFrame, DataFrame, int]:
    """(measured rows, placed blocks, number of blocks)."""
    rows = checkpointed(measured(docs, seed))
    n = rows.count()
    while blocks * PER_BLOCK < n:
        blocks *= 2
    return rows, _placed(rows, weights(rows, entropy_share, max_repeat, budget), seed, blocks), blocks


def _within(border: DataFrame, seed: int) -> DataFrame:
    """The rows of blocks at the border that still fit, in the order of their keys; the window is over one block."""
    within = W.partitionBy("source_key", "epoch").orderBy("doc_key", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    keyed = border.withColumn("doc_key", _hash("doc", seed, F.col("epoch"), F.col("doc_name")))
    return keyed.withColumn("run", F.sum("n_tokens").over(within)).where(F.col("run") <= F.col("left")).drop("run")


def schedule(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeat: float = MAX_REPEAT, budget: int | None = None, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block_rank, doc_key, exponent, weight: one row a showing.

    Within a source, epochs follow one another, in each the blocks by block_rank, in each
    block the documents by doc_key.
    """
    rows, placed, blocks = _plan(docs, entropy_share, max_repeat, budget, seed, blocks)
    shown = rows.withColumn("blk", (F.col("spot") % blocks).cast("int")).join(placed, ["source_key", "blk"])
    whole = shown.where("not border").withColumn("doc_key", _hash("doc", seed, F.col("epoch"), F.col("doc_name")))
    source = F.when(F.col("source_key") != "\0", F.col("source_key")).alias("source")
    return whole.unionByName(_within(shown.where("border"), seed)).select("doc_id", source, "n_tokens", "epoch", "block_rank", "doc_key", "exponent", "weight")


def mixed(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeat: float = MAX_REPEAT, budget: int | None = None, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """docs with each row as often as the schedule shows it; all columns stay.

    Rows meet the list of placed blocks, which is broadcast while it is short; only the
    rows of blocks at the border are shuffled.
    """
    _, placed, blocks = _plan(docs, entropy_share, max_repeat, budget, seed, blocks)
    short = F.broadcast if placed.count() <= BROADCAST_BLOCKS else (lambda df: df)
    described = _described(docs, seed)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in described.items() if k != "n_tokens"], described["n_tokens"].alias("n_tokens"))
    rows = rows.withColumn("blk", (F.col("spot") % blocks).cast("int"))
    times = checkpointed(placed.where("not border").groupBy("source_key", "blk").agg(F.count(F.lit(1)).cast("int").alias("times")))
    whole = rows.join(short(times), ["source_key", "blk"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    cut = rows.join(short(placed.where("border").select("source_key", "blk", "epoch", "left")), ["source_key", "blk"])
    return whole.select("row.*").unionByName(_within(cut, seed).select("row.*"))
