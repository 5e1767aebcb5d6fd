"""Quality rules with robust multivariate outliers.

Every text gets plain counts; their transforms are a vector. Per language and source,
location and scatter are estimated by the minimum-covariance-determinant method: from
robust starts (medians with median deviations; means with deviations), concentration
steps re-estimate both from the share `support` of rows with the least Mahalanobis
distances until no determinant falls any more, the start with the smaller determinant wins,
and one reweighting step follows. The estimate of a language and source is drawn towards
that of all rows with the weight of `prior_rows` rows, alike for groups of every size.
A row whose squared distance exceeds the chi-square quantile `reject` is an outlier.

The statistics are one small row a text, checkpointed; each concentration step is two
grouped aggregates over them (a mergeable quantile sketch for the cut, then sums and
products), so a hot group is combined before its shuffle and no group meets in one task.
The estimates are one row a group.

Cases: null text has no words. Null lang or source form groups of their own. Groups without
a row that passes the base rules have the estimate of all rows. Constant
statistics do not make the scatter singular: each variance has a documented floor.
Repeated rows come back as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans.storage import checkpointed

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\r\x0b\x0c"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["x_length", "x_word", "x_symbols", "x_lines", "x_repeats"]
#: Least standard deviation of each statistic: differences below it carry no signal.
FLOORS = [0.25, 0.05, 0.05, 0.05, 0.08]
#: What a text may repeat at no cost: one line and the words of a short line, twice; never over this share of the text.
FREE_LINES, FREE_WORDS, FREE_SHARE = 1.0, 24.0, 0.2
#: Upper 0.9999 quantile of chi-square with five degrees of freedom (fixed value).
REJECT = 25.745
#: Quantiles 0.975 and 0.75 of the same law, for reweighting and the support's scale (fixed values).
REWEIGHT, MIDDLE = 12.833, 6.626
#: A log determinant that falls by less has settled.
CONVERGED = 1e-3


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats, n = 0, len(words)
    if n > 3:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = [number[w] for w in words]
        k = len(number)
        windows = [(a * k + b) * k + c for a, b, c in zip(ids, ids[1:], ids[2:], strict=False)]
        if len(set(windows)) < len(windows):
            seen: set[int] = set()
            twice = {w for w in windows if w in seen or seen.add(w)}
            end = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeats += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def _beyond(repeated: Column, free: float, size: Column) -> Column:
    """What is repeated beyond the free part of a text of that size."""
    return F.greatest(repeated - F.least(F.lit(free), FREE_SHARE * size), F.lit(0.0))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, n_lines, base_failed and the transformed statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            found = [counts(t) for t in texts]
            columns = [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 5)]
            lines = pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, lines], ["doc_id", "lang", "source", *COUNTS, "n_lines"])

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    )
    rows = read.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_lines"]))
    some, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return rows.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log1p("n_words").alias("x_length"),
        F.log1p(F.col("word_chars") / some).alias("x_word"),
        F.log1p(20 * F.col("n_symbols") / some).alias("x_symbols"),
        F.log1p(5 * _beyond(F.col("n_dup_lines"), FREE_LINES, lines) / lines).alias("x_lines"),
        F.log1p(5 * _beyond(F.col("n_repeat_words"), FREE_WORDS, some) / some).alias("x_repeats"),
    )


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: n, mean m_i and covariance c_ij (i <= j), floors added to variances."""
    p = len(STATISTICS)
    sums = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(STATISTICS)]]
    sums += [F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)]
    found = rows.groupBy(*keys).agg(*sums)
    return found.withColumns({f"c{i}{i}": F.col(f"c{i}{i}") + FLOORS[i] ** 2 for i in range(p)})


def _cholesky(est: DataFrame) -> DataFrame:
    """Adds the lower factor l_ij of the covariance and its log determinant."""
    p = len(STATISTICS)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return est.withColumn("log_det", 2 * sum((F.log(F.col(f"l{i}{i}")) for i in range(p)), F.lit(0.0)))


def _distance(scale: Column) -> dict[str, Column]:
    """The squared Mahalanobis distance by forward substitution."""
    p, solved = len(STATISTICS), {}
    for i in range(p):
        rest = F.col(STATISTICS[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved[i] = rest / F.col(f"l{i}{i}")
    return {"d2": sum((solved[i] * solved[i] for i in range(p)), F.lit(0.0)) / scale}


#: Estimates of at most so many groups (about 300 bytes each) are broadcast.
BROADCAST_GROUPS = 20_000
SALTS = 32


def _joined(rows: DataFrame, small: DataFrame, keys: list[str], few: bool | None = None) -> DataFrame:
    """rows with the one row of their group in small, never a group in one task; few: whether small is known to fit a broadcast."""
    if small.count() <= BROADCAST_GROUPS if few is None else few:
        return rows.join(F.broadcast(small), keys)
    spread = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread, [*keys, "salt"]).drop("salt")


def _measured(rows: DataFrame, est: DataFrame, keys: list[str], few: bool | None = None) -> DataFrame:
    kept = [c for c in est.columns if c in keys or c == "scale" or c[0] in "ml" and c[1:].isdigit()]
    return _joined(rows, est.select(*kept), keys, few).withColumns(_distance(F.col("scale")))


def determinants(rows: DataFrame, support: float = 0.75, most_steps: int = 30) -> DataFrame:
    """The raw estimate of each group: moments of the share `support` of rows with the least determinant found.

    rows: doc_id, group (non-null) and STATISTICS. Returns group, n, m_i, c_ij, l_ij, log_det.
    Both starts run side by side, as groups of their own; each leaves the steps once its
    determinant falls by no more than CONVERGED. `most_steps` is a bound that falling
    determinants are not known to reach.
    """
    p = len(STATISTICS)
    middle = checkpointed(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(STATISTICS)]))
    spread = _joined(rows, middle, ["group"]).groupBy("group").agg(
        F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(p)],
        *[F.percentile_approx(F.abs(F.col(c) - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, c in enumerate(STATISTICS)],
    )
    diagonal = spread.select(
        "group", F.lit(0).alias("start"), "n", *[f"m{i}" for i in range(p)],
        *[((1.4826 * F.col(f"s{i}")) ** 2 + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)],
    )
    plain = _moments(rows, ["group"]).withColumn("start", F.lit(1))
    keys = ["group", "start"]
    est = checkpointed(_cholesky(diagonal.unionByName(plain)).withColumn("scale", F.lit(1.0)))
    few = est.count() <= BROADCAST_GROUPS
    twice = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    settled = []
    for step in range(most_steps):
        near = _measured(twice, est, keys, few)
        cut = near.groupBy(*keys).agg(F.percentile_approx("d2", support, 1000).alias("cut"))
        inner = _joined(near, cut, keys, few).where("d2 <= cut")
        before = est.select(*keys, F.col("log_det").alias("before"))
        est = checkpointed(_cholesky(_moments(inner, keys)).withColumn("scale", F.lit(1.0)).join(before, keys))
        # the first step leaves the starts' own scatter, which is no subset's: none settles there
        falls = (F.col("before") - F.col("log_det") > CONVERGED) | F.lit(step == 0)
        settled.append(est.where(~falls))
        est = est.where(falls)
        if est.isEmpty():
            break
    every = reduce(DataFrame.unionByName, [*settled, est]).drop("before")
    rest = [c for c in every.columns if c not in ("group", "log_det")]
    return checkpointed(every.groupBy("group").agg(F.min(F.struct("log_det", *rest)).alias("e")).select("group", "e.*"))


def robust_estimates(rows: DataFrame, support: float = 0.75) -> DataFrame:
    """Minimum-covariance-determinant location and scatter of each group of rows, reweighted.

    rows: doc_id, group (non-null) and STATISTICS. Returns group, n, m_i, c_ij, l_ij, scale.
    """
    best = determinants(rows, support)
    half = _measured(rows, best, ["group"]).groupBy("group").agg(F.percentile_approx("d2", support, 1000).alias("q"))
    scaled = checkpointed(best.drop("scale").join(half, "group").withColumn("scale", F.greatest(F.col("q") / MIDDLE, F.lit(0.5))))
    inner = _measured(rows, scaled, ["group"]).where(f"d2 <= {REWEIGHT}")
    return checkpointed(_cholesky(_moments(inner, ["group"])).withColumn("scale", F.lit(1.0)))


EVERY = "every"


def _shrunk(groups: DataFrame, est: DataFrame, prior_rows: float) -> DataFrame:
    """Each own group's estimate drawn towards that of all rows, as if the latter stood for prior_rows rows."""
    p = len(STATISTICS)
    parts = [f"m{i}" for i in range(p)] + [f"c{i}{j}" for i in range(p) for j in range(i, p)]
    every = est.where(F.col("group") == EVERY).select(*[F.col(c).alias(f"e_{c}") for c in parts])
    own = groups.join(est.select(F.col("group").alias("own"), "n", *parts), "own", "left").join(F.broadcast(every), how="cross")  # one row
    weight = F.coalesce("n", F.lit(0)) / (F.coalesce("n", F.lit(0)) + F.lit(prior_rows))
    drawn = {c: weight * F.coalesce(c, f"e_{c}") + (1 - weight) * F.col(f"e_{c}") for c in parts}
    return _cholesky(own.select("own", *[v.alias(c) for c, v in drawn.items()])).withColumn("scale", F.lit(1.0))


def judged(docs: DataFrame, support: float = 0.75, reject: float = REJECT, prior_rows: float = 50.0) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared Mahalanobis), kept."""
    own = F.concat(F.lit("of "), F.coalesce("lang", F.lit("\0")), F.lit("\x01"), F.coalesce("source", F.lit("\0")))
    rows = checkpointed(statistics(docs).withColumn("own", own))
    sound = rows.where("not base_failed").select("doc_id", *STATISTICS, F.explode(F.array(F.col("own"), F.lit(EVERY))).alias("group"))
    chosen = checkpointed(_shrunk(rows.select("own").distinct(), robust_estimates(sound, support), prior_rows))
    measured = _measured(rows, chosen, ["own"]) if not chosen.isEmpty() else rows.withColumn("d2", F.lit(None).cast("double"))
    return measured.select(
        "doc_id", *COUNTS, "base_failed", F.col("d2").alias("distance"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= reject, F.lit(True))).alias("kept"),
    )
