"""URL filtering by explicit rules and, where none fits, by empirical-Bayes host reputation.

Rules name a host and the beginning of a path ("example.org/en/1"); a rule fits its host
and all subdomains of it, the longest that fits wins (then the one of the longer host, then
block). The rules are one expression, so a few hundred of them at most; the reputation
is what carries a verdict to the pages that no rule names.

Reputation: outcomes (bad or not) of labelled pages are counted by host, registered domain
and suffix. Level by level, from the whole web down, a beta prior is centred on the
posterior mean of the level above; its weight is the beta-binomial over-dispersion of that
level, by moments: with r the excess of bad pages over n * mean, the squares of r exceed the
binomial variance v by (n - 1) * v * rho, and the prior weighs 1 / rho - 1 pages. A level
whose children do not differ so leaves them at the parent's rate, one that varies lets a
host's own pages speak. A host is blocked when the lower bound of its posterior bad rate
lies over `limit`: mean - 3 deviations, which by the one-sided Chebyshev inequality leaves
at most a tenth of any posterior below it.

Everything is a DataFrame expression. Hosts, domains and suffixes are counted with
map-side sums. Rows are joined to their counts in two parts: keys that hold more than a
thousandth of the rows (fewer than a thousand keys, so they are broadcast), and the rest, among which
none is hot.

Cases: a url that is null or without "://" has an empty host and an empty path; no rule
fits it, and its reputation is that of the empty host, which has no labelled page of its
own unless the caller labels one. Userinfo and port are part of the host as given; only the
registered domain leaves them out. A host of one label, or an address, is its own domain.
Repeated rows are judged and counted as often as they occur. Other columns are ignored. No rows in,
no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import joined
from ledgerlens.plans.storage import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered (fixed values, the commonest).
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ac.jp", "com.br", "com.cn", "com.tr", "com.mx", "co.in", "co.za", "co.kr")
#: A host is blocked when the lower bound of its bad rate exceeds this.
LIMIT = 0.5
#: Deviations below the mean at which the bound lies: at most 1 / (1 + 9) of the posterior is below.
DEVIATIONS = 3.0
#: Over-dispersion where a level has no child with two labelled pages, and its range.
RHO, LEAST_RHO, MOST_RHO = 0.25, 1e-3, 0.999
MOST_RULES = 1_000


def address(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain(host: Column) -> Column:
    """The registered domain of a host."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    longer = F.substring_index(name, ".", -3)
    return F.when(name.rlike(r"^[0-9.]+$"), name).when(two.isin(*SECOND_LEVEL), longer).otherwise(two)


def suffix(registered: Column) -> Column:
    """What follows the first label of a registered domain; empty for addresses and single labels."""
    parted = F.when(registered.rlike(r"^[0-9.]+$"), "").otherwise(F.regexp_extract(registered, r"^[^.]*\.(.*)$", 1))
    return F.coalesce(parted, F.lit(""))


def by_longest(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(rule, host, path, verdict), those that win over others first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    split = [(rule, rule.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), "/" + rule.partition("/")[2], verdict) for rule, verdict in rules]
    return sorted(split, key=lambda r: (-len(r[0]), -len(r[1]), r[3] != "block", r[0]))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, of, begins, verdict in reversed(by_longest(rules)):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(begins)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def parsed(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule and named (the rule's verdict)."""
    host, path = address(F.col("url").cast("string"))
    at = pages.select("page_id", host.alias("host"), path.alias("path"))
    return at.select("page_id", "host", "path", ruled(F.col("host"), F.col("path"), rules).alias("r")).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("named"))


def _weight(children: DataFrame) -> float:
    """Pages that the prior of a level weighs; children(labelled, bad, prior)."""
    r, v = F.col("bad") - F.col("labelled") * F.col("prior"), F.col("labelled") * F.col("prior") * (1 - F.col("prior"))
    got = children.where("labelled > 1").agg(F.sum(r * r - v).alias("over"), F.sum((F.col("labelled") - 1) * v).alias("room")).first()
    rho = got["over"] / got["room"] if got["room"] else RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def _level(children: DataFrame, key: str, above: DataFrame | None, up: str, top: float) -> DataFrame:
    """children(key, up, n, labelled, bad) with prior, mean and deviation of their bad rates."""
    if above is None:
        centred = children.withColumn("prior", F.lit(top))
    else:
        centred = joined(children, above.select(up, F.col("mean").alias("prior"), F.col("kids").alias("n")), up)
    centred = checkpointed(centred)
    k = _weight(centred)
    size = F.col("labelled") + k
    mean = (F.col("bad") + k * F.col("prior")) / size
    return centred.withColumn("mean", mean).withColumn("deviation", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1)))


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, n (its rows), labelled, bad, mean, deviation of every host of outcomes(host, bad 0/1 or null)."""
    sums = [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("kids")]
    seen = outcomes.select("host", F.lit(1).alias("n"), F.col("bad").isNotNull().cast("int").alias("labelled"), F.coalesce(F.col("bad").cast("int"), F.lit(0)).alias("bad"))
    hosts = checkpointed(seen.groupBy("host").agg(*sums).withColumn("domain", domain(F.col("host"))))
    domains = checkpointed(hosts.groupBy("domain").agg(*sums).withColumn("suffix", suffix(F.col("domain"))))
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = domains.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    top = ((whole["bad"] or 0) + 1) / ((whole["labelled"] or 0) + 2)
    suffixes = _level(suffixes, "suffix", None, "", top)
    domains = _level(domains, "domain", suffixes, "suffix", top)
    return _level(hosts, "host", domains, "domain", top).select("host", "n", "labelled", "bad", "mean", "deviation")


def judged(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame | None = None, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bound (its lower bound) of every page.

    outcomes(url, bad) are labelled pages; without them, the pages that a rule names are
    the labelled ones, bad where the rule blocks.
    """
    at = parsed(pages, rules)
    if outcomes is None:
        seen = at.select("host", (F.col("named") == "block").cast("int").alias("bad"))
    else:
        host, _ = address(F.col("url").cast("string"))
        seen = outcomes.select(host.alias("host"), F.col("bad").cast("int").alias("bad")).unionByName(at.select("host", F.lit(None).cast("int").alias("bad")))
    hosts = reputations(seen)
    bound = F.col("mean") - deviations * F.col("deviation")
    verdict = F.coalesce(F.col("named"), F.when(bound > limit, "block").otherwise("allow"))
    found = joined(at, hosts.select("host", "n", "mean", "deviation"), "host")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("mean", 6).alias("bad_rate"), F.round(bound, 6).alias("bound"))
