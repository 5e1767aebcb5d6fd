"""Rules and host reputation against plain Python, and on odd inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hostfilter

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
PAGES = "page_id long, url string, host string, n long, mean double"


def plain_address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:end]


def plain_rule(host, path, rules):
    fits = []
    for rule, verdict in rules:
        of, _, begins = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + begins):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def plain_reputation(rows):
    """{host: (mean, deviation)} of rows (host, bad or None) by the formulas of the docstring."""
    hosts = {}
    for host, bad in rows:
        n = hosts.setdefault(host, [0, 0])
        n[0] += bad is not None
        n[1] += bad or 0

    def up(level, parent):
        out = {}
        for k, (n, b) in level.items():
            s = out.setdefault(parent(k), [0, 0])
            s[0] += n
            s[1] += b
        return out

    numeric = lambda x: bool(x) and not x.strip("0123456789.")

    def domain(h):
        name = h.rsplit("@")[-1].split(":")[0]
        return name if numeric(name) else ".".join(name.split(".")[-2:])

    suffix = lambda d: "" if numeric(d) else d.partition(".")[2]
    domains = up(hosts, domain)
    suffixes = up(domains, suffix)
    n, b = (sum(v[k] for v in suffixes.values()) for k in (0, 1))

    def level(items, prior):
        over = sum((b - n * p) ** 2 - n * p * (1 - p) for k, (n, b) in items.items() if n > 1 for p in [prior(k)])
        room = sum((n - 1) * n * p * (1 - p) for k, (n, b) in items.items() if n > 1 for p in [prior(k)])
        rho = min(max(over / room if room else 0.25, 1e-3), 0.999)
        w = 1 / rho - 1
        out = {}
        for k, (n, b) in items.items():
            m = (b + w * prior(k)) / (n + w)
            out[k] = m, (m * (1 - m) / (n + w + 1)) ** 0.5
        return out

    s = level(suffixes, lambda _: (b + 1) / (n + 2))
    d = level(domains, lambda k: s[suffix(k)][0])
    return level(hosts, lambda k: d[domain(k)][0])


@pytest.fixture(scope="module")
def pages():
    r = random.Random(4)
    urls = [None, "", "no scheme", "http://", "://", "http://ORG", "http://org/", "http://a.ORG/x", "https://u@h.example.com:80/de/?x#y", "http://10.0.0.1/a", "http://www.example.org/en/1", "http://www.example.org/en/2?a://b/c", "x://y://z/en/", "http://notexample.org/es/1", "http://sub.example.org/es/" + "a" * 100_000]
    urls += [f"http://{r.choice('abcdef')}{r.choice(['', '.x'])}.{r.choice(['site', 'blog', 'news'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['fr', 'de', 'en', 'es'])}/{r.randint(1, 99)}" for _ in range(400)]
    return [(k // 2 if k < 6 else k, u, "clash", 1, 0.5) for k, u in enumerate(urls)] + [(8, urls[8], "clash", 1, 0.5)]


def test_addresses_rules_and_verdicts_equal_plain_python(spark, pages):
    got = hostfilter.judged(spark.createDataFrame(pages, PAGES), RULES).collect()
    assert len(got) == len(pages)
    at = [plain_address(p[1]) for p in pages]
    named = [plain_rule(h, p, RULES) for h, p in at]
    rates = plain_reputation([(h, None if v is None else int(v == "block")) for (h, _), (_, v) in zip(at, named, strict=True)])
    want = []
    for p, (host, path), (rule, verdict) in zip(pages, at, named, strict=True):
        mean, deviation = rates[host]
        bound = mean - 3 * deviation
        want.append((p[0], host, path, rule, verdict or ("block" if bound > 0.5 else "allow"), pytest.approx(mean, abs=2e-6), pytest.approx(bound, abs=2e-6)))
    key = lambda r: (r[0], r[1], r[2])
    for mine, right in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert mine == right


def test_reputation_of_labelled_pages_decides_where_no_rule_fits(spark):
    """A bad host among good ones of one domain is blocked from its own pages; a host with one bad page is not."""
    rows = [("http://spam.site.net/%d" % k, int(k % 10 > 0)) for k in range(60)] + [("http://h%d.site.net/%d" % (h, k), int(k % 10 < h % 4)) for h in range(12) for k in range(40)] + [("http://once.site.net/1", 1)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    pages = spark.createDataFrame([(1, "http://spam.site.net/new"), (2, "http://h3.site.net/new"), (3, "http://once.site.net/new"), (4, "http://never.site.net/new"), (5, "http://other.example/new"), (6, "http://spam.site.net/de/x")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in hostfilter.judged(pages, [("net/de/", "allow")], outcomes).collect()}
    assert got == {1: ("block", None), 2: ("allow", None), 3: ("allow", None), 4: ("allow", None), 5: ("allow", None), 6: ("allow", "net/de/")}


def test_a_hot_host_and_no_rows(spark):
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 < 2, "http://hot.example.com/de/").otherwise(F.concat(F.lit("http://h"), "id", F.lit(".example.com/en/"))).alias("url"))
    assert hostfilter.judged(many, RULES).groupBy("host").count().where("host = 'hot.example.com'").first()["count"] == 2000
    assert hostfilter.judged(many.limit(0), RULES).count() == 0


def test_longest_rule_wins_and_lists_are_bounded():
    assert [r[0] for r in hostfilter.by_longest([("a.b/", "allow"), ("b/abc", "block"), ("b/", "allow")])] == ["b/abc", "a.b/", "b/"]
    with pytest.raises(ValueError, match="at most"):
        hostfilter.by_longest([(f"h{k}/", "allow") for k in range(1001)])
