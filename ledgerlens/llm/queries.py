"""The registered queries of the corpus operators, with production parameters, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import alignment, capfilters, contextmix, conversations, hostfilter, langid, mainhtml, mixing, packing, quality, rules, simhash, toxicity
from ledgerlens.llm.common import is_fold, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_fold(F.col("doc_id"), 4, 2)
    field = langid.fit(docs, ~held_out)
    labelled = docs.select("doc_id", held_out.alias("held_out"), langid.label(docs, field).alias("found"))
    return labelled.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~is_fold(doc_id, 4, 2))
    scored = docs.select("doc_id", is_fold(doc_id, 4, 2).alias("held_out"), toxicity.score(docs, scorer).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~is_fold(doc_id, 5, 0))
    scored = docs.select("doc_id", is_fold(doc_id, 5, 0).alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = mixing.schedule(table(spark, sf_dir, "documents"))
    return shown.select("doc_id", "source", "n_tokens", "epoch", F.col("block_rank").cast("long"), "doc_key", F.round("exponent", 6).alias("exponent"), F.round("weight", 6).alias("weight"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.score(table(spark, sf_dir, "documents"), is_fold(F.col("doc_id"), 7, 2))


def op7_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extracted(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: The rules of op11_host_filter.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op11_host_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostfilter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_langid, op2_toxicity, op3_quality, op4_mix_sources, op5_simhash, op6_context_mixing, op7_robust_rules, op8_cap_filters, op9_main_text, op10_packing,
        op11_host_filter, op12_alignment, op13_conversations,
    ]
    return {f.__name__: f for f in found}


MIXING_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT *, CAST('0x' || substr(md5('block|7|' || doc_name), 1, 8) AS BIGINT) % blocks AS blk FROM (
    SELECT doc_id, coalesce(source, chr(0)) AS k, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens,
      coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) AS doc_name FROM documents) named,
    (SELECT CAST(pow(2, greatest(10, ceil(log2(greatest(count(*), 1) / 4096.0)))) AS BIGINT) AS blocks FROM documents) sized),
totals AS (SELECT k, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY k),
whole AS (SELECT CAST(sum(tokens) AS DOUBLE) AS a, ln(count(*)) AS ln_s FROM totals WHERE tokens > 0),
p AS (SELECT tokens / a AS p FROM totals, whole WHERE tokens > 0),
ent(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM p) >= 0.97 * (SELECT ln_s FROM whole) AS up FROM ent WHERE i < 60) e),
rep(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT max(pow(p, (lo + hi) / 2 - 1)) / min(pow(p, (lo + hi) / 2 - 1)) FROM p) <= 2.0 AS ok FROM rep WHERE i < 60) r),
answer AS (SELECT greatest(
    CASE WHEN (SELECT -sum(p * ln(p)) FROM p) >= 0.97 * (SELECT ln_s FROM whole) THEN 1.0 ELSE (SELECT lo FROM ent WHERE i = 60) END,
    CASE WHEN (SELECT max(pow(p, -1)) / min(pow(p, -1)) FROM p) <= 2.0 THEN 0.0 ELSE (SELECT hi FROM rep WHERE i = 60) END) AS t),
norm AS (SELECT t, (SELECT sum(pow(p, t)) FROM p) AS z, (SELECT max(pow(p, 1 - t)) FROM p) AS most FROM answer),
priced AS (SELECT k, tokens, t AS exponent, CASE WHEN tokens > 0 THEN pow(tokens / a, t) / z ELSE 0 END AS weight,
  CAST(floor(CASE WHEN tokens > 0 THEN pow(tokens / a, t) / z ELSE 0 END * a * z * most + 1e-6) AS BIGINT) AS quota FROM totals, whole, norm),
plan AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS epochs, quota - CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END * tokens AS part FROM priced),
sizes AS (SELECT k, blk, sum(n_tokens) AS bt FROM docs GROUP BY k, blk),
eps AS (SELECT k, exponent, weight, epochs, part, unnest(range(0, CAST(epochs + CASE WHEN part > 0 THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM plan),
keyed AS (SELECT s.k, s.blk, s.bt, e.exponent, e.weight, e.epochs, e.part, e.epoch, md5('order|7|' || CAST(e.epoch AS VARCHAR) || '|' || s.k || '|' || CAST(s.blk AS VARCHAR)) AS bk FROM sizes s JOIN eps e USING (k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, epoch ORDER BY bk, blk) AS block_rank, sum(bt) OVER (PARTITION BY k, epoch ORDER BY bk, blk ROWS UNBOUNDED PRECEDING) AS upto FROM keyed),
placed AS (SELECT *, CASE WHEN epoch < epochs THEN bt ELSE part - upto + bt END AS room FROM ranked),
taken AS (SELECT * FROM placed WHERE room >= 0 AND (epoch < epochs OR room > 0 OR bt = 0)),
shown AS (SELECT d.doc_id, d.source, d.n_tokens, t.k, t.epoch, t.block_rank, md5('doc|7|' || CAST(t.epoch AS VARCHAR) || '|' || d.doc_name) AS doc_key, t.exponent, t.weight, t.room, t.room < t.bt AS border
  FROM docs d JOIN taken t USING (k, blk)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY k, epoch, border ORDER BY doc_key, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM shown)
SELECT doc_id, source, n_tokens, epoch, block_rank, doc_key, round(exponent, 6) AS exponent, round(weight, 6) AS weight FROM run WHERE NOT border OR upto <= room
"""


HOSTS_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
pl AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule, rhost, rpath, named) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
  ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
kinds AS (SELECT DISTINCT host, path FROM pl),
fits AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(named, length(rule)) AS named FROM kinds JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
named AS (SELECT page_id, host, path, rule, named FROM pl LEFT JOIN fits USING (host, path)),
h0 AS (SELECT host, count(named) AS n, count(*) FILTER (WHERE named = 'block') AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM named GROUP BY host),
h1 AS (SELECT host, n, bad, name, string_split(name, '.') AS l FROM h0),
hosts AS (SELECT host, n, bad, CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN name
    WHEN array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'or.jp', 'ac.jp', 'com.br', 'com.cn', 'com.tr', 'com.mx', 'co.in', 'co.za', 'co.kr')
    THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM h1),
domains AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, CASE WHEN regexp_matches(domain, '^[0-9.]+$') THEN '' ELSE regexp_extract(domain, '^[^.]*\.(.*)$', 1) END AS suffix FROM hosts GROUP BY domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) FROM domains) AS p FROM domains GROUP BY suffix),
sk AS (SELECT 1 / least(greatest(CASE WHEN sum((n - 1) * n * p * (1 - p)) > 0 THEN sum((bad - n * p) * (bad - n * p) - n * p * (1 - p)) / sum((n - 1) * n * p * (1 - p)) ELSE 0.25 END, 0.001), 0.999) - 1 AS k FROM s0 WHERE n > 1),
s AS (SELECT suffix, (bad + k * p) / (n + k) AS mean FROM s0, sk),
d0 AS (SELECT domain, n, bad, mean AS p FROM domains JOIN s USING (suffix)),
dk AS (SELECT 1 / least(greatest(CASE WHEN sum((n - 1) * n * p * (1 - p)) > 0 THEN sum((bad - n * p) * (bad - n * p) - n * p * (1 - p)) / sum((n - 1) * n * p * (1 - p)) ELSE 0.25 END, 0.001), 0.999) - 1 AS k FROM d0 WHERE n > 1),
d AS (SELECT domain, (bad + k * p) / (n + k) AS mean FROM d0, dk),
g0 AS (SELECT host, hosts.n, hosts.bad, mean AS p FROM hosts JOIN d USING (domain)),
gk AS (SELECT 1 / least(greatest(CASE WHEN sum((n - 1) * n * p * (1 - p)) > 0 THEN sum((bad - n * p) * (bad - n * p) - n * p * (1 - p)) / sum((n - 1) * n * p * (1 - p)) ELSE 0.25 END, 0.001), 0.999) - 1 AS k FROM g0 WHERE n > 1),
g1 AS (SELECT host, n + k AS size, (bad + k * p) / (n + k) AS mean FROM g0, gk),
g AS (SELECT host, mean, mean - 3 * sqrt(mean * (1 - mean) / (size + 1)) AS bound FROM g1)
SELECT page_id, host, path, rule, coalesce(named, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_rate, round(bound, 6) AS bound FROM named JOIN g USING (host)
"""


def oracle_sql() -> dict[str, str]:
    """Mixing and host reputation are SQL; the other operators rest on hashes, trained models or a tokenizer that SQL lacks."""
    return {"op4_mix_sources": MIXING_SQL, "op11_host_filter": HOSTS_SQL}
