"""SQL for DuckDB that states what each query of the catalogue returns, over the same tables."""

from __future__ import annotations

from ledgerlens.functions import vocab
from ledgerlens.plans.catalog import EDGE_QUERIES, HUBS
from ledgerlens.plans.profiles import PROFILES_SQL


def _q(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _count(flags: list[str]) -> str:
    return "(" + " + ".join(f"CAST({f} AS INT)" for f in flags) + ")"


def _escaped(word: str) -> str:
    return "".join("\\" + c if c in "/.|-" else c for c in word)


def _first(text: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {_q(w)}) THEN {_q(w)}" for w in words) + " END"


P = f"profiles AS ({PROFILES_SQL})"
PHONE = """
ph1 AS (SELECT *, regexp_replace(coalesce(phone, ''), '[^0-9+]', '', 'g') AS c0 FROM profiles),
ph2 AS (SELECT *, CASE WHEN starts_with(c0, '00') THEN '+' || substr(c0, 3) ELSE c0 END AS c FROM ph1),
ph3 AS (SELECT *, regexp_replace(c, '[^0-9]', '', 'g') AS dg FROM ph2),
ph4 AS (SELECT *, CASE WHEN starts_with(c, '+31') OR (NOT starts_with(c, '+') AND starts_with(dg, '31') AND length(dg) >= 10 AND NOT starts_with(dg, '310'))
  THEN regexp_replace(substr(dg, 3), '^0', '') END AS rest FROM ph3),
ph5 AS (SELECT *, CASE WHEN rest IS NOT NULL THEN '0' || rest WHEN starts_with(c, '+') THEN '' ELSE dg END AS national,
  CASE WHEN rest IS NOT NULL THEN '+31' || rest WHEN starts_with(c, '+') AND dg <> '' THEN '+' || dg
    WHEN NOT starts_with(c, '+') AND starts_with(dg, '0') AND length(dg) >= 9 THEN '+31' || substr(dg, 2) ELSE '' END AS e164 FROM ph4),
ph AS (SELECT *, CASE WHEN starts_with(national, '06') THEN '06' WHEN starts_with(national, '0') THEN substr(national, 1, 3) ELSE '' END AS area FROM ph5)
"""
ADDRESS = """
ad1 AS (SELECT id, regexp_extract(address, '[^A-Za-z0-9]([0-9]{4} ?[A-Za-z]{2})[^A-Za-z0-9]', 1) AS hit, address FROM profiles),
ad2 AS (SELECT id, substr(hit, 1, 4) || ' ' || upper(right(hit, 2)) AS postal_code, trim(split_part(address, hit, 1), ' ,;|-') AS part,
  regexp_replace(trim(split_part(address, hit, 2), ' ,;|-'), '(?i),?\\s*(the )?(netherlands|nederland|nl)\\s*$', '') AS city FROM ad1),
ad3 AS (SELECT *, regexp_extract(part, '([0-9]{1,6})(-([A-Za-z0-9]{1,8}))?$', 1) AS house_number, upper(regexp_extract(part, '([0-9]{1,6})(-([A-Za-z0-9]{1,8}))?$', 3)) AS addition,
  trim(regexp_replace(part, '([0-9]{1,6})(-([A-Za-z0-9]{1,8}))?$', ''), ' ,;|-') AS street FROM ad2),
ad AS (SELECT *, regexp_replace(lower(postal_code || house_number || addition), '[^a-z0-9]', '', 'g') AS normalized_key FROM ad3)
"""


def _url(source: str, key: str, url: str) -> str:
    two = ", ".join(map(_q, vocab.TWO_LABEL_SUFFIXES))
    return f"""
u1 AS (SELECT {key}, CASE WHEN regexp_matches({url}, '(?i)^[a-z][a-z0-9+.-]*://') THEN {url} ELSE 'https://' || {url} END AS u FROM {source} WHERE {url} IS NOT NULL),
u2 AS (SELECT {key}, lower(regexp_extract(u, '^([^:]+)://', 1)) AS scheme, regexp_replace(u, '^[^:]+://', '') AS rest FROM u1),
u3 AS (SELECT {key}, scheme, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM u2),
u4 AS (SELECT *, string_split(host, '.') AS ls, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({two}) THEN 3 ELSE 2 END AS w,
  array_to_string(list_transform(list_filter(string_split(query, '&'), lambda q: q <> '' AND NOT regexp_matches(split_part(q, '=', 1), {_q(vocab.TRACKING_KEYS)})),
    lambda q: CASE WHEN contains(q, '=') THEN q ELSE q || '=' END), '&') AS kept FROM u3),
urls AS (SELECT {key}, scheme, CASE WHEN len(ls) >= w THEN array_to_string(ls[-w:], '.') ELSE host END AS domain,
  CASE WHEN len(ls) > w THEN regexp_replace(CASE WHEN array_to_string(ls[1:len(ls) - w], '.') = 'www' THEN '' ELSE array_to_string(ls[1:len(ls) - w], '.') END, '^www\\.', '') ELSE '' END AS subdomain,
  scheme || '://' || host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical_url FROM u4)
"""


_LEGAL = "(?i)(,?\\s*(b\\.?\\s*v\\.?|bv|vof|nv|ltd\\.?|llc|inc\\.?|gmbh))\\.?\\s*$"
BIZ = f"""
{P}, {PHONE}, {ADDRESS}, {_url("profiles", "id", "website")},
biz AS (SELECT ph.id, ph.name, ph.city, ph.address, nullif(national, '') AS normalized_phone, nullif(substr(national, 1, 6), '') AS phone_prefix, urls.domain,
  nullif(ad.postal_code, '') AS postal_code, nullif(ad.house_number, '') AS house_number, ph.target_name,
  lower(trim(regexp_replace(trim(regexp_replace(replace(ph.name, '|', ' '), '\\s+', ' ', 'g'), ' ,;|:-/'), '{_LEGAL}', ''), ' ,;|:-/')) AS normalized_name
  FROM ph LEFT JOIN ad USING (id) LEFT JOIN urls USING (id))
"""
KEYS = f"""
{BIZ},
keys AS (
  SELECT id, 'SAME_PHONE' AS t, normalized_phone AS k, 1.0 AS w FROM biz WHERE length(normalized_phone) >= 8
  UNION ALL SELECT id, 'SHARED_VOIP_BLOCK', phone_prefix, 0.75 FROM biz WHERE length(phone_prefix) = 6
  UNION ALL SELECT id, 'SAME_DOMAIN', lower(domain), 1.0 FROM biz WHERE domain <> '' AND domain NOT IN ({", ".join(map(_q, vocab.PLATFORM_HOSTS))})
  UNION ALL SELECT id, 'SAME_ADDRESS', upper(postal_code) || '_' || house_number, 0.95 FROM biz WHERE postal_code IS NOT NULL AND house_number IS NOT NULL
  UNION ALL SELECT id, 'SIMILAR_NAME', normalized_name, 0.7 FROM biz WHERE length(normalized_name) >= 4
  UNION ALL SELECT id, 'SHARED_PARCEL_CHAIN', {_first("lower(address)", vocab.PARCEL_CHAINS)}, 0.85 FROM biz
  UNION ALL SELECT id, 'SHARED_FLEX_HUB', {_first("lower(address)", [k.lower() for k in vocab.VIRTUAL_KEYWORDS])}, 0.85 FROM biz
  UNION ALL SELECT id, 'SHARED_FLEX_HUB', {_first("lower(address)", [k.lower() for k in vocab.VIRTUAL_ADDRESSES])}, 0.85 FROM biz),
edges AS (SELECT a.id AS source_business_id, b.id AS target_business_id, a.t AS relationship_type, min(a.k) AS shared_key, CAST(min(a.w) AS DOUBLE) AS weight
  FROM keys a JOIN keys b ON a.t = b.t AND a.k = b.k AND a.id < b.id GROUP BY 1, 2, 3)
"""
REACH = """
both_ways AS (SELECT DISTINCT source_business_id AS a, target_business_id AS b FROM edges UNION SELECT target_business_id, source_business_id FROM edges),
reach(id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
members AS (SELECT least(min(other), id) AS component, id FROM reach GROUP BY id)
"""
NETWORKS = """
counted AS (SELECT component, count(*) AS member_count, count(DISTINCT nullif(domain, '')) AS domain_count, count(DISTINCT normalized_phone) AS phone_count,
  count(DISTINCT postal_code) AS address_count, bool_or(coalesce(substr(phone_prefix, 1, 3) IN ('085', '088'), false)) AS voip, bool_or(contains(coalesce(phone_prefix, ''), '369')) AS block
  FROM members JOIN biz USING (id) GROUP BY component),
pointed AS (SELECT *, CAST(least(100,
  CASE WHEN member_count >= 10 THEN 25 WHEN member_count >= 5 THEN 15 WHEN member_count >= 2 THEN 8 ELSE 0 END
  + CASE WHEN domain_count = 1 AND member_count >= 3 THEN 25 WHEN domain_count BETWEEN 2 AND 3 AND member_count >= 5 THEN 15 ELSE 0 END
  + CASE WHEN phone_count = 1 AND member_count >= 2 THEN 20 WHEN phone_count > 1 AND phone_count * 2 <= member_count THEN 12 ELSE 0 END
  + CASE WHEN block THEN 15 WHEN voip THEN 10 ELSE 0 END + CASE WHEN address_count = 1 AND member_count >= 3 THEN 20 ELSE 0 END) AS INT) AS suspicion_score FROM counted),
networks AS (SELECT component, 'NETWORK-' || lpad(CAST(row_number() OVER (ORDER BY component) AS VARCHAR), 5, '0') AS network_code, member_count, domain_count, phone_count, address_count, suspicion_score,
  CASE WHEN suspicion_score >= 70 THEN 'CRITICAL' WHEN suspicion_score >= 50 THEN 'HIGH' WHEN suspicion_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN domain_count = 1 AND member_count >= 4 THEN 'LEAD_GEN_CLONE' WHEN block OR (voip AND member_count >= 5) THEN 'CROSS_NICHE_PBX'
    WHEN address_count = 1 AND member_count >= 3 THEN 'VIRTUAL_OFFICE_HUB' ELSE 'COORDINATED_CLUSTER' END AS network_type FROM pointed)
"""
_DELIMITERS = "(" + " + ".join(f"(length(name) - length(replace(name, {_q(d)}, ''))) / {len(d)}" for d in vocab.SCORE_DELIMITERS) + ")"
_MODIFIERS = _count([f"regexp_matches(lower(name), {_q(chr(92) + 'b' + _escaped(m) + chr(92) + 'b')})" for m in vocab.SCORE_MODIFIERS])
SCORES = f"""
{P},
kw0 AS (SELECT *, CAST({_DELIMITERS} AS INT) AS dl, {_MODIFIERS} AS n_modifiers,
  contains(lower(name), lower(city)) AND length(trim(regexp_replace(name, '(?i)' || city, '', 'g'), ' -|:–—/')) >= 3 AS added, len(regexp_extract_all(name, '[\\pL\\pN_]+')) AS words FROM profiles),
kw AS (SELECT *, CAST(least(100, CASE WHEN dl >= 2 THEN 35 WHEN dl = 1 THEN 15 ELSE 0 END + 20 * n_modifiers + CASE WHEN added THEN 25 ELSE 0 END + CASE WHEN words >= 6 THEN 20 ELSE 0 END) AS INT) AS score FROM kw0),
abuse AS (SELECT *, CAST(least(100, floor(score * 3 / 10)
  + CASE WHEN {_any("lower(address)", vocab.FLEX_KEYWORDS)} OR {_any("lower(actual_occupant)", vocab.FLEX_KEYWORDS)} OR {_any("lower(site_address)", vocab.FLEX_KEYWORDS)} OR contains(lower(actual_occupant), 'unstaffed') THEN 35 ELSE 0 END
  + CASE WHEN {_any("regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')", vocab.PBX_BLOCKS)} THEN 25 WHEN substr(coalesce(phone, ''), 1, 3) IN ('085', '088') THEN 15 ELSE 0 END
  + CASE WHEN {_any("lower(coalesce(kvk_status, ''))", ["unregistered", "onbekend", "ghost"])} THEN 15 ELSE 0 END
  + CASE WHEN network_cluster_size > 1 THEN 15 ELSE 0 END) AS INT) AS overall_score FROM kw)
"""
_FULL = "lower(name || ' ' || address || ' ' || snippet)"


def _audit(hq: str) -> str:
    head = f"contains(lower(address), {_q(hq.lower())})" if hq else "false"
    return f"""
{SCORES},
au0 AS (SELECT *, {head} AS head, {_any(_FULL, [k.lower() for k in vocab.VIRTUAL_KEYWORDS])} OR {_any("lower(address)", [a.lower() for a in vocab.VIRTUAL_ADDRESSES])} AS office,
  {_any(_FULL, vocab.PARCEL_CHAINS)} AS parcel, {_any(_FULL, vocab.RESIDENTIAL_TERMS)} AS home, {_any("name", vocab.AUDIT_DELIMITERS)} AS delim FROM abuse),
au1 AS (SELECT *, delim AND NOT office AND NOT parcel AND NOT home AS stuffed, office OR parcel OR overall_score >= 65 AS rep FROM au0),
au2 AS (SELECT *, office OR parcel OR home OR stuffed OR (overall_score >= 50 OR score >= 50) AS signs FROM au1),
audited AS (SELECT id, name, website, address, actual_occupant, kvk_status,
  CASE WHEN head THEN 'headquarters' WHEN NOT rep AND signs THEN 'needs_review' WHEN stuffed THEN 'keyword_stuffing' WHEN home THEN 'residential' WHEN parcel THEN 'parcel_dropoff' WHEN office THEN 'virtual_office' ELSE 'clean' END AS violation_category,
  CASE WHEN head THEN 'clean' WHEN rep THEN 'ready_for_review' WHEN signs THEN 'needs_evidence' ELSE 'clean' END AS review_status,
  NOT head AND rep AS is_reportable, CASE WHEN NOT head THEN overall_score END AS spam_score FROM au2)
"""


def _conf(score: str, signal: str) -> str:
    return f"CASE WHEN NOT ({signal}) THEN 'LOW' WHEN {score} >= 75 THEN 'HIGH' WHEN {score} >= 45 THEN 'MEDIUM' ELSE 'LOW' END"


_CITIES = sorted(vocab.DETECTOR_CITIES, key=len, reverse=True)
_CITY_LIST = "list_filter([" + ", ".join(map(_q, _CITIES)) + "], lambda w: regexp_matches(lower(name), '(^|[^a-z])' || w || '([^a-z]|$)'))"
_CHAINS = sorted(vocab.FLEX_CHAINS, key=len, reverse=True)
_TITLE = "list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:]))"
_BATCHED = f"""{_audit('')}, batched AS (SELECT id, violation_category, row_number() OVER (PARTITION BY violation_category ORDER BY id) AS n FROM audited WHERE review_status = 'ready_for_review' AND is_reportable),
routed AS (SELECT id, violation_category, violation_category || '-' || lpad(CAST(CAST(floor((n - 1) / 20) AS BIGINT) + 1 AS VARCHAR), 3, '0') AS batch_id,
  CASE violation_category {" ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in vocab.ROUTES.items())} ELSE 'manual_review' END AS route FROM batched)"""
_HUB_CASE = "CASE " + " ".join(f"WHEN contains(lower(address) || chr(10) || lower(coalesce(site_address, '')), {_q(p)}) THEN {_q(n)}" for p, n in HUBS.items()) + " END"
_DIGITS = "regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')"
_LOCAL = f"CASE WHEN starts_with({_DIGITS}, '31') THEN '0' || substr({_DIGITS}, 3) ELSE {_DIGITS} END"
_QUEUE = f"CASE WHEN starts_with({_DIGITS}, '31') AND length({_DIGITS}) >= 11 THEN '0' || substr({_DIGITS}, 3) ELSE {_DIGITS} END"
_HOST = "nullif(regexp_replace(lower(regexp_extract(regexp_replace(coalesce({0}, ''), '^(?i)[a-z]+://', ''), '^([^@/?#]*@)?([^/?#:]*)', 2)), '^www\\.', ''), '')"
_HOST_W = _HOST.format("website")
_AKEY = "regexp_replace(lower(coalesce(address, '')), '[^a-z0-9]', '', 'g')"
_SNAP = "snap AS (SELECT user_id AS business_id, ts, event_id, event_type AS name, CASE WHEN event_id % 5 <> 0 THEN upper(event_type) END AS category FROM events)"
_CHANGE = "SELECT business_id, event_id, '{1}' AS event_type, old AS previous_val, {0} AS new_val FROM (SELECT *, lag({0}) OVER (PARTITION BY business_id ORDER BY ts, event_id) AS old FROM snap) z WHERE old <> '' AND {0} <> '' AND lower(old) <> lower({0})"


#: Networks by phone and domain with their codes, and the whole networks that take over the code of their largest part.
LINEAGE = f"""RECURSIVE {KEYS}, {REACH},
first_ways AS (SELECT DISTINCT source_business_id AS a, target_business_id AS b FROM edges WHERE relationship_type IN ('SAME_PHONE', 'SAME_DOMAIN') UNION SELECT target_business_id, source_business_id FROM edges WHERE relationship_type IN ('SAME_PHONE', 'SAME_DOMAIN')),
first_reach(id, other) AS (SELECT a, b FROM first_ways UNION SELECT r.id, e.b FROM first_reach r JOIN first_ways e ON r.other = e.a),
first AS (SELECT least(min(other), id) AS part, id FROM first_reach GROUP BY id),
first_codes AS (SELECT part, row_number() OVER (ORDER BY part) AS n FROM (SELECT DISTINCT part FROM first)),
common AS (SELECT n, component, count(*) AS common FROM first JOIN first_codes USING (part) JOIN members USING (id) GROUP BY n, component),
heirs AS (SELECT component, n, row_number() OVER (PARTITION BY component ORDER BY common DESC, n) AS place FROM common),
fresh AS (SELECT component, (SELECT coalesce(max(n), 0) FROM first_codes) + row_number() OVER (ORDER BY component) AS n FROM (SELECT DISTINCT component FROM members WHERE component NOT IN (SELECT component FROM heirs))),
coded AS (SELECT component, 'NETWORK-' || lpad(CAST(n AS VARCHAR), 5, '0') AS code, false AS is_new FROM heirs WHERE place = 1 UNION ALL SELECT component, 'NETWORK-' || lpad(CAST(n AS VARCHAR), 5, '0'), true FROM fresh)"""

#: What becomes of the titles of the synthetic listings, by the template they were made from.
SANITIZED = f"""{P}, t AS (SELECT *, CAST(floor(id / 12) AS BIGINT) AS b, id % 12 AS r, contains('dak' || CAST(floor(id / 12) AS BIGINT) || lower(city), '24') AS named FROM profiles),
judged AS (SELECT id, city, name, r, b,
  CASE WHEN r IN (0, 3, 6) THEN 'RENAME' WHEN r = 1 THEN 'REMOVE' ELSE 'KEEP' END AS action,
  CASE r WHEN 0 THEN CASE WHEN named THEN '24' ELSE 'Acme ' || b END WHEN 1 THEN '' WHEN 3 THEN 'Jansen ' || b WHEN 6 THEN 'Klus ' || b ELSE name END AS clean_name,
  CASE r WHEN 0 THEN '7 spoed|' || CASE WHEN named THEN 'Acme ' || b || ' Utrecht' ELSE '24' END WHEN 1 THEN 'Noord Dak ' || b || '|beste service' WHEN 3 THEN 'delft' WHEN 6 THEN 'erkend & betaalbaar' ELSE '' END AS removed_parts,
  CAST(CASE r WHEN 0 THEN 90 WHEN 1 THEN 95 WHEN 3 THEN 85 WHEN 6 THEN 90 ELSE 80 END AS INT) AS confidence,
  CASE r WHEN 0 THEN 'separators part the title into 3' || CASE WHEN named THEN '|the website''s domain names the part 24|parts removed: 7 spoed, Acme ' || b || ' Utrecht' ELSE '|parts removed: 7 spoed, 24' END
    WHEN 1 THEN 'every part is a service, a place or a claim' WHEN 3 THEN 'trailing town removed: delft'
    WHEN 6 THEN 'separators part the title into 2|parts removed: erkend & betaalbaar' ELSE 'no separators or added keywords found' END AS reasons FROM t)"""


#: Evidence of audited listings: the categories' signals, then, from 50 points on, what the scores were given for.
_T = {k: v.replace("%d", "%s").split("%s") for k, v in vocab.TRIGGERS.items()}


def _said(key: str, value: str | None = None) -> str:
    return " || ".join([_q(_T[key][0]), f"CAST({value} AS VARCHAR)", _q(_T[key][1])]) if value else _q(vocab.TRIGGERS[key])


_MOD_LIST = "list_filter([" + ", ".join(map(_q, vocab.SCORE_MODIFIERS)) + "], lambda m: regexp_matches(lower(name), '(^|[^a-z0-9_])' || m || '([^a-z0-9_]|$)'))"
_FLEX = f"({_any('lower(address)', vocab.FLEX_KEYWORDS)} OR {_any('lower(actual_occupant)', vocab.FLEX_KEYWORDS)} OR {_any('lower(site_address)', vocab.FLEX_KEYWORDS)} OR contains(lower(actual_occupant), 'unstaffed'))"
_BLOCK = _any("regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')", vocab.PBX_BLOCKS)
EVIDENCE = f"""
SELECT id, array_to_string(list_filter([CASE WHEN office THEN 'known_virtual_office' END, CASE WHEN parcel THEN 'parcel_or_partner_location' END, CASE WHEN home THEN 'residential_address_indicator' END, CASE WHEN stuffed THEN 'possible_keyword_stuffing' END]
    || CASE WHEN overall_score >= 50 OR score >= 50 THEN [CASE WHEN dl >= 2 THEN {_said("delimiters", "dl")} WHEN dl = 1 THEN {_said("delimiter")} END, CASE WHEN n_modifiers > 0 THEN {_said("modifiers", f"array_to_string({_MOD_LIST}, ', ')")} END,
      CASE WHEN added THEN {_said("city", "upper(city[1]) || lower(city[2:])")} END, CASE WHEN words >= 6 THEN {_said("words", "words")} END, CASE WHEN {_FLEX} THEN {_said("flex", "coalesce(nullif(actual_occupant, ''), 'Regus/Spaces')")} END,
      CASE WHEN {_BLOCK} THEN {_said("block", "phone")} WHEN substr(coalesce(phone, ''), 1, 3) IN ('085', '088') THEN {_said("national", "phone")} END,
      CASE WHEN {_any("lower(coalesce(kvk_status, ''))", ["unregistered", "onbekend", "ghost"])} THEN {_said("ghost")} END, CASE WHEN network_cluster_size > 1 THEN {_said("cloned", "network_cluster_size")} END] ELSE [] END, lambda x: x IS NOT NULL), '|') AS evidence_signals,
  coalesce(nullif(kvk_status, ''), 'No commercial registration at this address') AS registration_status FROM au2"""


def oracle_sql() -> dict[str, str]:
    out = {
        "audit_evidence": f"WITH {_audit('')} {EVIDENCE}",
        "set_overlaps": f"""WITH {P}, s AS (SELECT id, unnest(list_filter([CASE WHEN contains(lower(address), 'regus') THEN 'regus' END, CASE WHEN category = 'Locksmith' THEN 'locksmiths' END, CASE WHEN kvk_status = 'Unregistered' THEN 'unregistered' END,
                CASE WHEN review_status = 'ready_for_review' THEN 'ready' END, CASE WHEN official_branch THEN 'branches' END], lambda x: x IS NOT NULL)) AS name FROM profiles),
            n AS (SELECT name, count(*) AS n FROM s GROUP BY name), c AS (SELECT x.name AS a, y.name AS b, count(*) AS common FROM s x JOIN s y ON x.id = y.id AND x.name < y.name GROUP BY 1, 2)
            SELECT p.name AS a, q.name AS b, coalesce(common, 0) AS common, p.n - coalesce(common, 0) AS only_a, q.n - coalesce(common, 0) AS only_b FROM n p JOIN n q ON p.name < q.name LEFT JOIN c ON c.a = p.name AND c.b = q.name""",
        "target_risk": f"WITH {SCORES} SELECT target_name, count(*) AS locations, round(avg(overall_score), 1) AS average_score FROM abuse GROUP BY target_name",
        "explanations": """WITH k AS (SELECT l_suppkey AS s_suppkey, count(*) AS total, list_sort(list(DISTINCT p_type)) AS kinds FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
            t AS (SELECT s_suppkey, s_name || ' (register ' || CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'number unknown' END || ') is listed at places across the country where it does not do business.' || chr(10) || chr(10)
                || 'What was found: the registered seat is ' || CASE WHEN s_nationkey % 3 <> 0 THEN 'Street ' || CAST(s_nationkey AS VARCHAR) ELSE 'not known' END || '; ' || CAST(coalesce(total, 0) AS VARCHAR) || ' further listings were audited.' || chr(10) || chr(10) || 'Rules concerned:' || chr(10) AS opening,
                chr(10) || 'The attached file lists all ' || CAST(coalesce(total, 0) AS VARCHAR) || ' audited places.' AS closing,
                CASE WHEN s_suppkey % 4 <> 0 AND len(kinds) > 0 THEN list_transform(kinds, lambda x: '- Parts of the kind ' || x || ' and others that go with it in the same place.' || chr(10)) ELSE list_transform([RULES], lambda x: '- ' || x || chr(10)) END AS bullets FROM supplier LEFT JOIN k USING (s_suppkey)),
            u AS (SELECT *, 1000 - length(opening) - length(closing) AS room FROM t),
            w AS (SELECT *, list_filter(range(1, len(bullets) + 1), lambda i: length(array_to_string(bullets[1:i], '')) <= room) AS fits FROM u)
            SELECT s_suppkey, opening || coalesce(array_to_string(bullets[1:len(fits)], ''), '') || closing AS text FROM w""".replace("RULES", ", ".join(_q(r) for r in vocab.EXPLANATION_RULES)),
        "footprint_hits": f"""SELECT url, CASE page_id % 5 WHEN 0 THEN 'GTM-AB' || CAST(page_id % 50 AS VARCHAR) || 'X' ELSE '' END AS gtm, CASE page_id % 5 WHEN 2 THEN 'Claimt eigen monteurs' ELSE '' END AS claims FROM pages WHERE page_id % 5 IN (0, 2)
            OR page_id % 5 = 1 AND regexp_matches('020 ' || CASE WHEN page_id % 2 = 0 THEN '369' ELSE '111' END || ' ' || CAST(page_id AS VARCHAR), '\\b(085[\\s\\-]?[0-9]{{3}}[\\s\\-]?[0-9]{{4}}|088[\\s\\-]?[0-9]{{3}}[\\s\\-]?[0-9]{{4}}|0[1-9][0-9][\\s\\-]?[0-9]{{3}}[\\s\\-]?[0-9]{{4}})\\b')""",
        "niche_harvest": f"""WITH c AS (SELECT page_id, {_HOST.format('url')} AS domain, regexp_extract(url, '://[^/]*/([a-z]*)/', 1) AS city FROM pages),
            f AS (SELECT split_part(domain, '.', -1) AS niche, city, arg_min(domain, page_id) AS domain FROM c GROUP BY 1, 2),
            h AS (SELECT DISTINCT domain FROM c WHERE page_id % 5 = 1 AND ({" OR ".join(f"contains(CASE WHEN page_id % 2 = 0 THEN '020369' ELSE '020111' END || CAST(page_id AS VARCHAR), {_q(b)})" for b in vocab.PBX_BLOCKS)}))
            SELECT niche, city, domain FROM f WHERE domain IN (SELECT domain FROM h)""",
        "vo_detector_full": f"""WITH {P}, f AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'Hub ' || city ELSE '' END AS hub, CASE WHEN id % 5 = 0 THEN 'werkplek bij regus in de stad' ELSE '' END AS told FROM profiles),
            g AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(lower(name || ' ' || address || ' ' || hub) || ' ' || told, '(^|[^a-z]){c}([^a-z]|$)') THEN {_q(c)}" for c in sorted(vocab.FLEX_CHAINS, key=len, reverse=True))} END AS chain, {_first("lower(address)", vocab.FLEX_STREETS)} AS street FROM f),
            s AS (SELECT *, CAST(least(100, CASE WHEN chain IS NOT NULL THEN 55 ELSE 0 END + CASE WHEN street IS NOT NULL THEN 45 ELSE 0 END + CASE WHEN address_type = 'residential' AND CASE WHEN category <> '' THEN {_any("lower(category)", vocab.SERVICE_CATEGORIES)} ELSE {_any("lower(name)", vocab.SERVICE_TITLES)} END THEN 45 ELSE 0 END) AS INT) AS score,
                CASE WHEN chain IS NOT NULL AND hub <> '' THEN hub ELSE array_to_string(list_transform(string_split(coalesce(chain, street, ''), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS hub_name FROM g)
            SELECT id, score > 0 AS signal_found, score, hub_name, CASE WHEN actual_occupant <> '' THEN actual_occupant WHEN hub_name <> '' THEN hub_name || ' (Commercial Coworking & Business Center)' ELSE 'Unverified Business Location' END AS occupant_guess FROM s""",
        "brand_guess": f"""WITH {P} SELECT id, CASE id % 12 WHEN 0 THEN 'Acme ' || CAST(CAST(floor(id / 12) AS BIGINT) AS VARCHAR) WHEN 1 THEN 'Noord Dak ' || CAST(CAST(floor(id / 12) AS BIGINT) AS VARCHAR) WHEN 3 THEN 'Jansen ' || CAST(CAST(floor(id / 12) AS BIGINT) AS VARCHAR) ELSE name END AS brand_guess FROM profiles""",
        "franchise_file": """WITH b AS (SELECT c_custkey AS k, floor(c_custkey / 3) AS g, CASE WHEN c_custkey % 2 = 0 THEN 'Delft' ELSE 'Breda' END AS town FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM b),
            a AS (SELECT *, 'Laan ' || CAST(CAST(g AS BIGINT) AS VARCHAR) || ', 1111 AA Delft' AS address, CASE WHEN n > 1 AND town = 'Breda' THEN 'REMOVE_OR_MERGE' WHEN n > 1 THEN 'MERGE_DUPLICATE' ELSE 'RENAME' END AS action FROM n)
            SELECT 'b-' || k AS slug, town, 'Keten | ' || town AS name, CASE WHEN k % 4 <> 0 THEN 'Keten' ELSE '' END AS schema_name, action,
            CASE WHEN action = 'RENAME' THEN 'Keywords added to the title' ELSE 'One of ' || n || ' branches at one address' || CASE WHEN town = 'Breda' THEN ' | Claims Breda from an address elsewhere (' || address || ')' ELSE '' END END AS violations,
            address, '020' || k AS phone, 'https://keten.example/' || k AS url, 'Heading of the landing page: ' || chr(39) || CASE WHEN k % 5 <> 0 THEN 'Keten | ' || town ELSE '' END || chr(39) AS proof FROM a""",
        "stream_changes": """WITH e AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS old FROM events)
            SELECT user_id AS business_id, epoch_us(ts) AS at_us, 'NAME_CHANGED' AS event_type, old AS previous_val, event_type AS new_val FROM e WHERE old <> event_type AND epoch_us(ts) <= ((SELECT max(epoch_us(ts)) FROM events) // 1000 - 3600000) * 1000""",
        "networks_stable": f"WITH {LINEAGE} SELECT id, component, code FROM members JOIN coded USING (component)",
        "network_lineage": f"WITH {LINEAGE} SELECT code, CASE WHEN is_new THEN 'NEW' ELSE 'KEPT' END AS event, CAST(NULL AS VARCHAR) AS other FROM coded UNION ALL SELECT 'NETWORK-' || lpad(CAST(n AS VARCHAR), 5, '0'), 'MERGED', code FROM heirs JOIN coded USING (component) WHERE place > 1",
        "name_sanitize": f"WITH {SANITIZED} SELECT id, action, clean_name, removed_parts, confidence, reasons FROM judged",
        "branch_audit": f"""WITH {SANITIZED} SELECT id, city, name AS gbp_title,
            CASE WHEN r IN (0, 1, 7) THEN 'RENAME' WHEN r IN (2, 3) THEN 'KEEP' ELSE action END AS action,
            CASE r WHEN 0 THEN 'Acme ' || b WHEN 1 THEN 'Noord Dak ' || b WHEN 7 THEN 'Klus ' || b WHEN 3 THEN name ELSE clean_name END AS proposed_name,
            CAST(CASE WHEN r IN (0, 1, 2, 3, 7) THEN 98 ELSE confidence END AS INT) AS confidence,
            CASE r WHEN 0 THEN CASE WHEN contains(CAST(b AS VARCHAR), '24') THEN '' ELSE '24|' END || '7 spoed' WHEN 1 THEN 'beste service' WHEN 3 THEN '' WHEN 7 THEN 'B.V' ELSE removed_parts END AS stuffed_parts,
            CASE r WHEN 0 THEN 'the landing page gives the name Acme ' || b || '|additions removed: ' || CASE WHEN contains(CAST(b AS VARCHAR), '24') THEN '' ELSE '24, ' END || '7 spoed' WHEN 1 THEN 'the landing page gives the name Noord Dak ' || b || '|additions removed: beste service'
              WHEN 2 THEN 'the title equals the heading or schema name of the landing page (de haan ' || b || ' bv)' WHEN 3 THEN 'the title equals the heading or schema name of the landing page (Jansen ' || b || ' | Delft)'
              WHEN 7 THEN 'the landing page gives the name Klus ' || b || '|additions removed: B.V' ELSE reasons END AS reasons FROM judged""",
        "remediation_tally": f"WITH {SANITIZED} SELECT action, CASE action WHEN 'RENAME' THEN 'MAPS_EDIT' ELSE 'REDRESSAL' END AS remediation_track, count(*) AS n FROM judged WHERE action IN ('RENAME', 'REMOVE') GROUP BY 1, 2",
        "remediation_counts": f"WITH {SANITIZED} SELECT count(*) AS total, count(*) FILTER (WHERE action = 'RENAME') AS renames, count(*) FILTER (WHERE action = 'REMOVE') AS removals, count(*) FILTER (WHERE action NOT IN ('RENAME', 'REMOVE')) AS kept FROM judged",
        "norm_phone": f"WITH {P}, {PHONE} SELECT id, e164, CASE WHEN area <> '' AND length(national) > length(area) THEN area || '-' || substr(national, length(area) + 1) ELSE national END AS national, national AS digits, substr(national, 1, 3) IN ('085', '088') AS is_voip, starts_with(national, '06') AS is_mobile, area AS area_code, substr(national, 1, 6) AS pbx_prefix_6 FROM ph",
        "norm_address": f"WITH {P}, {ADDRESS} SELECT id, postal_code, house_number, addition, street, city, 'NL' AS country, normalized_key FROM ad",
        "norm_domain_pages": f"WITH {_url('pages', 'page_id', 'url')} SELECT * FROM urls",
        "norm_dialects": f"WITH {P} SELECT id, CASE WHEN length({_QUEUE}) >= 9 THEN {_QUEUE} END AS queue_phone, nullif({_LOCAL}, '') AS network_phone, {_HOST_W} AS host, {_AKEY} AS address_key, 'v1_' || substr(md5(name || '_' || address), 1, 16) AS place_id, lower(regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g')) AS slug FROM profiles",
        "keyword_score": f"WITH {SCORES} SELECT id, name, score, CASE WHEN score < 20 THEN 'clean' WHEN score < 50 THEN 'suspicious' WHEN score < 75 THEN 'highly_suspicious' ELSE 'extreme' END AS level, n_modifiers FROM kw",
        "abuse_score": f"WITH {SCORES} SELECT id, overall_score, CASE WHEN overall_score >= 80 THEN 'CRITICAL' WHEN overall_score >= 55 THEN 'HIGH' WHEN overall_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM abuse",
        "audit_category": f"WITH {_audit('Kerkstraat 81, 1007')} SELECT id, violation_category, review_status, is_reportable, spam_score FROM audited",
        "kw_detector_titles": f"""WITH {P}, f AS (SELECT id, {_CITY_LIST} AS cs, {_count([f"contains(lower(name), {_q(m)})" for m in vocab.DETECTOR_MODIFIERS])} AS m, {_count([f"contains(name, {_q(x)})" for x in vocab.DETECTOR_DELIMITERS])} AS dl FROM profiles),
            s AS (SELECT *, CAST(least(100, CASE WHEN len(cs) > 0 THEN least(35, 15 + (len(cs) - 1) * 8) ELSE 0 END + CASE WHEN m > 0 THEN least(35, 15 + (m - 1) * 7) ELSE 0 END + least(20, 8 * dl)) AS INT) AS score, len(cs) > 0 OR m > 0 OR dl > 0 AS signal FROM f)
            SELECT id, signal AS signal_found, {_conf("score", "signal")} AS confidence, score, array_to_string(cs, '|') AS cities FROM s""",
        "vo_detector": f"""WITH {P}, f AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(lower(name || ' ' || address), '(^|[^a-z]){c}([^a-z]|$)') THEN {_q(c)}" for c in _CHAINS)} END AS chain, {_first("lower(address)", vocab.FLEX_STREETS)} AS street,
            address_type = 'residential' AND CASE WHEN category <> '' THEN {_any("lower(category)", vocab.SERVICE_CATEGORIES)} ELSE {_any("lower(name)", vocab.SERVICE_TITLES)} END AS home FROM profiles),
            s AS (SELECT *, CAST(least(100, CASE WHEN chain IS NOT NULL THEN 55 ELSE 0 END + CASE WHEN street IS NOT NULL THEN 45 ELSE 0 END + CASE WHEN home THEN 45 ELSE 0 END) AS INT) AS score FROM f)
            SELECT id, score > 0 AS signal_found, {_conf("score", "score > 0")} AS confidence, score, coalesce(array_to_string({_TITLE.format("coalesce(chain, street)")}, ' '), '') AS hub_name, CASE WHEN home THEN 'GBP-POL-SAB-01' ELSE 'GBP-POL-VO-01' END AS policy_id FROM s""",
        "leadgen_detector": f"""WITH {P}, {PHONE}, f AS (SELECT id, regexp_extract(coalesce({_HOST_W}, ''), '(?i)([a-z0-9-]{{3,20}})([-_]?)({"|".join(vocab.GEO_DOMAIN_CITIES)})\\.(nl|com|net)', 3) AS city, substr(national, 1, 6) AS p FROM ph),
            s AS (SELECT *, CAST(CASE WHEN city <> '' THEN 45 ELSE 0 END + CASE WHEN contains(p, '085') OR contains(p, '088') THEN 25 ELSE 0 END AS INT) AS score FROM f)
            SELECT id, score >= 35 AS signal_found, {_conf("score", "score >= 35")} AS confidence, score, city, CASE WHEN city <> '' THEN 'TEMPLATED_GEO_DOMAIN' ELSE 'STANDARD_LOCAL' END AS footprint_type FROM s""",
        "duplicate_pairs": f"""WITH {P}, k AS (SELECT id, {_AKEY} AS a, nullif({_DIGITS}, '') AS p, {_HOST_W} AS h, official_branch AS br FROM profiles)
            SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.id < y.id AND CAST(coalesce(x.a = y.a, false) AS INT) + CAST(coalesce(x.p = y.p, false) AS INT) + CAST(coalesce(x.h = y.h, false) AS INT) >= 2 AND NOT ((x.br OR y.br) AND coalesce(x.a <> y.a, false))""",
        "recurrence_within": """WITH e AS (SELECT event_id AS id, ts, event_type, CAST(user_id AS VARCHAR) AS p, 'd' || CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS d, json_extract_string(props, '$.k') AS z FROM events)
            SELECT r.id AS removed_id, c.id AS candidate_id, epoch_us(c.ts) - epoch_us(r.ts) AS waited_us, coalesce(r.p = c.p, false) AS shared_phone, coalesce(r.d = c.d, false) AS shared_domain, coalesce(r.z = c.z, false) AS shared_postal
            FROM e r JOIN e c ON r.event_type = 'error' AND c.event_type IN ('signup', 'purchase') AND c.ts > r.ts AND c.ts <= r.ts + INTERVAL 1 DAY AND (r.p = c.p OR r.d = c.d OR r.z = c.z)""",
        "dup_detector": f"""WITH {P}, k AS (SELECT id, {_AKEY} AS a, nullif({_DIGITS}, '') AS p, {_HOST_W} AS h, official_branch AS br FROM profiles),
            m AS (SELECT x.id, y.id AS other FROM k x JOIN k y ON x.id <> y.id AND CAST(coalesce(x.a = y.a, false) AS INT) + CAST(coalesce(x.p = y.p, false) AS INT) + CAST(coalesce(x.h = y.h, false) AS INT) >= 2 AND NOT ((x.br OR y.br) AND x.a <> y.a)),
            c AS (SELECT id, count(*) AS matches_count, CAST(least(100, count(*) * 30 + CASE WHEN count(*) >= 2 THEN 25 ELSE 0 END) AS INT) AS score FROM m GROUP BY id)
            SELECT id, matches_count, score, CASE WHEN score >= 75 THEN 'HIGH' WHEN score >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM c""",
        "edges_all": f"WITH {KEYS} SELECT * FROM edges",
        "components": f"WITH RECURSIVE {KEYS}, {REACH} SELECT component, id FROM members",
        "network_score": f"WITH RECURSIVE {KEYS}, {REACH}, {NETWORKS} SELECT * FROM networks",
        "network_propagation": f"WITH RECURSIVE {KEYS}, {REACH}, {NETWORKS} SELECT biz.id, coalesce(suspicion_score, 0) AS suspicion_score FROM biz LEFT JOIN members USING (id) LEFT JOIN networks USING (component)",
        "graph_nodes": f"""WITH RECURSIVE {KEYS}, {REACH}, j AS (SELECT * FROM members JOIN biz USING (id)) SELECT component, 'b:' || CAST(id AS VARCHAR) AS node, 'business' AS kind, name AS label FROM j
            UNION ALL SELECT component, 'domain:' || domain, 'domain', domain FROM j WHERE domain <> '' GROUP BY component, domain UNION ALL SELECT component, 'phone:' || normalized_phone, 'phone', normalized_phone FROM j WHERE normalized_phone <> '' GROUP BY component, normalized_phone
            UNION ALL SELECT component, 'postal:' || postal_code, 'postal', postal_code || ' ' || arg_min(city, id) FROM j WHERE postal_code <> '' GROUP BY component, postal_code""",
        "graph_edges": f"""WITH RECURSIVE {KEYS}, {REACH}, j AS (SELECT * FROM members JOIN biz USING (id)) SELECT component, 'b:' || CAST(id AS VARCHAR) AS source, 'domain:' || domain AS target, 'USES_DOMAIN' AS relation FROM j WHERE domain <> ''
            UNION ALL SELECT component, 'b:' || CAST(id AS VARCHAR), 'phone:' || normalized_phone, 'USES_PHONE' FROM j WHERE normalized_phone <> '' UNION ALL SELECT component, 'b:' || CAST(id AS VARCHAR), 'postal:' || postal_code, 'LOCATED_AT' FROM j WHERE postal_code <> ''""",
        "edges_induced": f"WITH {KEYS} SELECT * FROM edges WHERE relationship_type = 'SAME_PHONE' AND (source_business_id % 2 = 0 OR source_business_id % 3 = 0) AND (target_business_id % 2 = 0 OR target_business_id % 3 = 0)",
        "indicator_members": f"""WITH RECURSIVE {P}, ind AS (SELECT id, 'phone' AS kind, {_QUEUE} AS v FROM profiles WHERE length({_QUEUE}) >= 9 UNION ALL SELECT id, 'website', {_HOST_W} FROM profiles WHERE {_HOST_W} IS NOT NULL UNION ALL SELECT id, 'address', {_AKEY} FROM profiles),
            sh AS (SELECT kind, v FROM ind GROUP BY 1, 2 HAVING count(*) >= 2), li AS (SELECT ind.* FROM ind JOIN sh USING (kind, v)), hd AS (SELECT kind, v, min(id) AS h FROM li GROUP BY 1, 2),
            st AS (SELECT h AS a, id AS b FROM li JOIN hd USING (kind, v) WHERE h <> id), bw AS (SELECT a, b FROM st UNION SELECT b, a FROM st),
            re(id, other) AS (SELECT a, b FROM bw UNION SELECT r.id, e.b FROM re r JOIN bw e ON r.other = e.a), co AS (SELECT id, least(min(other), id) AS component FROM re GROUP BY id)
            SELECT component, id, website AS url FROM co JOIN profiles USING (id)""",
        "indicator_clusters": f"""WITH RECURSIVE {P}, ind AS (SELECT id, 'phone' AS kind, {_QUEUE} AS v FROM profiles WHERE length({_QUEUE}) >= 9 UNION ALL SELECT id, 'website', {_HOST_W} FROM profiles WHERE {_HOST_W} IS NOT NULL UNION ALL SELECT id, 'address', {_AKEY} FROM profiles),
            sh AS (SELECT kind, v FROM ind GROUP BY 1, 2 HAVING count(*) >= 2), li AS (SELECT ind.* FROM ind JOIN sh USING (kind, v)), hd AS (SELECT kind, v, min(id) AS h FROM li GROUP BY 1, 2),
            st AS (SELECT h AS a, id AS b FROM li JOIN hd USING (kind, v) WHERE h <> id), bw AS (SELECT a, b FROM st UNION SELECT b, a FROM st),
            re(id, other) AS (SELECT a, b FROM bw UNION SELECT r.id, e.b FROM re r JOIN bw e ON r.other = e.a), co AS (SELECT id, least(min(other), id) AS component FROM re GROUP BY id)
            SELECT component, profiles, targets, signals, review_ready FROM (SELECT component, count(*) AS profiles, array_to_string(list_sort(list_distinct(list(target_name))), '|') AS targets, count(*) FILTER (review_status = 'ready_for_review') AS review_ready FROM profiles JOIN co USING (id) GROUP BY component)
            JOIN (SELECT component, array_to_string(list_sort(list_distinct(list(kind || ':' || v))), '|') AS signals FROM li JOIN co USING (id) GROUP BY component) USING (component)""",
        "set_syndicate": f"WITH {P} SELECT id FROM profiles WHERE ((length({_LOCAL}) >= 6 AND {_any(f'substr({_LOCAL}, 1, 6)', vocab.SYNDICATE_BLOCKS)}) OR {_HUB_CASE} IS NOT NULL) AND NOT contains(target_name, 'Target 3 ') AND NOT contains(target_name, 'Target 7 ')",
        "dense_hubs": f"WITH {P}, h AS (SELECT {_HUB_CASE} AS hub_name, split_part(target_name, ' (', 1) AS trade FROM profiles) SELECT hub_name, count(*) AS total_profiles, CAST(count(DISTINCT trade) AS INT) AS unique_trades_count, array_to_string(list_sort(list_distinct(list(trade)))[1:8], '|') AS sample_trades FROM h WHERE hub_name IS NOT NULL GROUP BY hub_name HAVING count(*) >= 5",
        "corpus_metrics": f"WITH {SCORES} SELECT count(*) AS total_locations, count(DISTINCT {_HOST_W}) AS unique_websites, count(DISTINCT nullif({_LOCAL}, '')) AS unique_phones, count(DISTINCT CASE WHEN length({_LOCAL}) >= 6 THEN substr({_LOCAL}, 1, 6) END) AS voip_prefix_clusters, (SELECT count(*) FROM (SELECT {_AKEY} AS k FROM profiles GROUP BY 1 HAVING count(*) > 1 AND length({_AKEY}) > 5)) AS shared_address_clusters, round(avg(overall_score), 1) AS average_abuse_score FROM abuse",
        "franchise_colocation": f"""WITH {P}, b AS (SELECT id, 's' || CAST(id AS VARCHAR) AS slug, CASE WHEN id % 4 = 0 THEN 'Elders' ELSE city END AS town, lower('Straat ' || CAST(CAST(floor(id / 2) AS BIGINT) AS VARCHAR) || ' ' || city) AS k FROM profiles), g AS (SELECT k, count(*) AS n, list_sort(list(slug)) AS slugs FROM b GROUP BY k)
            SELECT slug, CASE WHEN n > 1 AND NOT contains(k, lower(town)) THEN 'REMOVE_OR_MERGE' WHEN n > 1 THEN 'MERGE_DUPLICATE' ELSE 'RENAME' END AS action, array_to_string(list_filter(slugs, lambda s: s <> slug), '|') AS shared_with FROM b JOIN g USING (k)""",
        "snapshot_latest": f"WITH {_SNAP} SELECT business_id, ts, name, category FROM snap QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY ts DESC, event_id DESC) = 1",
        "snapshot_diff": f"WITH {_SNAP} {_CHANGE.format('name', 'NAME_CHANGED')} UNION ALL {_CHANGE.format('category', 'CATEGORY_CHANGED')}",
        "recurrence": f"""WITH {BIZ}, gone AS (SELECT * FROM biz WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000))
            SELECT r.id AS removed_id, c.id AS candidate_id, coalesce(r.normalized_phone = c.normalized_phone, false) AS shared_phone, coalesce(r.domain = c.domain, false) AS shared_domain, coalesce(r.postal_code = c.postal_code, false) AS shared_postal
            FROM gone r JOIN biz c ON r.id <> c.id AND (r.normalized_phone = c.normalized_phone OR r.domain = c.domain OR r.postal_code = c.postal_code)""",
        "ingest_merge": f"""WITH {P}, i AS (SELECT coalesce(phone, 'none ' || CAST(id AS VARCHAR)) AS place_id, arg_max(name, id) AS name FROM profiles GROUP BY 1), e AS (SELECT * FROM profiles WHERE id IN (SELECT o_custkey FROM orders))
            SELECT place_id, name, coalesce((SELECT min(id) FROM e WHERE e.phone = i.place_id), (SELECT min(id) FROM e WHERE e.name = i.name)) AS matched_id FROM i""",
        "insert_ignore": f"WITH {BIZ} SELECT id, normalized_phone FROM biz",
        "evidence_hash": "SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || '|LISTING|' || o_orderstatus || '|' || o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m-%d')) AS sha256_hash FROM orders",
        "evidence_integrity": "WITH e AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || '|LISTING|' || o_orderstatus || '|' || o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m-%d')) AS digest FROM orders), k AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'tampered' ELSE digest END AS kept FROM e) SELECT kept = digest AS intact, count(*) AS n FROM k GROUP BY 1",
        "norm_name": f"""WITH {P}, c AS (SELECT id, name, trim(regexp_replace(regexp_replace(name, '[|]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ,;|:-/') AS clean_name FROM profiles)
            SELECT id, clean_name, trim(regexp_replace(trim(regexp_replace(clean_name, '{_LEGAL}', ''), ' ,;|:-/'), '(?i)\\s*[-|,:/]\\s*(in|te|bij|regio)\\s+(.+)$', ''), ' ,;|:-/') AS brand_guess,
            array_to_string(regexp_extract_all(lower(clean_name), '[a-z0-9]+'), '|') AS tokens, regexp_matches(name, '[|:/-]') AS has_delimiters FROM c""",
        "follow_up_queue": "SELECT event_id AS case_id, CASE event_id % 3 WHEN 0 THEN 'SUBMITTED' WHEN 1 THEN 'awaiting_google_review' END AS status, CASE WHEN event_id % 11 = 0 THEN 'not-a-date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at FROM events WHERE event_id % 3 <> 2 AND (event_id % 11 = 0 OR date_trunc('second', ts) <= TIMESTAMP '2024-01-25 00:00:00')",
        "campaign_batches": f"WITH {_BATCHED} SELECT id, violation_category, batch_id, route FROM routed",
        "campaign_manifest": f"WITH {_BATCHED} SELECT batch_id, route, count(*) AS locations FROM routed GROUP BY 1, 2",
        "batch_parts": f"WITH {P}, n AS (SELECT id, target_name, row_number() OVER (PARTITION BY target_name ORDER BY id) AS r, count(*) OVER (PARTITION BY target_name) AS c FROM profiles), q AS (SELECT *, CAST(floor((r - 1) / 18) AS BIGINT) + 1 AS part FROM n) SELECT id, target_name, part, CASE WHEN c > 18 THEN 'Part ' || CAST(part AS VARCHAR) ELSE '' END AS part_label FROM q",
        "status_summary": "SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus ELSE 'unknown' END AS status, count(*) AS n FROM orders GROUP BY 1",
        "verification_stats": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderstatus <> 'F') AS pending FROM orders",
        "pending_verification": "SELECT o_orderkey AS case_id FROM orders WHERE (o_orderkey % 5 <> 0 AND o_orderstatus <> 'F') OR o_orderkey % 3 = 0",
        "recurrence_links": f"""WITH {BIZ}, gone AS (SELECT * FROM biz WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)),
            x AS (SELECT c.id, CAST((SELECT count(*) FROM gone r WHERE r.id <> c.id AND r.normalized_phone = c.normalized_phone) AS BIGINT) AS phone_links, CAST((SELECT count(*) FROM gone r WHERE r.id <> c.id AND r.domain = c.domain) AS BIGINT) AS domain_links, CAST((SELECT count(*) FROM gone r WHERE r.id <> c.id AND r.postal_code = c.postal_code) AS BIGINT) AS postal_links FROM biz c)
            SELECT * FROM x WHERE phone_links + domain_links + postal_links > 0""",
        "stats_dashboard": """SELECT * FROM (SELECT count(*) AS total_businesses_scanned, count(*) FILTER (c_custkey % 101 >= 30) AS potential_policy_issues FROM customer), (SELECT count(*) AS networks_detected FROM supplier),
            (SELECT count(*) FILTER (o_orderkey % 5 IN (1, 3, 4)) AS high_priority_cases, count(*) FILTER (o_custkey % 4 IN (0, 2)) AS cases_pending, count(*) FILTER (o_orderstatus = 'O') AS cases_submitted, count(*) FILTER (o_orderkey % 7 IN (1, 3, 5)) AS cases_with_observed_action FROM orders),
            (SELECT count(*) AS evidence_items FROM lineitem), (SELECT count(*) FILTER (event_type = 'purchase') AS recurrence_signals FROM events)""",
        "business_detail": """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey, l_partkey FROM lineitem)
            SELECT 'business' AS section, CAST(1 AS INT) AS position, CAST(7 AS BIGINT) AS id UNION ALL SELECT 'snapshots', CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT), o_orderkey FROM orders WHERE o_custkey = 7
            UNION ALL SELECT 'findings', CAST(row_number() OVER (ORDER BY o_orderkey DESC) AS INT), o_orderkey FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'evidence', CAST(row_number() OVER (ORDER BY id DESC) AS INT), id FROM l WHERE l_suppkey = 7
            UNION ALL SELECT 'relationships', CAST(row_number() OVER (ORDER BY id DESC) AS INT), id FROM l WHERE l_suppkey = 7 OR l_partkey = 7""",
        "policy_faults": """SELECT s_suppkey, concat_ws('|', CASE WHEN s_suppkey % 3 = 0 THEN 'category' END, CASE WHEN s_suppkey % 4 = 0 THEN 'description' END, CASE WHEN s_suppkey % 5 = 0 THEN 'official_source_url' END, CASE WHEN s_suppkey % 6 IN (0, 1) THEN 'source_date' END,
            CASE WHEN s_suppkey % 7 = 0 THEN 'severity' END, CASE WHEN s_suppkey % 8 = 0 THEN 'applicable_to' END, CASE WHEN s_suppkey % 9 = 0 THEN 'examples' END) AS broken FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 6 = 1 OR s_suppkey % 7 = 0""",
        "ingest_counters": f"""WITH {P}, i AS (SELECT id AS seq, phone AS place, name, id % 5 <> 0 AS located FROM profiles WHERE id % 17 <> 0), e AS (SELECT * FROM profiles WHERE id IN (SELECT o_custkey FROM orders)),
            u AS (SELECT * FROM i WHERE NOT coalesce(place IN (SELECT phone FROM e WHERE phone IS NOT NULL), false) AND NOT (located AND name IN (SELECT name FROM e))),
            n AS (SELECT count(*) AS inserted_businesses FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.seq < u.seq AND (o.place = u.place OR (o.located AND u.located AND o.name = u.name)))), t AS (SELECT count(*) AS snapshots_created FROM i)
            SELECT snapshots_created, inserted_businesses, snapshots_created - inserted_businesses AS updated_businesses FROM t, n""",
        "composed_address": """SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey % 3 > 1 THEN c_name END, CASE WHEN c_custkey % 4 > 1 THEN CAST(c_custkey AS VARCHAR) END, CASE WHEN c_custkey % 5 > 1 THEN '1234 AB' END, CASE WHEN c_custkey % 6 > 1 THEN 'Delft' END, 'NL') AS address FROM customer""",
        "public_maps_url": """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'https://www.google.com/maps/place/x' WHEN 1 THEN 'https://www.google.com/maps/search/?api=1&query=a' WHEN 2 THEN 'https://www.google.com/maps/place/y' ELSE 'https://www.google.com/maps/search/?api=1&query=' || s_name END AS url FROM supplier""",
        "rename_share": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS renames, printf('%.1f', 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS percent FROM orders",
        "quality_metrics": f"WITH {P}, x AS (SELECT id % 12 = 0 AS e, contains(name, '24/7') AS f FROM profiles) SELECT count(*) FILTER (f AND e) AS true_positives, count(*) FILTER (f AND NOT e) AS false_positives, count(*) FILTER (NOT f AND e) AS false_negatives, count(*) FILTER (NOT f AND NOT e) AS true_negatives FROM x",
        "search_businesses": f"WITH {BIZ} SELECT id, name, city, CAST(id % 101 AS INT) AS suspicion_score FROM biz WHERE id % 101 >= 20 AND (name ILIKE '%KLUS%' OR address ILIKE '%KLUS%' OR domain ILIKE '%KLUS%') AND city ILIKE '%delft%' ORDER BY suspicion_score DESC, id LIMIT 50 OFFSET 5",
        "niche_search": f"WITH {P} SELECT id, name FROM profiles WHERE contains(lower(name), 'bakkerij') AND contains(lower(address || name || target_name), 'breda')",
        "edges_of_business": f"WITH {KEYS} SELECT * FROM edges WHERE relationship_type IN ('SAME_PHONE', 'SAME_ADDRESS') AND (source_business_id = 7 OR target_business_id = 7)",
        "case_master_groups": f"""WITH {P}, t AS (SELECT 'Target ' || CAST(s_suppkey AS VARCHAR) || ' (NL)' AS target_name FROM supplier), s AS (SELECT 'Target ' || CAST(o_orderkey % 40 AS VARCHAR) || ' (NL)' AS target_name, o_orderkey AS case_id, o_orderstatus AS status, o_orderkey % 20 = 0 AS email_verified FROM orders)
            SELECT s.target_name, case_id, status, email_verified, count(p.id) AS locations FROM t JOIN s USING (target_name) LEFT JOIN profiles p ON p.target_name = s.target_name GROUP BY 1, 2, 3, 4""",
        "case_businesses_semi": f"WITH {P} SELECT id, name FROM profiles WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 7)",
        "review_outcomes": "WITH a AS (SELECT l_orderkey AS id, l_returnflag AS f FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1) SELECT CASE WHEN f IS NULL THEN 'POTENTIAL' WHEN f = 'A' THEN 'VERIFIED' ELSE 'REJECTED' END AS status, count(*) AS n FROM orders LEFT JOIN a ON id = o_orderkey GROUP BY 1",
        "outcome_status": "SELECT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) THEN 'ACTION_OBSERVED' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1",
        "dossier_export": f"WITH {_audit('')} SELECT name AS business_name_on_profile, coalesce(nullif(website, ''), '') AS google_maps_url, address AS physical_address, coalesce(nullif(actual_occupant, ''), 'Unstaffed Shared Facility') AS actual_occupant_and_business_type, coalesce(nullif(kvk_status, ''), 'Unregistered at this location') AS commercial_register_kvk_status, 'Policy violation' AS policy_violation_details FROM audited WHERE is_reportable",
        "page_footprint": f"""SELECT url, {_HOST.format('url')} AS domain, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'GTM-[A-Z0-9]+'))), '|') AS gtm,
            array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)(?:kvk|handelsregister|dossier)[^0-9]{{0,25}}([0-9]{{8}})\\b', 1))), '|') AS kvk, array_to_string(list_filter([{", ".join(f"CASE WHEN {_any('lower(html)', w)} THEN {_q(x)} END" for w, x in vocab.CLAIMS)}], lambda x: x IS NOT NULL), '|') AS claims, CAST(length(html) AS INT) AS html_length FROM pages""",
        "footprint_match": f"SELECT url FROM pages WHERE {_any('lower(html)', [x for w, _ in vocab.CLAIMS for x in w])} OR regexp_matches(html, 'GTM-[A-Z0-9]+') OR regexp_matches(html, '\\b(085[\\s\\-]?[0-9]{{3}}[\\s\\-]?[0-9]{{4}}|088[\\s\\-]?[0-9]{{3}}[\\s\\-]?[0-9]{{4}}|0[1-9][0-9][\\s\\-]?[0-9]{{3}}[\\s\\-]?[0-9]{{4}})\\b')",
        "page_metadata": "SELECT url, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS h1, '' AS schema_name, '' AS address, '' AS maps_url FROM pages",
        "candidate_matrix": "SELECT DISTINCT r_name AS niche, n_name AS city, lower(r_name) || replace(lower(n_name), ' ', '') || '.' || tld AS domain, CAST(rank AS INT) AS rank FROM region, nation, (VALUES ('nl', 0), ('com', 1), ('net', 2)) v(tld, rank)",
        "token_overlap": f"""WITH {P}, w AS (SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS x, trim(regexp_replace(lower(city || ' ' || substr(name, 1, 8)), '[^a-z0-9]+', ' ', 'g')) AS y FROM profiles), z AS (SELECT *, list_distinct(string_split(x, ' ')) AS a, list_distinct(string_split(y, ' ')) AS b FROM w)
            SELECT id, CASE WHEN x = '' OR y = '' OR contains(x, y) OR contains(y, x) THEN false ELSE len(list_intersect(a, b)) / greatest(len(a), len(b)) < 0.4 END AS differs FROM z""",
        "policy_lookup": "SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'GBP-POL-NAME-01' WHEN 1 THEN 'GBP-POL-VO-01' WHEN 2 THEN 'GBP-POL-SAB-01' WHEN 3 THEN 'GBP-POL-DUP-01' WHEN 5 THEN 'GBP-POL-ADDR-01' WHEN 6 THEN 'GBP-POL-LEADGEN-01' END AS policy_id FROM supplier",
        "liveness_status": f"""WITH {P}, f AS (SELECT id, CASE WHEN id % 9 = 0 OR id % 4 = 3 THEN 'REMOVED' WHEN id % 4 = 1 THEN 'PERMANENTLY_CLOSED' WHEN id % 4 = 2 THEN 'TEMPORARILY_CLOSED' ELSE 'UNKNOWN' END AS s FROM profiles)
            SELECT id, CASE WHEN s = 'REMOVED' AND id % 7 <> 0 THEN 'CONFIRMED_REMOVED' WHEN s <> 'UNKNOWN' THEN s WHEN id % 5 = 0 THEN 'UNKNOWN' WHEN id % 2 = 0 THEN 'STILL_ACTIVE' ELSE 'ACTIVE_ADDRESS_HIDDEN' END AS status FROM f""",
    }
    out["network_detail"] = f"""WITH gn AS ({out['graph_nodes']}), ge AS ({out['graph_edges']}), m AS (SELECT min(component) AS m FROM gn)
        SELECT 'network' AS section, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'businesses', count(*) FROM gn, m WHERE component = m AND kind = 'business' UNION ALL SELECT 'nodes', count(*) FROM gn, m WHERE component = m UNION ALL SELECT 'edges', count(*) FROM ge, m WHERE component = m"""
    hot = KEYS.replace("normalized_phone AS k, 1.0 AS w FROM biz WHERE length(normalized_phone) >= 8", "CASE WHEN id % 2 = 0 THEN '201234567' ELSE normalized_phone END AS k, 1.0 AS w FROM biz WHERE id % 2 = 0 OR length(normalized_phone) >= 8")
    out["edge_classes"] = f"WITH {hot}, d AS (SELECT DISTINCT id, t, k FROM keys WHERE k IS NOT NULL) SELECT id, t AS type, k AS key, min(id) OVER (PARTITION BY t, k) AS head, count(*) OVER (PARTITION BY t, k) - 1 AS n_links FROM d QUALIFY count(*) OVER (PARTITION BY t, k) > 1"
    out["cluster_queue"] = f"""SELECT 'cluster-' || lpad(CAST(row_number() OVER (ORDER BY profiles DESC, len(string_split(signals, '|')) DESC, component) AS VARCHAR), 3, '0') AS cluster_id, profiles, replace(targets, '|', ' | ') AS targets,
        review_ready AS review_ready_profiles, review_ready < profiles AS requires_manual_review, replace(signals, '|', ' | ') AS shared_indicators FROM ({out['indicator_clusters']})"""
    sub = """WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderkey AS k, o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS ev, CASE WHEN o_orderkey % 3 = 0 THEN 'under_review' END AS gs FROM orders)"""
    now = "'2024-02-01 00:00:00'"
    live = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'REMOVED' ELSE 'STILL_ACTIVE' END END AS liveness_status, CASE WHEN c_custkey % 3 = 0 THEN '{\"k\":\"x\"}' END AS liveness_details FROM customer"
    out |= {
        "evidence_record": f"""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_custkey AS business_id, o_orderpriority AS obs, CASE WHEN o_orderkey % 3 = 0 THEN 'WEBSITE' ELSE 'MAPS_PROFILE' END AS evidence_type FROM orders)
            SELECT n + 100 AS id, 'EVD-2026-' || lpad(CAST(n + 7 AS VARCHAR), 6, '0') AS evidence_code, business_id, evidence_type, 'Supports evaluation of GBP-POL-NAME-01' AS policy_relevance,
            sha256(CAST(business_id AS VARCHAR) || '|' || evidence_type || '|' || obs || '||' || {now}) AS sha256_hash, 'GBP-POL-NAME-01' AS policy_id, 'POTENTIAL' AS status, 'Automated observation logged via ' || evidence_type AS reasoning_summary FROM o""",
        "evidence_list": "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS business_id FROM lineitem WHERE l_suppkey = 7",
        "case_summary": """WITH c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey = 7) SELECT 'case' AS section, count(*) AS n FROM c UNION ALL SELECT 'businesses', count(*) FROM customer, c WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 7)
            UNION ALL SELECT 'evidence', count(*) FROM lineitem, c WHERE l_orderkey = k UNION ALL SELECT 'submissions', count(*) FROM lineitem, c WHERE l_orderkey = k UNION ALL SELECT 'outcomes', count(*) FROM orders, c WHERE o_custkey % 50 = k""",
        "newest_edits": "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O'",
        "verify_all": f"{sub} SELECT case_id, true AS email_verified, CASE WHEN coalesce(ev, false) THEN gs ELSE 'verified' END AS google_status, CASE WHEN NOT coalesce(ev, false) THEN {now} END AS verified_at FROM s",
        "verify_events": f"{sub} SELECT DISTINCT case_id, 'email_verified' AS event_type, {now} AS created_at FROM s WHERE NOT coalesce(ev, false)",
        "external_status": f"{sub} SELECT case_id, CASE WHEN k = 7 THEN 'rejected' ELSE gs END AS google_status, CASE WHEN k = 7 THEN {now} END AS last_checked_at FROM s",
        "submission_status": f"{sub} SELECT case_id, CASE WHEN k = 7 THEN 'closed' ELSE status END AS status FROM s",
        "event_append": "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS case_id, event_type, '' AS details FROM events UNION ALL SELECT max(event_id) + 1, '7', 'reviewed', 'by hand' FROM events",
        "location_append": "SELECT s_suppkey AS id, s_name AS target_name, '{}' AS data FROM supplier UNION ALL SELECT max(s_suppkey) + 1, 'New', '{\"name\": \"x\"}' FROM supplier",
        "save_target": "SELECT s_name AS name, CAST(CASE WHEN s_nationkey < 5 THEN 99 ELSE s_nationkey END AS BIGINT) AS kvk FROM supplier UNION ALL SELECT 'New ' || s_name, CAST(s_nationkey + 100 AS BIGINT) FROM supplier WHERE s_nationkey >= 5 UNION ALL SELECT 'extra', 0",
        "profile_edits": f"SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN 'verified' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'proposed' END AS status, 'MAPS_EDIT' AS remediation_track, {now} AS created_at, CASE WHEN o_orderkey = 7 THEN {now} END AS last_verified_at FROM orders",
        "liveness_update": live,
        "liveness_breakdown": f"SELECT coalesce(liveness_status, 'untested') AS liveness_status, count(*) AS n FROM ({live}) GROUP BY 1",
        "liveness_untested": f"SELECT id FROM ({live}) WHERE liveness_status IS NULL ORDER BY id LIMIT 20",
        "table_scan": "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5",
        "document_scan": f"WITH {P} SELECT id, name, address, phone, website FROM profiles WHERE id % 10 <> 0",
        "target_locations": f"WITH {P} SELECT id, target_name, coalesce(nullif(website, ''), s_name) AS website FROM profiles JOIN supplier ON target_name = 'Target ' || CAST(s_suppkey AS VARCHAR) || ' (NL)'",
        "dossier_import": "SELECT s_suppkey, s_suppkey % 3 <> 0 AS is_fraud FROM supplier",
        "policy_upsert": "SELECT policy_id, title, severity, '2024-01-01 00:00:00' AS created_at FROM (VALUES " + ", ".join(f"({_q(p[0])}, {_q(p[2])}, {_q(p[3])})" for p in vocab.POLICIES) + f") v(policy_id, title, severity) WHERE policy_id <> 'GBP-POL-DUP-01' UNION ALL SELECT CASE n_nationkey WHEN 0 THEN 'GBP-POL-DUP-01' ELSE 'GBP-POL-' || upper(n_name) || '-01' END, 'Rules of ' || n_name, 'HIGH', {now} FROM nation",
        "orders_versions": """WITH v1 AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
            v2 AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM v1 UNION ALL SELECT -1 - o_orderkey, 'REVERSED', -o_totalprice FROM v1 WHERE o_orderstatus = 'P')
            SELECT *, CAST(1 AS INT) AS version FROM v1 UNION ALL SELECT *, 2 FROM v2 UNION ALL SELECT *, 3 FROM v2 WHERE o_totalprice <= 300000""",
        "delete_rows": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 4 = 0 OR o_orderstatus <> 'F'",
        "status_latest": "SELECT user_id AS case_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "syndicate_file": f"""WITH f AS ({out['page_footprint']}), b AS (SELECT *, regexp_replace(domain, '\\.(nl|be)', '', 'g') AS bare FROM f)
            SELECT array_to_string(list_transform(string_split(replace(bare, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name, 'https://www.google.com/maps/search/' || bare AS url, 'Netherlands (National / Virtual Dispatch)' AS address, 'Ring - Affiliate Leadgen Front' AS occupant,
            'KvK: ' || CASE WHEN kvk = '' THEN 'Unregistered' ELSE replace(kvk, '|', ', ') END AS kvk, 'Lead-generation portal (' || domain || '). GTM: ' || CASE WHEN gtm = '' THEN 'None' ELSE replace(gtm, '|', ', ') END || '. Violations: ' || CASE WHEN claims = '' THEN 'Leadgen portal front' ELSE replace(claims, '|', '; ') END AS details FROM b""",
        "case_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '4-' || lpad(CAST(o_orderkey AS VARCHAR), 13, '8') END AS case_number, CASE WHEN length(o_orderpriority) * 10 > 98 THEN substr(repeat(o_orderpriority, 10), 1, 95) || '...' ELSE repeat(o_orderpriority, 10) END AS title FROM orders",
        "place_keys": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '0x1a:0x2b' ELSE 'https://maps.example/data=!1snone!8m' || CAST(c_custkey AS VARCHAR) END AS place_key, c_custkey % 5 IN (0, 2, 3) AS flag FROM customer",
        "first_of_place": f"WITH {P} SELECT phone, min(id) AS id, arg_min(name, id) AS name FROM profiles WHERE phone IS NOT NULL GROUP BY phone",
        "syndicate_summary": f"""WITH {P}, x AS (SELECT *, CASE WHEN length({_LOCAL}) >= 6 THEN substr({_LOCAL}, 1, 6) END AS block, CASE WHEN contains(target_name, 'Target 3 ') THEN 'drop-off' WHEN contains(target_name, 'Target 7 ') OR contains(target_name, 'Target 11 ') THEN 'locksmiths'
            WHEN (length({_LOCAL}) >= 6 AND {_any(f'substr({_LOCAL}, 1, 6)', vocab.SYNDICATE_BLOCKS)}) OR {_HUB_CASE} IS NOT NULL THEN 'national' END AS s FROM profiles)
            SELECT v.s AS syndicate, network_type, severity, count(x.s) AS locations_count, count(DISTINCT block) AS phone_blocks, count(DISTINCT city) AS towns FROM (VALUES ('national', 'VIRTUAL_OFFICE', 'CRITICAL'), ('drop-off', 'DROP_OFF', 'HIGH'), ('locksmiths', 'VIRTUAL_ADDRESS', 'CRITICAL'), ('none', 'EMPTY', 'HIGH')) v(s, network_type, severity) LEFT JOIN x ON v.s = x.s GROUP BY 1, 2, 3""",
    }
    out |= {name: f"WITH {KEYS} SELECT * FROM edges WHERE relationship_type = {_q(kind)}" for name, kind in EDGE_QUERIES.items()}
    return out
