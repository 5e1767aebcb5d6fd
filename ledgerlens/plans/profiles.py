"""Synthetic listings over the driver tables, in SQL text that Spark and DuckDB both run.

Ids fall into blocks of twelve; what listings share (phone, site, address, name) they share
within a block, so groups keep their size as the tables grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans.storage import checkpointed

BASE = """
SELECT x.*,
  CASE x.g % 4 WHEN 0 THEN '020' WHEN 1 THEN '085' WHEN 2 THEN '030' ELSE '061' END
    || lpad(CAST((x.g * 7919) % 10000000 AS STRING), 7, '0') AS nat
FROM (
  SELECT c.c_custkey AS id, c.c_name AS c_name, c.c_acctbal AS acctbal, n.n_name AS n_name,
    CAST(floor(c.c_custkey / 12) AS BIGINT) AS b, CAST(c.c_custkey % 12 AS INT) AS r, CAST(floor(c.c_custkey / 3) AS BIGINT) AS g,
    CASE CAST(floor(c.c_custkey / 12) AS BIGINT) % 5 WHEN 0 THEN 'Utrecht' WHEN 1 THEN 'Rotterdam' WHEN 2 THEN 'Breda' WHEN 3 THEN 'Delft' ELSE 'Zwolle' END AS city
  FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
) x
"""

PROFILES = f"""
SELECT id, city,
  CASE r WHEN 0 THEN 'Acme ' || CAST(b AS STRING) || ' Utrecht | 24/7 spoed' WHEN 1 THEN 'Noord Dak ' || CAST(b AS STRING) || ' - beste service'
    WHEN 2 THEN 'De Haan ' || CAST(b AS STRING) || ' B.V.' WHEN 3 THEN 'Jansen ' || CAST(b AS STRING) || ' Delft' WHEN 4 THEN 'A B C D E F ' || CAST(b AS STRING)
    WHEN 5 THEN c_name WHEN 6 THEN 'Klus ' || CAST(b AS STRING) || ': erkend & betaalbaar' WHEN 7 THEN 'Klus ' || CAST(b AS STRING) || ' B.V.'
    WHEN 8 THEN 'Bakkerij ' || CAST(b AS STRING) WHEN 9 THEN 'Bakkerij ' || CAST(b AS STRING) WHEN 10 THEN 'Spaces ' || CAST(b AS STRING)
    ELSE 'Slotenmaker ' || city || ' ' || CAST(b AS STRING) END AS name,
  CASE WHEN r = 11 THEN NULL WHEN id % 3 = 0 THEN '+31 ' || substr(nat, 2, 2) || ' ' || substr(nat, 4, 7)
    WHEN id % 3 = 1 THEN substr(nat, 1, 3) || '-' || substr(nat, 4, 7) ELSE '0031' || substr(nat, 2, 9) END AS phone,
  CASE WHEN id % 211 = 0 THEN 'Regus Straat ' WHEN id % 307 = 0 THEN 'Primera Plein ' ELSE 'Kerkstraat ' END
    || CASE WHEN r IN (6, 7) THEN '6' ELSE CAST(r * 10 + 1 AS STRING) || CASE WHEN r = 3 THEN '-B' ELSE '' END END
    || ', ' || CAST(1000 + b % 8999 AS STRING) || CASE WHEN r = 5 THEN 'ab' ELSE ' AB' END || ' ' || city || CASE WHEN r = 4 THEN ', Nederland' ELSE '' END AS address,
  CASE WHEN r IN (0, 3) THEN 'https://www.dak' || CAST(b AS STRING) || '-' || lower(city) || '.nl/x/?utm_source=a&id=' || CAST(r AS STRING)
    WHEN r = 1 THEN 'facebook.com/p' || CAST(id AS STRING) WHEN r = 2 THEN 'http://shop.bedrijf' || CAST(b AS STRING) || '.co.uk/a/b/'
    WHEN r IN (6, 7) THEN 'klus' || CAST(b AS STRING) || lower(city) || '.com' ELSE NULL END AS website,
  'Target ' || CAST(b % 20 AS STRING) || ' (NL)' AS target_name,
  CASE id % 4 WHEN 0 THEN 'Plumber' WHEN 1 THEN 'Locksmith' WHEN 2 THEN 'Bakery' ELSE '' END AS category,
  CASE id % 10 WHEN 0 THEN 'Woning en appartement' WHEN 1 THEN 'Primera afhaalpunt' ELSE 'Vakman in ' || city END AS snippet,
  CASE id % 8 WHEN 0 THEN 'Unstaffed desk' WHEN 1 THEN 'WeWork' ELSE '' END AS actual_occupant,
  CASE id % 9 WHEN 0 THEN 'Weena 690' ELSE '' END AS site_address,
  CASE id % 6 WHEN 0 THEN 'Unregistered' WHEN 1 THEN 'onbekend' WHEN 2 THEN 'KvK 12345678' ELSE NULL END AS kvk_status,
  CAST(CASE WHEN id % 7 = 0 THEN 3 ELSE 1 END AS INT) AS network_cluster_size,
  CASE id % 5 WHEN 0 THEN 'residential' ELSE 'office' END AS address_type,
  id % 13 = 0 AS official_branch,
  CASE id % 3 WHEN 0 THEN 'ready_for_review' WHEN 1 THEN 'needs_evidence' ELSE 'clean' END AS review_status
FROM ({BASE}) y
"""

#: The same text over tables named customer and nation.
PROFILES_SQL = PROFILES.format(customer="customer", nation="nation")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings, dealt over the shuffle's tasks: customer is a small file that one task reads, and what is computed of a listing is not small.

    The dealt rows are kept, as the optimizer moves conditions on listings below a shuffle, back into the one task.
    """
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey").repartition(tasks, "c_custkey"))
    return spark.sql(PROFILES, customer=dealt, nation=nation)
