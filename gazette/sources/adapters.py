"""String feeds with the gaps and mixed formats of real ones, cut from the test tables.

The SQL is the same for Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {"events": "events", "meetings": "part", "officers": "supplier", "districts": "nation", "committees": "region", "resources": "pages", "announcements": "orders"}

SQL = {
    "events": """
SELECT event_id AS row_id,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('ev-', cast(event_id AS string)) END AS id,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE concat(event_type, ' ', cast(user_id AS string)) END AS title,
  CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 5 = 0 THEN upper(event_type) ELSE event_type END AS category,
  CASE WHEN event_id % 19 = 0 THEN 'TBA' ELSE cast(cast(ts AS date) AS string) END AS start_date,
  CASE WHEN event_id % 4 = 0 THEN concat(cast((hour(ts) + 11) % 12 + 1 AS string), ':', lpad(cast(minute(ts) AS string), 2, '0'),
                                         CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' PM' END)
       WHEN event_id % 4 = 1 THEN concat(lpad(cast(hour(ts) AS string), 2, '0'), ':', lpad(cast(minute(ts) AS string), 2, '0'))
       WHEN event_id % 4 = 2 THEN '' ELSE 'noon' END AS start_time,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE cast(cast(ts AS date) AS string) END AS end_date,
  CASE WHEN event_id % 3 = 1 THEN '11:30 pm' ELSE '' END AS end_time,
  concat('Hall ', cast(user_id % 20 AS string)) AS location,
  CASE WHEN event_id % 2 = 0 THEN concat(cast(user_id AS string), ' Main St; Unit ', cast(event_id % 7 AS string)) ELSE '' END AS address,
  CASE WHEN event_id % 6 = 0 THEN cast(user_id % 25 AS string) ELSE '' END AS district,
  '' AS url, '' AS flyer_url, props AS description, '' AS contact,
  CASE WHEN event_id % 10 = 0 THEN 'Yes' WHEN event_id % 10 = 1 THEN '1' ELSE 'no' END AS featured
FROM events
""",
    "meetings": """
SELECT p_partkey AS row_id, concat(p_name, ' ', cast(p_partkey AS string)) AS name,
  CASE p_size % 8 WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday'
    WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday' ELSE 'Someday' END AS day,
  CASE p_partkey % 5 WHEN 0 THEN concat(cast(p_partkey % 12 + 1 AS string), ':30 PM')
    WHEN 1 THEN concat(cast(p_partkey % 12 + 1 AS string), ':00 am') WHEN 2 THEN '1930'
    WHEN 3 THEN '7:30 p.m.' ELSE 'tba' END AS time,
  concat(cast(p_partkey AS string), ' Oak Ave') AS address,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS city,
  cast(p_size AS string) AS district,
  CASE WHEN p_partkey % 2 = 0 THEN concat(p_type, '| ', p_brand, '||') ELSE concat(p_type, ',', p_name) END AS types,
  '' AS notes
FROM part
""",
    "officers": """
SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS name,
  concat('Seat ', cast(s_suppkey AS string)) AS position,
  CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Officer' WHEN 2 THEN 'chair' WHEN 3 THEN 'DCM' ELSE 'trustee' END AS type,
  CASE WHEN s_suppkey % 5 = 3 THEN cast(s_nationkey AS string) ELSE '' END AS district,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('s', cast(s_suppkey AS string), '@example.org') END AS email,
  '' AS bio,
  CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 7 = 1 THEN concat(cast(s_suppkey % 50 AS string), 'a') ELSE cast(s_suppkey % 50 AS string) END AS sort
FROM supplier
""",
    "districts": """
SELECT n_nationkey AS row_id, cast(n_nationkey AS string) AS number, n_name AS name,
  concat('Region ', cast(n_regionkey AS string)) AS area, '' AS dcm, '' AS email, '' AS website, '' AS meeting_info
FROM nation
""",
    "committees": """
SELECT r_regionkey AS row_id, r_name AS name, concat('Serves ', r_name) AS purpose, '' AS chair, '' AS email,
  'Monthly' AS meeting_schedule, '' AS icon
FROM region
""",
    "resources": """
SELECT page_id AS row_id, concat('Page ', cast(page_id AS string)) AS title,
  CASE WHEN page_id % 8 = 0 THEN '' ELSE concat('Cat ', cast(page_id % 6 AS string)) END AS category,
  CASE page_id % 5 WHEN 0 THEN concat(url, '.PDF') WHEN 1 THEN concat(url, '.docx') WHEN 2 THEN '' ELSE url END AS url,
  url AS description, '' AS updated
FROM pages
""",
    "announcements": """
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('an-', cast(o_orderkey AS string)) END AS id,
  concat('Notice ', cast(o_orderkey AS string)) AS title, o_orderstatus AS body,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'http://example.org/a' ELSE '/events/x' END AS url,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE cast(cast(o_orderdate AS date) AS string) END AS starts,
  CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE concat(cast(extract(year FROM o_orderdate) AS string), '-12-31') END AS ends,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE substr(o_orderpriority, 1, 1) END AS priority
FROM orders
""",
}


def feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLES[name]
    head, _, tail = SQL[name].rpartition(f"FROM {table}")
    return spark.sql(f"{head}FROM {{source}}{tail}", source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
