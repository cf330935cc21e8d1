"""The star-schema tables seen as inspections, violations and accidents.

The texts run unchanged in Spark and DuckDB; ``{lineitem}`` and so on are the names of the
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.functions.names import normalized

_NAME = """concat(CASE WHEN p.p_partkey % 7 = 0 THEN 'The ' ELSE '' END, p.p_name, ' ', lower(p.p_type),
    CASE p.p_partkey % 6 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Corp'
                         WHEN 3 THEN ' Holdings' WHEN 4 THEN ' Co.' ELSE '' END)"""
VIOLATIONS = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
  CASE l.l_suppkey % 10 WHEN 7 THEN 'EPA' WHEN 8 THEN 'MSHA' WHEN 9 THEN 'FDA' ELSE 'OSHA' END AS agency,
  {name} AS company_name,
  CAST(l.l_orderkey AS STRING) AS activity_nr,
  concat('1910.', substr(p.p_brand, 7)) AS standard,
  l.l_returnflag AS viol_type,
  CASE WHEN l.l_linenumber = 7 THEN NULL WHEN l.l_discount = 0 THEN CAST(0 AS DOUBLE)
       ELSE l.l_extendedprice END AS current_penalty,
  substr('CATXNYFLILPAOHGANCMINJVAWAAZMATNINMOMDWICOMNSCALLA', n.n_nationkey*2+1, 2) AS site_state,
  CASE WHEN p.p_size <= 3 THEN '0' WHEN p.p_size = 4 THEN NULL WHEN p.p_size = 5 THEN '0.0'
       ELSE concat(substr('112122233132334244454849515253545556616271728192', (p.p_size % 24)*2+1, 2),
                   lpad(CAST(p.p_size AS STRING), 4, '0')) END AS naics_code,
  CAST(o.o_orderdate AS DATE) AS violation_date, year(o.o_orderdate) AS year
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {part} p ON l.l_partkey = p.p_partkey
""".replace("{name}", _NAME)

INSPECTIONS = """
SELECT CAST(o.o_orderkey AS STRING) AS activity_nr, c.c_name AS estab_name,
  substr('CATXNYFLILPAOHGANCMINJVAWAAZMATNINMOMDWICOMNSCALLA', n.n_nationkey*2+1, 2) AS site_state,
  concat(substr('112122233132334244454849515253545556616271728192', CAST(c.c_custkey % 24 AS INT)*2+1, 2), '0000') AS naics_code,
  CAST(o.o_orderdate AS DATE) AS open_date,
  CASE WHEN o.o_orderstatus = 'O' THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS close_case_date,
  year(o.o_orderdate) AS year, o.o_orderpriority AS inspection_type
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

ACCIDENTS = """
SELECT CAST(event_id AS STRING) AS accident_key, CAST(NULL AS STRING) AS activity_nr,
  concat('User ', CAST(user_id AS STRING), ' LLC') AS estab_name, CAST(ts AS DATE) AS accident_date, year(ts) AS year,
  props AS description, value > 200 AS fatality, event_type AS injury_type
FROM {events} WHERE event_type = 'error'
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _read(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    return spark.sql(sql, **{t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql})


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations with the normalised company name.

    A name is a part's, so each part's is normalised once, before its violations are joined.
    """
    parts = spark.sql(f"SELECT p.*, {_NAME} AS p_company FROM {{part}} p", part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    parts = parts.withColumn("p_normalized", normalized("p_company"))
    query = VIOLATIONS.replace(f"{_NAME} AS company_name", "p.p_company AS company_name").replace("year(o.o_orderdate) AS year", "year(o.o_orderdate) AS year, p.p_normalized AS company_name_normalized")
    return _read(spark, sf_dir, query, part=parts)


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, INSPECTIONS)


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, ACCIDENTS)


def names_sql() -> dict[str, str]:
    """The placeholders as bare names."""
    return {t: t for t in TABLES}
