"""All registered queries of the library and their DuckDB SQL.

Each query takes (spark, sf_dir) and runs over whole tables; a limit is there only
where it is the feature.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import scalars as S
from docketry.functions.names import measure, normalized, token_key
from docketry.operators import aggregates as A
from docketry.operators import impact as I
from docketry.operators import quality as V
from docketry.operators import resolve as R
from docketry.operators import risk, search, summaries
from docketry.plans import company
from docketry.plans.oracle import MEAN, STATS, TOTAL, VALID, C, impacts, norm, recursive, scored, sector_name, sector_words, sql, standard_text
from docketry.sources import conform, fixtures, schemas, store, swap
from docketry.streaming import incremental as ST

KEY = "company_name_normalized"
ROWKEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "current_penalty"]
ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, current_penalty"
NAME = "red"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
v, i, a = fixtures.violations, fixtures.inspections, fixtures.accidents


def add(name: str, oracle: str | None = None):
    """Registers a query, with its SQL if it has one."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _SQL[name] = oracle
        return f

    return put


def over_v(name: str, f: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    add(name, oracle)(lambda s, d: f(v(s, d)))


def over_i(name: str, f: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    add(name, oracle)(lambda s, d: f(i(s, d)))


def n_rows(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"))


# --- sources -----------------------------------------------------------------
I_COLS = "activity_nr, estab_name, site_state, naics_code, open_date, close_case_date, year, inspection_type"


def _csv(s: SparkSession, df: DataFrame, name: str) -> str:
    path = store.scratch(s, name)
    store.export_csv(df, path)
    return path


@add("s01_load_inspections", sql(f"SELECT {I_COLS} FROM i"))
def _(s, d):
    return conform.inspections(conform.read_csv(s, _csv(s, i(s, d), "inspections"), schemas.RAW_INSPECTIONS))


@add("s02_load_violations", sql("SELECT activity_nr, standard, viol_type, coalesce(current_penalty, 0)::DOUBLE AS current_penalty, count(*) AS row_count FROM v GROUP BY ALL"))
def _(s, d):
    raw = conform.read_csv(s, _csv(s, v(s, d).select("activity_nr", "standard", "viol_type", "current_penalty"), "violations"), schemas.RAW_VIOLATIONS)
    out = conform.violations(raw, "OSHA", fill_penalties=True).withColumn("current_penalty", F.col("current_penalty").cast("double"))
    return n_rows(out, "activity_nr", "standard", "viol_type", "current_penalty")


@add("s03_load_accidents", sql("SELECT accident_key, estab_name, accident_date::VARCHAR AS accident_date, injury_type FROM a"))
def _(s, d):
    cols = ["accident_key", "estab_name", "accident_date", "injury_type"]
    return conform.read_csv(s, _csv(s, a(s, d).select(*cols), "accidents"), schemas.RAW_ACCIDENTS).select(*cols)


@add("s04_combine_parts", sql("SELECT activity_nr, year, CASE WHEN year % 2 = 0 THEN inspection_type END AS inspection_type FROM i"))
def _(s, d):
    df = i(s, d)
    even, odd = (_csv(s, part, "part") for part in (df.filter("year % 2 = 0"), df.filter("year % 2 = 1").drop("inspection_type")))
    read = lambda p: s.read.option("header", True).csv(p)
    return conform.inspections(conform.combine([read(even), read(odd)])).select("activity_nr", "year", "inspection_type")


@add("s04_parts_by_header", sql("SELECT activity_nr, estab_name, year, CASE WHEN year % 2 = 0 THEN inspection_type END AS inspection_type FROM i"))
def _(s, d):
    df, folder = i(s, d).withColumn("year", F.col("year").cast("string")), store.scratch(s, "parts")
    parts = (df.filter("year % 2 = 0").select("inspection_type", "activity_nr", "estab_name", "year"), df.filter("year % 2 = 1").select(F.col("year").alias(" Year"), F.col("estab_name").alias("ESTAB_NAME"), F.lit("x").alias("other"), "activity_nr"))
    for part in parts:
        part.write.mode("append").option("header", True).csv(folder)
    return conform.inspections(conform.read_csv(s, folder, schemas.RAW_INSPECTIONS)).select("activity_nr", "estab_name", "year", "inspection_type")


@add("s05_conform_inspections", sql(f"SELECT {I_COLS.replace('estab_name', 'left(estab_name, 500) AS estab_name')} FROM i"))
def _(s, d):
    df = i(s, d)
    raw = df.select(
        F.concat(F.lit("  "), "activity_nr", F.lit("\t")).alias("activity_nr"), F.concat(F.lit(" "), "estab_name").alias("estab_name"), F.lower("site_state").alias("site_state"), "naics_code",
        F.concat(F.date_format("open_date", "yyyy-MM-dd"), F.lit(" 00:00:00")).alias("open_date"), F.date_format("close_case_date", "MM/dd/yyyy").alias("close_case_date"), "inspection_type",
    )
    blank = raw.limit(5).withColumn("activity_nr", F.lit("  "))
    return conform.inspections(raw.union(blank))


@add("s06_conform_violations", sql(f"SELECT agency, company_name, company_name_normalized, activity_nr, standard, viol_type, current_penalty, site_state, naics_code, violation_date, year, count(*) AS row_count FROM v WHERE agency = 'OSHA' GROUP BY ALL"))
def _(s, d):
    raw = v(s, d).filter("agency = 'OSHA'").select("activity_nr", F.col("company_name").alias("estab_name"), "standard", "viol_type", F.col("current_penalty").cast("string").alias("current_penalty"), "site_state", "naics_code", F.col("violation_date").cast("string").alias("open_date"))
    out = conform.violations(raw, "OSHA").withColumn("current_penalty", F.col("current_penalty").cast("double"))
    return n_rows(out, "agency", "company_name", KEY, "activity_nr", "standard", "viol_type", "current_penalty", "site_state", "naics_code", "violation_date", "year")


A_OUT = "accident_key, activity_nr, estab_name, site_state, accident_date, year, description, fatality, injury_type"


@add("s07_accident_layouts", sql("SELECT * FROM (VALUES ('standard'), ('mine'), ('fatality')) t(layout), (SELECT count(*) AS row_count FROM a)"))
def _(s, d):
    df = a(s, d)
    shapes = (df, df.withColumn("mine_id", F.lit("1")).withColumn("ai_dt", F.lit("")), df.withColumn("summary_nr", F.lit("")).withColumn("event_date", F.lit("")))
    out = [n_rows(x).select(F.lit(conform.accident_layout(x.columns)).alias("layout"), "row_count") for x in shapes]
    return out[0].union(out[1]).union(out[2])


@add("s08_mine_accidents", """SELECT left(user_id::VARCHAR || '_' || event_id::VARCHAR, 50) AS accident_key, NULL::VARCHAR AS activity_nr, 'Mine ' || user_id AS estab_name, '06' AS site_state, ts::DATE AS accident_date, year(ts)::INTEGER AS year,
  props AS description, value > 200 AS fatality, CASE WHEN value > 200 THEN 'FATALITY' ELSE 'minor' END AS injury_type FROM events WHERE event_type = 'error'""")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'")
    raw = e.select(
        F.col("user_id").cast("string").alias("mine_id"), F.col("event_id").cast("string").alias("document_no"), F.concat(F.lit("Mine "), "user_id").alias("operator_name"), F.lit("06037").alias("fips_state_cd"),
        F.date_format("ts", "MM/dd/yyyy").alias("ai_dt"), F.lit("").alias("ai_year"), F.year("ts").cast("string").alias("cal_yr"), F.col("props").alias("ai_narr"), F.when(F.col("value") > 200, "FATALITY").otherwise("minor").alias("inj_degr_desc"),
    )
    return conform.accidents(raw).select(*A_OUT.split(", "))


@add("s09_fatality_reports", """SELECT event_id::VARCHAR AS accident_key, NULL::VARCHAR AS activity_nr, NULL::VARCHAR AS estab_name, 'CA' AS site_state, ts::DATE AS accident_date, year(ts)::INTEGER AS year,
  CASE WHEN user_id % 2 = 0 THEN event_type || ' | ' || props ELSE event_type END AS description, value > 200 AS fatality, 'kw' AS injury_type FROM events WHERE event_type = 'error'""")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'")
    raw = e.select(
        F.col("event_id").cast("string").alias("summary_nr"), F.lit("ca").alias("state_flag"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_date"), F.col("event_type").alias("event_desc"),
        F.when(F.col("user_id") % 2 == 0, F.col("props")).otherwise(" ").alias("abstract_text"), F.when(F.col("value") > 200, "x").alias("fatality"), F.lit("kw").alias("event_keyword"),
    )
    return conform.accidents(raw).select(*A_OUT.split(", "))


@add("s10_standard_accidents", sql("SELECT accident_key, activity_nr, estab_name, NULL::VARCHAR AS site_state, accident_date, year::INTEGER AS year, description, fatality, injury_type FROM a"))
def _(s, d):
    return conform.accidents(a(s, d).withColumn("fatality", F.col("fatality").cast("int").cast("string"))).select(*A_OUT.split(", "))


@add("s11_drop_missing_keys", sql("SELECT accident_key, nullif(injury_type, 'error') AS injury_type FROM a WHERE accident_key::BIGINT % 3 <> 0"))
def _(s, d):
    raw = a(s, d).withColumn("accident_key", F.when(F.col("accident_key").cast("long") % 3 == 0, "").otherwise(F.col("accident_key"))).withColumn("injury_type", F.lit(" "))
    return conform.accidents(raw).select("accident_key", "injury_type")


@add("s12_deduplicate", sql(f"SELECT {I_COLS} FROM i"))
def _(s, d):
    df = i(s, d)
    later = df.withColumn("open_date", F.date_add("open_date", 30)).withColumn("inspection_type", F.lit("again"))
    return conform.unique_inspections(df.union(later).union(df))


@add("s13_partitioned_load", sql(f"SELECT agency, count(*) AS row_count, {TOTAL} AS total_penalties FROM v GROUP BY agency"))
def _(s, d):
    path = store.scratch(s, "load")
    store.save(v(s, d), path, "agency")
    return s.read.parquet(path).groupBy(F.col("agency").cast("string").alias("agency")).agg(F.count(F.lit(1)).alias("row_count"), S.total("current_penalty").alias("total_penalties"))


@add("s14_reload_slice", sql("SELECT agency, count(*) AS row_count FROM v WHERE agency <> 'EPA' OR year >= 2000 GROUP BY agency"))
def _(s, d):
    path, df = store.scratch(s, "slice"), v(s, d)
    store.save(df, path, "agency")
    store.save(df, path, "agency", force=False)
    store.save(df.filter("agency = 'EPA' AND year >= 2000"), path, "agency")
    return n_rows(s.read.parquet(path), "agency")


@add("s14_emptied_slice", sql("SELECT agency, count(*) AS row_count FROM v WHERE agency <> 'FDA' AND (agency <> 'EPA' OR year >= 2000) GROUP BY agency"))
def _(s, d):
    path, df = store.scratch(s, "slices"), v(s, d)
    store.save(df, path, "agency")
    swap.reload_slice(df.filter("agency = 'MSHA' AND year < 0"), path, "agency", "MSHA", force=False)
    swap.reload_slice(df.filter("agency = 'EPA' AND year >= 2000"), path, "agency", "EPA")
    swap.reload_slice(df.filter("agency = 'FDA' AND year < 0"), path, "agency", "FDA")
    return n_rows(s.read.parquet(path), "agency")


@add("s15_load_selected", sql("SELECT 'violations' AS table_name, count(*) AS row_count, true AS has_rows FROM v UNION ALL SELECT 'accidents', count(*), true FROM a"))
def _(s, d):
    path = store.scratch(s, "all")
    done = store.load_all({"violations": v(s, d), "accidents": a(s, d), "inspections": i(s, d)}, path, ["violations", "accidents"])
    return store.table_stats({t: s.read.parquet(f"{path}/{t}") for t in done})


@add("s16_osha_source", sql("SELECT inspection_type, estab_name, count(*) AS row_count FROM v LEFT JOIN i USING (activity_nr) WHERE v.agency = 'OSHA' GROUP BY ALL"))
def _(s, d):
    return n_rows(A.joined_inspections(v(s, d).filter("agency = 'OSHA'"), i(s, d)), "inspection_type", "estab_name")


@add("s17_agency_sources", sql(f"SELECT agency, company_name, {norm('company_name')} AS company_name_normalized, site_state, violation_date, year, current_penalty, count(*) AS row_count FROM v WHERE agency IN ('EPA', 'MSHA') GROUP BY ALL"))
def _(s, d):
    df, out = v(s, d), None
    for agency in ("EPA", "MSHA"):
        names = {ours: theirs for ours, theirs in schemas.SOURCES[agency].mapping.items() if ours in df.columns}
        raw = df.filter(F.col("agency") == agency).select(*[F.col(o).cast("string").alias(t) for o, t in names.items()])
        one = conform.agency_violations(raw, agency)
        out = one if out is None else out.unionByName(one)
    out = out.unionByName(conform.agency_violations(conform.empty_source(s, "FDA"), "FDA")).withColumn("current_penalty", F.col("current_penalty").cast("double"))
    return n_rows(out, "agency", "company_name", KEY, "site_state", "violation_date", "year", "current_penalty")


over_v("s18_comparable_names", lambda df: n_rows(df.drop(KEY).withColumn(KEY, normalized("company_name")), "agency", KEY), sql(f"SELECT agency, {KEY}, count(*) AS row_count FROM v GROUP BY ALL"))
_gone = lambda df: df.withColumn("year", F.when(F.col("l_orderkey") % 3 != 0, F.col("year"))).withColumn("violation_date", F.when(F.col("l_orderkey") % 6 != 0, F.col("violation_date").cast("string")))
over_v("s19_backfill_year", lambda df: n_rows(conform.backfill_year(_gone(df)), "year"), sql("SELECT CASE WHEN l_orderkey % 6 <> 0 THEN year END::INTEGER AS year, count(*) AS row_count FROM v GROUP BY ALL"))
over_v("s20_backfill_report", lambda df: conform.backfill_report(_gone(df)), sql("SELECT count(*) AS total, count(y) AS with_year, count(*) - count(y) AS without_year, min(y)::INTEGER AS min_year, max(y)::INTEGER AS max_year, round(100.0 * count(y) / count(*), 2)::DOUBLE AS pct FROM (SELECT CASE WHEN l_orderkey % 3 <> 0 THEN year END AS y FROM v)"))
add("s21_table_stats", sql("SELECT 'inspections' AS table_name, count(*) AS row_count, true AS has_rows FROM i UNION ALL SELECT 'violations', count(*), true FROM v UNION ALL SELECT 'accidents', count(*), true FROM a"))(
    lambda s, d: store.table_stats({"inspections": i(s, d), "violations": v(s, d), "accidents": a(s, d)})
)
add("s22_completeness", sql("SELECT 'violations' AS table_name, count(*) AS expected_rows, count(CASE WHEN agency <> 'FDA' THEN 1 END) AS actual_rows, count(CASE WHEN agency = 'FDA' THEN 1 END) AS missing_rows, count(CASE WHEN agency = 'FDA' THEN 1 END) <= 0 AS complete FROM v"))(
    lambda s, d: store.completeness({"violations": v(s, d)}, {"violations": v(s, d).filter("agency <> 'FDA'")})
)


@add("s23_export_csv", sql("SELECT standard, count(*) AS citation_count FROM v GROUP BY standard"))
def _(s, d):
    out = n_rows(v(s, d), "standard").withColumnRenamed("row_count", "citation_count")
    return s.read.option("header", True).schema("standard string, citation_count long").csv(_csv(s, out, "export"))


@add("s24_append", sql("SELECT agency, 2 * count(*) AS row_count FROM v GROUP BY agency"))
def _(s, d):
    path = store.scratch(s, "append")
    for _ in range(2):
        store.append(v(s, d), path, "agency")
    return n_rows(s.read.parquet(path), "agency")


@add("s25_upsert", sql("SELECT activity_nr, CASE WHEN year >= 2000 THEN 'changed' ELSE inspection_type END AS inspection_type, year::INTEGER AS year FROM i"))
def _(s, d):
    old = i(s, d).withColumn("version", F.lit(1))
    new = store.newer_than(old, "year", 1999).withColumn("inspection_type", F.lit("changed")).withColumn("version", F.lit(2))
    return store.upserted(old, new, ["activity_nr"], "version").select("activity_nr", "inspection_type", "year")


@add("s25_upsert_touched", sql("SELECT activity_nr, CASE WHEN year >= 2000 THEN 'changed' ELSE inspection_type END AS inspection_type, year::INTEGER AS year FROM i"))
def _(s, d):
    path, old = store.scratch(s, "upserts"), i(s, d).withColumn("version", F.lit(1))
    store.upsert_table(old, path, ["activity_nr"], "version", 16)
    new = store.newer_than(old, "year", 1999).withColumn("inspection_type", F.lit("changed")).withColumn("version", F.lit(2))
    store.upsert_table(new, path, ["activity_nr"], "version", 16)
    return swap.merged_table(s, path).select("activity_nr", "inspection_type", "year")


@add("s26_columnar_by_year", sql(f"SELECT count(*) AS row_count, {TOTAL} AS total_penalties FROM v WHERE year = 1998"))
def _(s, d):
    path = store.scratch(s, "by-year")
    store.save(v(s, d), path, "year")
    return s.read.parquet(path).filter("year = 1998").agg(F.count(F.lit(1)).alias("row_count"), S.total("current_penalty").alias("total_penalties"))


# --- predicates and search -----------------------------------------------------
SEARCHED = "agency, activity_nr, company_name, standard, site_state, naics_code, year, current_penalty"
_show = lambda df: df.select(*SEARCHED.split(", "))
_filters = {"agency": "OSHA", "state": "ca", "min_penalty": 1000.0}
_where = "agency = 'OSHA' AND site_state = 'CA' AND current_penalty >= 1000"
over_v("p01_search", lambda df: _show(search.page(search.matching(df, **_filters), ROWKEY, 100, 20)), sql(f"SELECT {SEARCHED} FROM v WHERE {_where} ORDER BY {ORDER} LIMIT 100 OFFSET 20"))
over_v("p02_keyword_search", lambda df: _show(search.page(search.matching(df, keyword="Promo", year=1998), ROWKEY, 200)), sql(f"SELECT {SEARCHED} FROM v WHERE (lower(company_name) LIKE '%promo%' OR lower(standard) LIKE '%promo%') AND year = 1998 ORDER BY {ORDER} LIMIT 200"))
over_v("p03_count", lambda df: search.count_matching(df, **_filters), sql(f"SELECT count(*) AS total FROM v WHERE {_where}"))
over_i("p04_query_inspections", lambda df: search.page(search.matching(df, year=1997, state="NY"), ["activity_nr"], 500), sql(f"SELECT {I_COLS} FROM i WHERE year = 1997 AND site_state = 'NY' ORDER BY activity_nr LIMIT 500"))
_named = f"(contains({KEY}, {norm(chr(39) + NAME + chr(39))}) OR contains(lower(company_name), '{NAME}'))"
over_v("p05_query_violations", lambda df: _show(search.page(search.matching(df, company=NAME, agency="EPA", year=1999, min_penalty=0), ROWKEY, 1000)), sql(f"SELECT {SEARCHED} FROM v WHERE {_named} AND agency = 'EPA' AND year = 1999 AND current_penalty >= 0 ORDER BY {ORDER} LIMIT 1000"))
for _name, _kw, _cond in (
    ("p06_state", {"state": "tx"}, "site_state = 'TX'"), ("p07_code_prefix", {"naics_prefix": "33"}, "naics_code LIKE '33%'"), ("p08_substring", {"keyword": "PLATE"}, "contains(lower(company_name), 'plate') OR contains(lower(standard), 'plate')"),
    ("p09_min_penalty", {"min_penalty": 20000.0}, "current_penalty >= 20000"), ("p13_agencies", {"agencies": ["EPA", "FDA"]}, "agency IN ('EPA', 'FDA')"), ("p14_company", {"company": "Red Plate, Inc."}, f"contains({KEY}, 'RED PLATE') OR contains(lower(company_name), 'red plate, inc.')"),
):
    over_v(_name, lambda df, kw=_kw: n_rows(search.matching(df, **kw), "agency", "site_state"), sql(f"SELECT agency, site_state, count(*) AS row_count FROM v WHERE {_cond} GROUP BY ALL"))
over_v("p10_filled", lambda df: n_rows(df.filter(S.filled("naics_code")), "agency"), sql("SELECT agency, count(*) AS row_count FROM v WHERE naics_code IS NOT NULL AND naics_code <> '' GROUP BY ALL"))
over_v("p11_valid_industry", lambda df: n_rows(df.filter(S.valid_industry("naics_code")), "naics_code"), sql(f"SELECT naics_code, count(*) AS row_count FROM v WHERE {VALID} GROUP BY ALL"))
over_v("p12_unknown_industry", lambda df: n_rows(df.filter(S.unknown_industry("naics_code")), "naics_code"), sql("SELECT naics_code, count(*) AS row_count FROM v WHERE naics_code IN ('0', '0.0') GROUP BY ALL"))
over_v("p15_years", lambda df: search.distinct_values(df, "year", 2000), sql("SELECT DISTINCT year FROM v WHERE year >= 2000"))
over_v("p15_states", lambda df: search.distinct_values(df, "site_state"), sql("SELECT DISTINCT site_state FROM v WHERE site_state <> ''"))
over_v("p16_projection", lambda df: n_rows(df, *search.available(df, ["agency", "county", "viol_type"]), search.first_available(df, ["state", "site_state"])), sql("SELECT agency, viol_type, site_state, count(*) AS row_count FROM v GROUP BY ALL"))
over_v("p17_positive_penalties", lambda df: df.groupBy("agency").agg(F.count(S.positive("current_penalty")).alias("positive"), S.mean2(S.positive("current_penalty")).alias("avg_positive")), sql(f"SELECT agency, count(*) AS positive, {MEAN} AS avg_positive FROM v WHERE current_penalty > 0 GROUP BY agency"))

# --- joins -----------------------------------------------------------------
_J = sql("SELECT v.activity_nr, estab_name, open_date, inspection_type, count(*) AS row_count FROM v LEFT JOIN i USING (activity_nr) GROUP BY ALL")
add("j01_violations_inspections", _J)(lambda s, d: n_rows(A.joined_inspections(v(s, d), i(s, d)), "activity_nr", "estab_name", "open_date", "inspection_type"))
over_v("j03_sector_names", lambda df: n_rows(df.select(S.sector("naics_code").alias("sector")).withColumn("sector_name", S.sector_name("sector")), "sector", "sector_name"), sql(f"SELECT sector, {sector_name('sector')} AS sector_name, count(*) AS row_count FROM (SELECT substr(naics_code, 1, 2) AS sector FROM v) GROUP BY ALL"))
over_v("j04_standard_descriptions", lambda df: n_rows(df.withColumn("standard", F.concat("standard", F.lit("4"))).withColumn("description", S.standard_description("standard")), "standard", "description"), sql(f"SELECT standard, {standard_text('standard')} AS description, count(*) AS row_count FROM (SELECT concat(standard, '4') AS standard FROM v) GROUP BY ALL"))
over_v("j05_known_sectors", A.known_sectors, sql(f"SELECT {KEY}, min(substr(naics_code, 1, 2)) AS known_sector FROM v WHERE {VALID} AND {KEY} <> '' GROUP BY ALL"))
over_v("j06_matched_rows", lambda df: n_rows(df.join(df.filter(F.col(KEY).startswith("RED")).select(KEY).distinct(), KEY, "left_semi"), KEY), sql(f"SELECT {KEY}, count(*) AS row_count FROM v WHERE {KEY} LIKE 'RED%' GROUP BY ALL"))

# --- aggregates ------------------------------------------------------------
over_v("a01_top_violations", A.top_violations, sql(f"SELECT standard, count(*) AS citation_count, coalesce({MEAN}, 0) AS avg_penalty FROM v WHERE standard <> '' GROUP BY standard ORDER BY citation_count DESC, standard LIMIT 10"))
over_v("a02_by_state", A.by_state, sql(f"SELECT site_state AS state, count(*) AS violation_count, coalesce({TOTAL}, 0) AS total_penalties FROM v WHERE site_state <> '' GROUP BY site_state"))
over_v("a03_by_industry", A.by_industry, sql(f"SELECT naics_sector, violation_count, avg_penalty, {sector_name('naics_sector')} AS sector_name FROM (SELECT substr(naics_code, 1, 2) AS naics_sector, count(*) AS violation_count, coalesce({MEAN}, 0) AS avg_penalty FROM v WHERE {VALID} GROUP BY 1) ORDER BY violation_count DESC, naics_sector LIMIT 15"))
_CLS = {
    "ks": f"SELECT {KEY} AS kn, min(substr(naics_code, 1, 2)) AS k FROM v WHERE {VALID} AND {KEY} <> '' GROUP BY 1",
    "g": f"SELECT company_name, {KEY} AS nn, count(*) AS c, sum({C}) AS s, count(current_penalty) AS n FROM v WHERE naics_code IN ('0', '0.0') GROUP BY 1, 2",
    "cl": f"SELECT coalesce(CASE WHEN company_name <> '' THEN coalesce(k, {sector_words('company_name')}) END, '00') AS sector, c, s::DOUBLE / n / 100 AS m FROM g LEFT JOIN ks ON nn = kn",
    "cs": "SELECT sector, sum(c) AS c, CASE WHEN sector <> '00' THEN sum(CASE WHEN m <> 0 THEN m * c END) / sum(CASE WHEN m <> 0 THEN c END) END AS m FROM cl GROUP BY sector",
    "kn2": f"SELECT substr(naics_code, 1, 2) AS sector, count(*) AS c, sum({C})::DOUBLE / count(current_penalty) / 100 AS m FROM v WHERE {VALID} GROUP BY 1",
}
over_v("a04_by_industry_classified", A.by_industry_classified, sql(f"SELECT sector AS naics_sector, sum(c)::BIGINT AS violation_count, {sector_name('sector')} AS sector_name, coalesce(round(sum(CASE WHEN m <> 0 THEN m * c END) / sum(CASE WHEN m <> 0 THEN c END), 2), 0) AS avg_penalty FROM (SELECT * FROM kn2 UNION ALL SELECT * FROM cs) GROUP BY sector ORDER BY violation_count DESC, naics_sector LIMIT 15", **_CLS))
over_v("x05_sector_words", lambda df: n_rows(df.select(F.concat("company_name", F.when(F.col("l_partkey") % 5 == 0, " hospital").when(F.col("l_partkey") % 5 == 1, " Paper Mine").otherwise("")).alias("name")).withColumn("sector", S.sector_from_words("name")), "name", "sector"), sql(f"SELECT name, {sector_words('name')} AS sector, count(*) AS row_count FROM (SELECT concat(company_name, CASE l_partkey % 5 WHEN 0 THEN ' hospital' WHEN 1 THEN ' Paper Mine' ELSE '' END) AS name FROM v) GROUP BY ALL"))
for _g, _c in (("viol_type", "viol_type"), ("standard", "standard"), ("state", "site_state")):
    over_v(f"a05_penalty_summary_{_g}", lambda df, g=_g: A.penalty_summary(df, g), sql(f"SELECT {_c} AS group_key, count(*) AS violation_count, {TOTAL} AS total_penalty, {MEAN} AS avg_penalty, max(current_penalty) AS max_penalty FROM v WHERE {_c} <> '' GROUP BY 1"))
over_v("a06_trend_violations", A.trend, sql("SELECT year, count(*) AS row_count FROM v WHERE year >= 2000 GROUP BY year"))
over_i("a07_trend_inspections", lambda df: A.trend(df, "CA", 1996), sql("SELECT year, count(*) AS row_count FROM i WHERE year >= 1996 AND site_state = 'CA' GROUP BY year"))
over_v("a08_trend_penalties", lambda df: A.penalty_trend(df, min_year=1995), sql(f"SELECT year, coalesce({TOTAL}, 0) AS total_penalty FROM v WHERE year >= 1995 GROUP BY year"))
_IN = "substr(naics_code, 1, 2) = '33'"
over_v("a09_industry_benchmark", lambda df: A.industry_benchmark(df, "3345"), sql(f"SELECT '33' AS naics_sector, x.n AS industry_violations, x.m AS industry_avg_penalty, y.n AS national_violations, y.m AS national_avg_penalty, round(100 * (x.n::DOUBLE / y.n), 4) AS pct_of_national FROM (SELECT count(*) AS n, coalesce({MEAN}, 0) AS m FROM v WHERE {_IN}) x, (SELECT count(*) AS n, coalesce({MEAN}, 0) AS m FROM v) y"))
over_v("a10_overview", lambda df: A.overview(df, 1998, "NY"), sql(f"SELECT count(*) AS total_violations, coalesce({TOTAL}, 0) AS total_penalties, coalesce({MEAN}, 0) AS avg_penalty FROM v WHERE year = 1998 AND site_state = 'NY'"))
over_v("a11_establishments", A.establishments, sql("SELECT count(DISTINCT company_name) AS establishments FROM v WHERE company_name <> ''"))
over_v("a12_year_penalties", lambda df: A.year_penalties(df, 1997), sql(f"SELECT (SELECT count(*) FROM v WHERE year = 1997) AS total_violations, count(*) AS with_penalty, {MEAN} AS avg_penalty, {TOTAL} AS total_penalty, min(current_penalty) AS min_penalty, max(current_penalty) AS max_penalty FROM v WHERE year = 1997 AND current_penalty > 0"))
over_v("a13_summary_by_year", summaries.by_year, sql(f"SELECT agency, year, {STATS}, max(current_penalty) AS max_penalty, min(current_penalty) AS min_penalty FROM v WHERE year IS NOT NULL GROUP BY agency, year"))
over_v("a14_summary_by_state", summaries.by_state, sql(f"SELECT agency, site_state, year, {STATS} FROM v WHERE site_state <> '' GROUP BY agency, site_state, year"))
over_v("a15_summary_by_standard", summaries.by_standard, sql(f"SELECT agency, standard, year, {STATS} FROM v WHERE standard <> '' GROUP BY agency, standard, year"))
over_v("a16_summary_by_company", summaries.by_company, sql(f"SELECT agency, {KEY}, {STATS}, min(violation_date) AS first_violation_date, max(violation_date) AS last_violation_date, (year(max(violation_date)) - year(min(violation_date)) + 1)::INTEGER AS years_active FROM v WHERE {KEY} <> '' GROUP BY agency, {KEY}"))


@add("a17_refresh_summaries", sql(" UNION ALL ".join(f"SELECT '{n}' AS summary, count(*) AS row_count, sum(c)::BIGINT AS violations FROM (SELECT count(*) AS c FROM v WHERE {w} GROUP BY {g})" for n, w, g in (("by_year", "year IS NOT NULL", "agency, year"), ("by_state", "site_state <> ''", "agency, site_state, year"), ("by_standard", "standard <> ''", "agency, standard, year"), ("by_company", f"{KEY} <> ''", f"agency, {KEY}")))))
def _(s, d):
    paths = summaries.refresh(store.written(v(s, d).drop(*ROWKEY[:4]), "violations"), store.scratch(s, "summaries"))
    out = None
    for name, path in paths.items():
        one = s.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"), F.sum("violation_count").alias("violations")).select(F.lit(name).alias("summary"), "*")
        out = one if out is None else out.union(one)
    return out


over_v("a18_all_years", summaries.with_all_years, sql(f"SELECT agency, site_state, year, grouping(year) = 1 AS all_years, {STATS} FROM v WHERE site_state <> '' GROUP BY GROUPING SETS ((agency, site_state, year), (agency, site_state))"))
over_v("a19_company_breakdown", lambda df: A.company_breakdown(df).select(KEY, F.explode("agencies").alias("x")).select(KEY, "x.*"), sql(f"SELECT {KEY}, agency, {STATS}, max(current_penalty) AS max_penalty FROM v WHERE {KEY} <> '' GROUP BY 1, 2"))
over_v("a20_type_histogram", lambda df: A.type_histogram(df).select(KEY, "agency", F.explode("violation_types").alias("viol_type", "n")), sql(f"SELECT {KEY}, agency, viol_type, count(*) AS n FROM v WHERE {KEY} <> '' AND viol_type IS NOT NULL GROUP BY ALL"))
_CROSS = ", ".join(f"CASE WHEN count(*) FILTER (agency = '{x}') >= 3 THEN count(*) FILTER (agency = '{x}') ELSE 0 END AS \"{x}\"" for x in ("OSHA", "EPA", "MSHA", "FDA"))
over_v("a21_cross_agency", lambda df: A.cross_agency(df, ["OSHA", "EPA", "MSHA", "FDA"], 3), sql(f"SELECT * FROM (SELECT {KEY}, {_CROSS} FROM v WHERE {KEY} <> '' GROUP BY 1) WHERE (OSHA > 0)::INT + (EPA > 0)::INT + (MSHA > 0)::INT + (FDA > 0)::INT > 1"))
over_v("a23_matches_by_agency", lambda df: n_rows(search.matching(df, company=NAME), "agency"), sql(f"SELECT agency, count(*) AS row_count FROM v WHERE {_named} GROUP BY agency"))
over_v("a24_repeat_standards", A.repeat_standards, sql(f"SELECT {KEY}, count(*) FILTER (n > 1) AS repeat_standards FROM (SELECT {KEY}, standard, count(*) AS n FROM v WHERE {KEY} <> '' AND standard IS NOT NULL GROUP BY 1, 2) GROUP BY 1"))
over_v("a25_shared_dates", A.shared_dates, sql(f"SELECT {KEY}, violation_date, count(DISTINCT agency) AS agencies FROM v WHERE {KEY} <> '' GROUP BY 1, 2 HAVING count(DISTINCT agency) > 1"))
over_v("a26_penalty_quantiles", A.penalty_quantiles, sql(f"SELECT {KEY}, round(quantile_cont(current_penalty, 0.5), 4) AS median_penalty, round(quantile_cont(current_penalty, 0.75), 4) AS q75_penalty FROM v WHERE {KEY} <> '' AND current_penalty IS NOT NULL GROUP BY 1"))
over_v("a28_available_agencies", A.available_agencies, sql("SELECT DISTINCT agency FROM v"))
over_v("a29_page_metadata", lambda df: search.page_metadata(search.matching(df, **_filters), 100, 20), sql(f"SELECT count(*) AS total, 100 AS page_limit, 20 AS page_offset, count(*) > 120 AS has_next, true AS has_previous FROM v WHERE {_where}"))
over_v("a30_citation_pairs", A.citation_pairs, sql("SELECT x.standard AS standard_a, y.standard AS standard_b, count(*) AS inspections FROM s x JOIN s y ON x.activity_nr = y.activity_nr AND x.standard < y.standard GROUP BY 1, 2 HAVING count(*) >= 2", s="SELECT DISTINCT activity_nr, standard FROM v"))
over_v("a31_seasonal", A.seasonal, sql("SELECT year(violation_date)::INTEGER AS year, month(violation_date)::INTEGER AS month, count(*) AS violation_count FROM v GROUP BY ALL"))

# --- windows, order, sets ----------------------------------------------------
over_v("w02_gaps", lambda df: n_rows(I.gaps(df), KEY, "gap_days"), sql(f"SELECT {KEY}, gap_days, count(*) AS row_count FROM (SELECT {KEY}, (violation_date - lag(violation_date) OVER (PARTITION BY {KEY} ORDER BY violation_date))::INTEGER AS gap_days FROM v WHERE {KEY} <> '') GROUP BY ALL"))
over_v("w03_before_after", I.neighbours, sql(f"SELECT {KEY}, violation_date, n, coalesce(sum(n) OVER (PARTITION BY {KEY} ORDER BY violation_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0)::BIGINT AS before_count, coalesce(sum(n) OVER (PARTITION BY {KEY} ORDER BY violation_date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 365 DAY FOLLOWING), 0)::BIGINT AS after_count FROM (SELECT {KEY}, violation_date, count(*) AS n FROM v WHERE {KEY} <> '' GROUP BY 1, 2)"))
over_v("w08_first_per_key", lambda df: A.first_by_key(df.select(KEY, *ROWKEY, "violation_date"), KEY, ["violation_date", *ROWKEY]), sql(f"SELECT {KEY}, {ORDER}, violation_date FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY violation_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, current_penalty NULLS FIRST) AS r FROM v) WHERE r = 1"))
over_v("t04_cross_agency_top", lambda df: A.cross_agency(df, ["OSHA", "EPA", "MSHA", "FDA"]).orderBy(F.desc("OSHA"), F.desc("EPA"), F.desc("MSHA"), F.desc("FDA"), KEY).limit(50), sql(f"SELECT * FROM (SELECT {KEY}, count(*) FILTER (agency = 'OSHA') AS \"OSHA\", count(*) FILTER (agency = 'EPA') AS \"EPA\", count(*) FILTER (agency = 'MSHA') AS \"MSHA\", count(*) FILTER (agency = 'FDA') AS \"FDA\" FROM v WHERE {KEY} <> '' GROUP BY 1) WHERE (OSHA > 0)::INT + (EPA > 0)::INT + (MSHA > 0)::INT + (FDA > 0)::INT > 1 ORDER BY OSHA DESC, EPA DESC, MSHA DESC, FDA DESC, {KEY} LIMIT 50"))
over_v("t07_states_by_penalty", lambda df: A.by_state(df).orderBy(F.desc("total_penalties"), "state").limit(10), sql(f"SELECT site_state AS state, count(*) AS violation_count, coalesce({TOTAL}, 0) AS total_penalties FROM v GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10"))
over_v("u01_union_agencies", lambda df: n_rows(conform.combine([df.filter("agency = 'OSHA'"), df.filter("agency = 'MSHA'"), df.filter("agency = 'EPA'").drop("naics_code"), df.filter("agency = 'FDA'").drop("viol_type")]), "agency", "naics_code", "viol_type"), sql("SELECT agency, CASE WHEN agency <> 'EPA' THEN naics_code END AS naics_code, CASE WHEN agency <> 'FDA' THEN viol_type END AS viol_type, count(*) AS row_count FROM v GROUP BY ALL"))
over_v("u03_distinct", lambda df: df.select("agency", "year").distinct(), sql("SELECT DISTINCT agency, year FROM v"))
over_v("u04_unlisted_states", lambda df: V.states(df.withColumn("site_state", F.when(F.col("l_orderkey") % 7 == 0, "xx").otherwise(F.col("site_state")))), sql("SELECT 'XX' AS state, count(*) AS failing_rows FROM v WHERE l_orderkey % 7 = 0"))

# --- scalar functions ----------------------------------------------------------
over_v("x01_strings", lambda df: df.select(F.upper(F.trim("company_name")).alias("u"), F.length("company_name").alias("n"), F.substring("naics_code", 1, 2).alias("p"), F.col("company_name").startswith("The").alias("b"), F.col("company_name").endswith("Inc.").alias("e")).distinct(), sql("SELECT DISTINCT upper(trim(company_name)) AS u, length(company_name)::INTEGER AS n, substr(naics_code, 1, 2) AS p, starts_with(company_name, 'The') AS b, ends_with(company_name, 'Inc.') AS e FROM v"))
over_v("x06_dates", lambda df: n_rows(df.select(S.parsed_date(F.when(F.col("l_linenumber") == 1, F.date_format("violation_date", "MM/dd/yyyy")).when(F.col("l_linenumber") == 2, "not a date").otherwise(F.col("violation_date").cast("string"))).alias("day")), "day"), sql("SELECT CASE WHEN l_linenumber <> 2 THEN violation_date END AS day, count(*) AS row_count FROM v GROUP BY ALL"))
over_v("x07_date_arithmetic", lambda df: df.select("violation_date", F.year("violation_date").alias("y"), F.date_add("violation_date", 365).alias("later"), F.datediff(F.lit("2002-01-01").cast("date"), "violation_date").alias("days"), S.iso_date("violation_date").alias("text")).distinct(), sql("SELECT DISTINCT violation_date, year(violation_date)::INTEGER AS y, (violation_date + 365)::DATE AS later, (DATE '2002-01-01' - violation_date)::INTEGER AS days, strftime(violation_date, '%Y-%m-%d') AS text FROM v"))
over_v("x13_safe_ratio", lambda df: df.groupBy("standard").agg(F.round(S.per(F.count(S.positive("current_penalty")), F.count(F.when(F.col("viol_type") == "R", 1))), 6).alias("ratio")), sql("SELECT standard, coalesce(round(count(*) FILTER (current_penalty > 0) / nullif(count(*) FILTER (viol_type = 'R'), 0)::DOUBLE, 6), 0) AS ratio FROM v GROUP BY standard"))
#: Runs of one code are one digit; H and W don't end a run, vowels do.
_SOUNDEX = rf"""
SELECT f || rpad(substr(digits, 1, 3), 3, '0') AS code, count(*) AS names FROM (
  SELECT f, array_to_string(list_filter(d, lambda x, i: i > 1 AND x <> '0' AND x <> d[i - 1]), '') AS digits FROM (
    SELECT substr(s, 1, 1) AS f, string_split(translate(substr(s, 1, 1) || regexp_replace(substr(s, 2), '[HW]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623010702'), '') AS d
    FROM (SELECT DISTINCT {KEY}, replace({KEY}, ' ', '') AS s FROM v)))
GROUP BY 1
"""
_BY_SOUND = _SOUNDEX.replace("SELECT f ||", "SELECT k, f ||").replace(", count(*) AS names FROM (", " FROM (").replace("SELECT f, array_to_string", "SELECT k, f, array_to_string").replace("SELECT substr(s, 1, 1) AS f", "SELECT k, substr(s, 1, 1) AS f").replace(f"SELECT DISTINCT {KEY}, replace", f"SELECT DISTINCT {KEY} AS k, replace").replace("GROUP BY 1\n", "")
over_v("x16_soundex", lambda df: df.select(KEY).distinct().groupBy(F.soundex(F.regexp_replace(KEY, " ", "")).alias("code")).agg(F.count(F.lit(1)).alias("names")), sql(_SOUNDEX))

# --- names -----------------------------------------------------------------
over_v("f01_normalize", lambda df: df.select("company_name", KEY).distinct(), sql(f"SELECT DISTINCT company_name, {KEY} FROM v"))
#: Distinct names, and the measures of all of them against one.
_DN = {"dn": f"SELECT DISTINCT company_name AS name, {KEY} AS norm FROM v WHERE company_name <> '' AND {KEY} <> ''"}


def _like(*queries: str) -> dict[str, str]:
    asked = " UNION ALL ".join(f"SELECT '{q}' AS query, {norm(chr(39) + q + chr(39))} AS t" for q in queries)
    return {**_DN, "asked": asked, **scored("SELECT DISTINCT t, norm AS n FROM asked CROSS JOIN dn"), "hits": "SELECT query, name, weighted AS similarity FROM asked JOIN sm USING (t) JOIN dn ON norm = n"}


def _alike(threshold: float) -> dict[str, str]:
    """``pr``, all pairs of names at or over the threshold, and ``gs``, their groups: in order, each name that is like no earlier leader leads."""
    found = {**_DN, **scored("SELECT x.norm AS t, y.norm AS n FROM (SELECT DISTINCT norm FROM dn) x JOIN (SELECT DISTINCT norm FROM dn) y ON x.norm < y.norm"), "pr": f"SELECT t AS a, n AS b, weighted AS similarity FROM sm WHERE weighted >= {threshold}"}
    return found | {
        "od": "SELECT norm, row_number() OVER (ORDER BY norm) AS place, before FROM (SELECT norm, coalesce(list(a) FILTER (a IS NOT NULL), []) AS before FROM (SELECT DISTINCT norm FROM dn) LEFT JOIN pr ON b = norm GROUP BY norm)",
        "ld": "SELECT 0::BIGINT AS place, []::VARCHAR[] AS leaders UNION ALL SELECT od.place, CASE WHEN list_has_any(leaders, before) THEN leaders ELSE list_append(leaders, norm) END FROM ld JOIN od ON od.place = ld.place + 1",
        "le": "SELECT unnest(leaders) AS leader FROM (SELECT leaders FROM ld ORDER BY place DESC LIMIT 1)",
        "mb": "SELECT b AS norm, min(a) AS leader, arg_min(similarity, a) AS similarity FROM pr JOIN le ON leader = a GROUP BY b",
        "gs": "SELECT * FROM mb UNION ALL SELECT DISTINCT leader, leader, 100 FROM mb",
    }


def _best(query: str, threshold: float, limit: int, columns: str = "name, similarity") -> str:
    return sql(f"SELECT {columns} FROM hits WHERE similarity >= {threshold} ORDER BY similarity DESC, name LIMIT {limit}", **_like(query))


for _k, _id in (("simple", "f02"), ("partial", "f03"), ("token_sort", "f04"), ("token_set", "f05"), ("weighted", "f06")):
    over_v(f"{_id}_{_k}_ratio", lambda df, k=_k: df.select(F.col(KEY).alias("name")).distinct().withColumn("score", measure(k, "name", F.lit("RED PLATE PROMO"))), sql(f'SELECT n AS name, "{_k}" AS score FROM sm', **scored(f"SELECT DISTINCT 'RED PLATE PROMO' AS t, {KEY} AS n FROM v")))
over_v("f04_token_keys", lambda df: df.select(KEY, token_key(KEY).alias("token_key")).distinct(), sql(f"SELECT DISTINCT {KEY}, array_to_string(list_sort(list_distinct(string_split({KEY}, ' '))), ' ') AS token_key FROM v"))
over_v("a22_top_matched_names", lambda df: R.find_matches(R.distinct_names(df), NAME, 0, 5).select(F.col("name").alias("company_name"), F.col("similarity").alias("best")), _best(NAME, 0, 5, "name AS company_name, similarity AS best"))
over_v("f07_find_matches", lambda df: R.find_matches(R.distinct_names(df), "Red Plate Promo", 75, 20), _best("Red Plate Promo", 75, 20))
over_v("f08_match_rows", lambda df: n_rows(R.match_rows(df, "red plate promo", 75), "company_name", "similarity"), sql("SELECT company_name, similarity, count(*) AS row_count FROM v JOIN hits ON company_name = name WHERE similarity >= 75 GROUP BY 1, 2", **_like("red plate promo")))
over_v("f09_group_similar", lambda df: R.group_similar(R.distinct_names(df), 85), recursive(sql("SELECT * FROM gs", **_alike(85)), "dn", "pr", "od", "le", "mb"))
over_v("f10_search_one_agency", lambda df: company.search_company(df, NAME, ["OSHA"], fuzzy=False, limit=500).select("agency", "company_name", "activity_nr"), sql(f"SELECT agency, company_name, activity_nr FROM v WHERE {_named} AND agency = 'OSHA' ORDER BY company_name, agency, activity_nr, l_linenumber, l_partkey, l_suppkey, current_penalty LIMIT 500"))
over_v("f11_search_company", lambda df: company.search_company(df, NAME, threshold=50, limit=200, prefilter=None).select("agency", "company_name", "activity_nr", "similarity"), sql(f"SELECT agency, company_name, activity_nr, weighted AS similarity FROM v JOIN sm ON n = {KEY} WHERE weighted >= 50 ORDER BY weighted DESC, company_name, agency, activity_nr, l_linenumber, l_partkey, l_suppkey, current_penalty NULLS FIRST LIMIT 200", **scored(f"SELECT DISTINCT {norm(chr(39) + NAME + chr(39))} AS t, {KEY} AS n FROM v")))
over_v("f12_resolve", lambda df: n_rows(R.resolved(df, R.group_similar(R.distinct_names(df), 85)), "representative"), recursive(sql(f"SELECT coalesce(leader, {KEY}) AS representative, count(*) AS row_count FROM v LEFT JOIN gs ON norm = {KEY} GROUP BY 1", **_alike(85)), "dn", "pr", "od", "le", "mb"))
over_v("f12_watch_list", lambda df: R.watch_list(R.distinct_names(df), ["Red Plate Promo", "Blue Lamp LLC"], 70), sql("SELECT query, name, similarity FROM hits WHERE similarity >= 70", **_like("Red Plate Promo", "Blue Lamp LLC")))
over_v("f13_best_match", lambda df: R.best_match(R.distinct_names(df), "The Red Plate Promo, Inc.", 75), _best("The Red Plate Promo, Inc.", 75, 1))

# --- risk --------------------------------------------------------------------
_RISK = {
    "e": f"SELECT {KEY}, standard, count(*) AS n, sum(CAST(round(coalesce(current_penalty, 0) * 100) AS BIGINT)) AS s, count(*) FILTER (coalesce(current_penalty, 0) > 25000) AS high, max(violation_date) AS last, min(CASE WHEN {VALID} THEN naics_code END) AS code FROM v WHERE {KEY} <> '' GROUP BY 1, 2",
    "ag": f"SELECT {KEY}, count(DISTINCT agency) AS k, string_agg(DISTINCT agency, ',' ORDER BY agency) AS agencies FROM v WHERE {KEY} <> '' GROUP BY 1",
    "o": f"SELECT {KEY}, sum(n)::BIGINT AS n, sum(s)::DOUBLE / 100 AS t, sum(high)::BIGINT AS high, max(last) AS last, count(*) FILTER (standard IS NOT NULL AND n > 1) AS rep, min(code) AS code FROM e GROUP BY 1",
    "q": f"""SELECT o.*, agencies, round(least(100 * ln(1 + n) / ln(1001), 100), 2) AS vs, CASE WHEN t > 0 THEN round(least(100 * ln(1 + t) / ln(1000001), 100), 2) ELSE 0 END AS ps,
      round(CASE WHEN dd <= 30 THEN 100 WHEN dd >= 730 THEN 0 ELSE 100 * (1 - (dd - 30) / 700::DOUBLE) END, 2) AS rs,
      round(least(0.5 * least(t / n / 50000 * 100, 100) + 0.3 * (high / n::DOUBLE) * 100 + 0.2 * least(rep / n::DOUBLE * 200, 100), 100), 2) AS ss,
      CASE WHEN k <= 1 THEN 0 WHEN k = 2 THEN 50 WHEN k = 3 THEN 75 ELSE 100 END::DOUBLE AS as_
      FROM (SELECT *, ((SELECT max(violation_date) FROM v) - last) AS dd FROM o) o JOIN ag USING ({KEY})""",
    "r": f"SELECT *, least(((CAST(round(vs * 100) AS BIGINT) * 3000 + CAST(round(ps * 100) AS BIGINT) * 2500 + CAST(round(rs * 100) AS BIGINT) * 2000 + CAST(round(ss * 100) AS BIGINT) * 1500 + CAST(round(as_ * 100) AS BIGINT) * 1000 + 5000) // 10000)::DOUBLE / 100, 100) AS composite_score FROM q",
}
_SCORES = f"SELECT {KEY}, composite_score, CASE WHEN composite_score >= 75 THEN 'Critical' WHEN composite_score >= 50 THEN 'High' WHEN composite_score >= 25 THEN 'Medium' ELSE 'Low' END AS risk_level, vs AS violation_score, ps AS penalty_score, rs AS recency_score, ss AS severity_score, as_ AS agency_score, n AS violation_count, t AS total_penalties, agencies, strftime(last, '%Y-%m-%d') AS most_recent_violation, substr(code, 1, 2) AS naics_sector FROM r"
over_v("r06_risk_scores", risk.risk_scores, sql(_SCORES, **_RISK))
over_v("r07_against_peers", lambda df: risk.against_peers(risk.risk_scores(df)), sql(f"""SELECT {KEY}, naics_sector, composite_score, peer_count, round(s::DOUBLE / peer_count / 100, 4) AS peer_mean, round(med, 3) AS peer_median, round(100 * (below / peer_count::DOUBLE), 4) AS percentile,
  CASE WHEN composite_score > 1.5::DOUBLE * pm THEN 'Much Higher Risk' WHEN composite_score > pm THEN 'Higher Risk' WHEN composite_score < 0.5::DOUBLE * pm THEN 'Much Lower Risk' WHEN composite_score < pm THEN 'Lower Risk' ELSE 'Average' END AS comparison
  FROM (SELECT *, round(s::DOUBLE / peer_count / 100, 4) AS pm FROM (SELECT {KEY}, substr(code, 1, 2) AS naics_sector, composite_score, count(*) OVER w AS peer_count, sum(round(composite_score * 100)::BIGINT) OVER w AS s, quantile_cont(composite_score, 0.5) OVER w AS med, rank() OVER (PARTITION BY substr(code, 1, 2) ORDER BY composite_score) - 1 AS below FROM r WHERE code IS NOT NULL WINDOW w AS (PARTITION BY substr(code, 1, 2))))""", **_RISK))
_ONE = {"vv": f"SELECT * REPLACE ('{NAME}' AS {KEY}) FROM v WHERE {_named}"} | {k: q.replace("FROM v WHERE", "FROM vv WHERE") for k, q in _RISK.items()}
over_v("r08_company_risk", lambda df: company.company_risk(df, NAME).withColumnRenamed(KEY, "company").select("company", "violation_count", "total_penalties", "agencies", "composite_score", "risk_level"), sql(f"SELECT {KEY} AS company, violation_count, total_penalties, agencies, composite_score, risk_level FROM ({_SCORES})", **_ONE))
over_v("r09_company_report", lambda df: company.company_report(df, NAME).withColumn("agencies_json", F.to_json("types")).select("company", "agencies_json", "violation_count", "composite_score"), sql(
    f"""SELECT {KEY} AS company, '[' || string_agg('{{"agency":"' || agency || '","types":"{{' || types || '}}"}}', ',' ORDER BY agency) || ']' AS agencies_json, any_value(violation_count) AS violation_count, any_value(composite_score) AS composite_score
    FROM ({_SCORES}) JOIN (SELECT {KEY}, agency, string_agg('\\"' || viol_type || '\\":' || n, ',' ORDER BY viol_type) AS types FROM (SELECT {KEY}, agency, viol_type, count(*) AS n FROM vv WHERE viol_type IS NOT NULL GROUP BY ALL) GROUP BY ALL) USING ({KEY}) GROUP BY 1""", **_ONE))

# --- impact ------------------------------------------------------------------
_DATED = f"{KEY} <> '' AND violation_date IS NOT NULL"
_IMP = {
    "st": f"SELECT {KEY}, quantile_cont(current_penalty, 0.5) AS med, quantile_cont(current_penalty, 0.75) AS q75, min(violation_date) AS f FROM v WHERE {_DATED} GROUP BY 1",
    "pk": f"SELECT {KEY}, coalesce(min(violation_date) FILTER (current_penalty >= med AND violation_date >= f + 365), min(violation_date) FILTER (current_penalty >= med)) AS m, min(violation_date) FILTER (current_penalty >= q75) AS h FROM v JOIN st USING ({KEY}) GROUP BY 1",
    "ma": f"SELECT {KEY}, min(violation_date) AS x FROM (SELECT {KEY}, violation_date FROM v WHERE {_DATED} GROUP BY 1, 2 HAVING count(DISTINCT agency) > 1) GROUP BY 1",
    "bn": f"SELECT {KEY}, min(violation_date) AS f, max(violation_date) AS l, count(*) AS n FROM v WHERE {_DATED} GROUP BY 1 HAVING count(current_penalty) = 0",
    "bm": f"SELECT {KEY}, CASE WHEN any_value(l - f) > 730 THEN arg_min(violation_date, (abs(violation_date - (f + ((l - f) // 3)::INTEGER)) * 1000000 + (violation_date - f))) ELSE min(violation_date) FILTER (r = n // 2) END AS m FROM (SELECT {KEY}, violation_date, row_number() OVER (PARTITION BY {KEY} ORDER BY violation_date) - 1 AS r FROM v WHERE {_DATED}) JOIN bn USING ({KEY}) GROUP BY 1",
    "an": f"SELECT {KEY}, 'significant_violation' AS analysis_type, m AS anchor FROM pk WHERE m IS NOT NULL UNION ALL SELECT {KEY}, 'significant_violation', m FROM bm UNION ALL SELECT {KEY}, 'first_high_penalty', h FROM pk WHERE h IS NOT NULL UNION ALL SELECT {KEY}, 'first_multi_agency', x FROM ma",
    "wn": f"SELECT {KEY}, analysis_type, anchor, count(*) AS n_dated, count(*) FILTER (violation_date < anchor AND violation_date >= anchor - 365) AS before_count, count(*) FILTER (violation_date > anchor AND violation_date <= anchor + 365) AS after_count FROM an JOIN v USING ({KEY}) WHERE {_DATED} GROUP BY 1, 2, 3",
}
over_v("i01_anchors", I.anchors, sql("SELECT * FROM an", **_IMP))
over_v("i02_windows", lambda df: I.windows(df, I.anchors(df)), sql(f"SELECT {KEY}, analysis_type, anchor, n_dated, before_count, after_count, before_count::DOUBLE AS before_rate, after_count::DOUBLE AS after_rate, CASE WHEN before_count > 0 THEN round((after_count - before_count) / before_count::DOUBLE * 100, 2) WHEN after_count > 0 THEN 100 ELSE 0 END::DOUBLE AS rate_change_pct FROM wn", **_IMP))
_GAP = {
    **_IMP,
    "ev": f"SELECT {KEY}, analysis_type, anchor, violation_date, CASE WHEN violation_date < anchor THEN 'b' ELSE 'a' END AS side FROM an JOIN v USING ({KEY}) WHERE {_DATED} AND violation_date <> anchor AND violation_date >= anchor - 365 AND violation_date <= anchor + 365",
    "gp": f"SELECT *, (violation_date - lag(violation_date) OVER (PARTITION BY {KEY}, analysis_type, anchor, side ORDER BY violation_date)) AS g, count(*) OVER (PARTITION BY {KEY}, analysis_type, anchor, side) AS n FROM ev",
    "gg": f"SELECT {KEY}, analysis_type, anchor, side, coalesce(g, 365) AS g FROM gp WHERE g IS NOT NULL OR n = 1",
    "rk": f"SELECT *, rank() OVER (PARTITION BY {KEY}, analysis_type, anchor ORDER BY g) + (count(*) OVER (PARTITION BY {KEY}, analysis_type, anchor, g) - 1) / 2::DOUBLE AS r, count(*) OVER (PARTITION BY {KEY}, analysis_type, anchor, g) AS t FROM gg",
}
over_v("i04_rank_sums", lambda df: I.rank_sums(df, I.anchors(df)), sql(f"SELECT {KEY}, analysis_type, anchor, coalesce(sum(r) FILTER (side = 'b'), 0) - count(*) FILTER (side = 'b') * (count(*) FILTER (side = 'b') + 1) / 2::DOUBLE AS u1, count(*) FILTER (side = 'b') AS n1, count(*) FILTER (side = 'a') AS n2, sum(t * t - 1)::DOUBLE AS ties FROM rk GROUP BY 1, 2, 3", **_GAP))
_RES = {**_GAP, **impacts(KEY)}
_SUM = f"SELECT {KEY}, count(*) AS total_analyses, count(*) FILTER (impact = 'Increased') AS increased, count(*) FILTER (impact = 'Reduced') AS reduced, count(*) FILTER (impact IN ('No Change', 'No Significant Change')) AS no_change, count(*) FILTER (significant) AS statistically_significant, CASE WHEN s < 0 THEN -1 ELSE 1 END * ((2 * abs(s) + n) // (2 * n))::DOUBLE / 100 AS avg_rate_change_pct FROM (SELECT *, sum(round(rate_change_pct * 100)::BIGINT) OVER w::BIGINT AS s, count(*) OVER w AS n FROM res WINDOW w AS (PARTITION BY {KEY})) GROUP BY {KEY}, s, n"
_RED = {"vv": f"SELECT * REPLACE ('{NAME}' AS {KEY}) FROM v WHERE {_named}"} | {k: re.sub(r"\b(FROM|JOIN) v\b", r"\1 vv", q) for k, q in _RES.items()}
over_v("i06_impact", I.analyses, recursive(sql("SELECT * FROM res", **_RES)))
over_v("i07_impact_summary", lambda df: I.summary(I.analyses(df)), recursive(sql(_SUM, **_RES)))
over_v("i08_company_impact", lambda df: company.company_impact(df, NAME).withColumnRenamed(KEY, "company"), recursive(sql(f"SELECT {KEY} AS company, * EXCLUDE ({KEY}) FROM res", **_RED)))
over_v("i09_timeline", lambda df: n_rows(I.timeline(df, I.anchors(df)), KEY, "analysis_type", "period"), sql(f"SELECT {KEY}, analysis_type, CASE WHEN violation_date < anchor THEN 'Before' WHEN violation_date = anchor THEN 'Impact' ELSE 'After' END AS period, count(*) AS row_count FROM an JOIN v USING ({KEY}) WHERE {_DATED} GROUP BY ALL", **_IMP))

# --- data quality --------------------------------------------------------------
_spoilt = lambda df: df.withColumn("year", F.when(F.col("l_orderkey") % 11 == 0, 2500).when(F.col("l_orderkey") % 13 != 0, F.col("year"))).withColumn("current_penalty", F.when(F.col("l_orderkey") % 17 == 0, -F.col("current_penalty")).otherwise(F.col("current_penalty"))).withColumn("company_name", F.when(F.col("l_orderkey") % 19 != 0, F.col("company_name"))).withColumn("site_state", F.when(F.col("l_orderkey") % 7 == 0, "xx").otherwise(F.col("site_state"))).withColumn("viol_type", F.when(F.col("l_orderkey") % 3 == 0, F.col("viol_type")))
_SP = {"sp": "SELECT CASE WHEN l_orderkey % 11 = 0 THEN 2500 WHEN l_orderkey % 13 <> 0 THEN year END AS year, CASE WHEN l_orderkey % 17 = 0 THEN -current_penalty ELSE current_penalty END AS current_penalty, CASE WHEN l_orderkey % 19 <> 0 THEN company_name END AS company_name, CASE WHEN l_orderkey % 7 = 0 THEN 'xx' ELSE site_state END AS site_state, CASE WHEN l_orderkey % 3 = 0 THEN viol_type END AS viol_type FROM v"}


def _check(*rows: tuple[str, str, str, str]) -> str:
    each = [f"SELECT '{c}' AS \"check\", '{sev}' AS severity, '{col}' AS \"column\", count(*) FILTER ({cond}) AS failing_rows, count(*) AS total_rows FROM sp" for c, sev, col, cond in rows]
    return f"SELECT *, concat_ws(' ', \"column\", 'fails', \"check\", 'in', failing_rows, 'of', total_rows, 'rows') AS message FROM ({' UNION ALL '.join(each)}) WHERE failing_rows > 0"


_YEAR = (("year_null", "warning", "year", "year IS NULL"), ("year_range", "error", "year", "year < 1900 OR year > 2100"))
_PEN = (("penalty_negative", "warning", "current_penalty", "current_penalty < 0"), ("penalty_range", "warning", "current_penalty", "current_penalty < 0 OR current_penalty > 10000000"))
_NAMES = (("name_nulls", "warning", "company_name", "company_name IS NULL"),)
_NULLS = (("null_rate", "warning", "viol_type", "viol_type IS NULL"),)
over_v("v01_structure", lambda df: V.structure(_spoilt(df).select("year", "viol_type", "company_name"), ["year"]), sql(_check(*_NULLS), **_SP))
over_v("v02_years", lambda df: V.years(_spoilt(df)), sql(_check(*_YEAR), **_SP))
over_v("v02_year_stats", lambda df: V.year_stats(_spoilt(df)), sql("SELECT min(year)::INTEGER AS min_year, max(year)::INTEGER AS max_year, count(year) AS year_count FROM sp", **_SP))
over_v("v03_penalties", lambda df: V.penalties(_spoilt(df)), sql(_check(*_PEN), **_SP))
over_v("v03_penalty_stats", V.penalty_stats, sql(f"SELECT min(current_penalty) AS min_penalty, max(current_penalty) AS max_penalty, {MEAN} AS mean_penalty, round(quantile_cont(current_penalty, 0.5), 3) AS median_penalty FROM v"))
over_v("v04_states", lambda df: V.states(_spoilt(df)), sql("SELECT 'XX' AS state, count(*) AS failing_rows FROM sp WHERE site_state = 'xx'", **_SP))
over_v("v05_names", lambda df: V.names(_spoilt(df)), sql(_check(*_NAMES), **_SP))
over_v("v06_comprehensive", lambda df: V.comprehensive(_spoilt(df).select("year", "current_penalty", "company_name", "site_state", "viol_type")), sql(_check(*_NULLS, *_YEAR, *_PEN, *_NAMES, ("state_code", "warning", "site_state", "site_state = 'xx'")), **_SP))
over_v("v07_reject_split", lambda df: (lambda good, bad: n_rows(good.select(F.lit("").alias("reasons"))  .union(bad.select(F.array_join("reject_reasons", ",").alias("reasons"))), "reasons"))(*V.split(_spoilt(df))), sql("SELECT concat_ws(',', CASE WHEN year < 1900 OR year > 2100 THEN 'year_range' END, CASE WHEN current_penalty < 0 OR current_penalty > 10000000 THEN 'penalty_range' END, CASE WHEN site_state = 'xx' THEN 'state_code' END, CASE WHEN company_name IS NULL OR company_name = '' THEN 'name_missing' END) AS reasons, count(*) AS row_count FROM sp GROUP BY 1", **_SP))


# --- streaming -----------------------------------------------------------------
def _event_files(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Events as several Parquet files by time."""
    path = store.scratch(s, "events")
    e = s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path, e


@add("st1_ingest", "SELECT event_type, count(*) AS row_count FROM events GROUP BY event_type")
def _(s, d):
    path, e = _event_files(s, d)
    return n_rows(ST.ingest(s, path, e.schema), "event_type")


@add("st2_deduplicate", "SELECT event_type, count(DISTINCT event_id) AS row_count FROM events GROUP BY event_type")
def _(s, d):
    path, e = _event_files(s, d)
    e.repartition(2).write.mode("append").parquet(path)
    return n_rows(ST.ingest(s, path, e.schema, lambda st: ST.deduplicated(st, ["event_id"], "ts", "60 days")), "event_type")


@add("st3_enrich", "SELECT c_mktsegment, count(*) AS row_count FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1")
def _(s, d):
    path, e = _event_files(s, d)
    static = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return n_rows(ST.ingest(s, path, e.schema, lambda st: ST.enriched(st, static, "user_id")), "c_mktsegment")


@add("st4_running_summary", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS violation_count, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / 100 AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    path, e = _event_files(s, d)
    stream = ST.files(s, path, e.schema, per_batch=2)
    return ST.windowed_summary(stream, store.scratch(s, "windows"), store.scratch(s, "windows-state"), "ts", ["event_type"], "value")


@add("st4_event_time", _SQL["st4_running_summary"])
def _(s, d):
    # one write after the other, as a stream takes files by their time and rows behind the watermark are late
    path, e = store.scratch(s, "events"), s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    for k in range(4):
        place = F.greatest(F.lit(0), F.least(F.lit(3), F.floor(4 * (F.unix_micros("ts") - F.unix_micros(F.lit(first))) / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1))))
        e.filter(F.coalesce(place, F.lit(0)) == k).coalesce(2).write.mode("append").parquet(path)
    stream = ST.files(s, path, e.schema, per_batch=1)
    return ST.event_time_summary(stream, store.scratch(s, "event-time"), store.scratch(s, "event-time-state"), "ts", ["event_type"], "value")


@add("st5_upsert_summary", "SELECT user_id, event_type, count(*) AS violation_count, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2")
def _(s, d):
    path, e = _event_files(s, d)
    stream = ST.files(s, path, e.schema, per_batch=2)
    return ST.upsert_summary(stream, store.scratch(s, "upsert"), store.scratch(s, "upsert-state"), ["user_id", "event_type"], "value")[0]


@add("st6_alerts", "SELECT event_id, value FROM events WHERE value > 200")
def _(s, d):
    path, e = _event_files(s, d)
    return ST.ingest(s, path, e.schema, lambda st: ST.alerts(st, "value", 200)).select("event_id", "value")


# --- further forms ---------------------------------------------------------------
@add("a11_sketched_establishments", sql("SELECT y.year::INTEGER AS from_year, count(DISTINCT company_name) AS establishments, true AS sketch_agrees FROM (SELECT DISTINCT year FROM v WHERE year IS NOT NULL) y JOIN v ON v.year >= y.year WHERE company_name <> '' GROUP BY 1"))
def _(s, d):
    df = v(s, d).filter(S.filled("company_name"))
    stored = s.read.parquet(summaries.refresh_sketches(df, store.scratch(s, "sketches")))
    years = stored.select(F.col("year").alias("from_year")).filter("from_year is not null").distinct()
    # a company counts from each year up to its last one
    about = years.join(stored, F.col("year") >= F.col("from_year")).groupBy("from_year").agg(F.hll_sketch_estimate(F.hll_union_agg("companies")).alias("about"))
    last = df.filter("year is not null").groupBy("company_name").agg(F.max("year").alias("last")).groupBy("last").agg(F.count(F.lit(1)).alias("c"))
    exact = years.join(last, F.col("last") >= F.col("from_year")).groupBy("from_year").agg(F.sum("c").alias("establishments"))
    agrees = F.abs(F.col("about") - F.col("establishments")) <= 4 * 0.013 * F.col("establishments") + 1
    return exact.join(about, "from_year").select(F.col("from_year").cast("int").alias("from_year"), "establishments", agrees.alias("sketch_agrees"))


over_v("a23_mean_similarity", lambda df: R.match_rows(df, "Red Plate Promo", 70).groupBy("company_name").agg(F.round(F.avg("similarity"), 4).alias("mean_similarity"), F.count(F.lit(1)).alias("row_count"), F.count_distinct("agency").alias("agencies")), sql("SELECT company_name, round(avg(similarity), 4) AS mean_similarity, count(*) AS row_count, count(DISTINCT agency) AS agencies FROM v JOIN hits ON company_name = name WHERE similarity >= 70 GROUP BY 1", **_like("Red Plate Promo")))
over_v("f10_fuzzy_one_agency", lambda df: company.search_company(df, "Red Plaet Promo", ["OSHA"], threshold=70, limit=1000).select("agency", "company_name", "activity_nr", "similarity"), sql(f"SELECT agency, company_name, activity_nr, weighted AS similarity FROM v JOIN sm ON n = {KEY} WHERE weighted >= 70 AND agency = 'OSHA' ORDER BY weighted DESC, company_name, agency, activity_nr, l_linenumber, l_partkey, l_suppkey, current_penalty NULLS FIRST LIMIT 1000", **_like("Red Plaet Promo")))
over_v("x16_sound_groups", lambda df: R.sound_groups(R.distinct_names(df)), sql("SELECT code, n AS norm, t AS leader, weighted AS similarity FROM sm JOIN bs ON n = k", bs=_BY_SOUND, ld="SELECT code, min(k) AS leader FROM bs GROUP BY code", **scored("SELECT leader AS t, k AS n FROM bs JOIN ld USING (code)")))


# --- single rows of the inventory that the queries above use inside -----------------
add("j02_lookup_join", sql("SELECT v.agency, inspection_type, count(*) AS row_count, count(estab_name) AS found FROM v LEFT JOIN i USING (activity_nr) GROUP BY 1, 2"))(
    lambda s, d: A.joined_inspections(v(s, d), i(s, d)).groupBy("agency", "inspection_type").agg(F.count(F.lit(1)).alias("row_count"), F.count("estab_name").alias("found"))
)
over_v("j07_name_pairs", lambda df: R.similar_pairs(R.distinct_names(df), 90), recursive(sql("SELECT * FROM pr", **_alike(90)), "dn", "pr"))
over_v("j08_interval_membership", lambda df: I.windows(df, I.anchors(df), 180).select(KEY, "analysis_type", "anchor", "before_count", "after_count"), sql(f"SELECT {KEY}, analysis_type, anchor, count(*) FILTER (violation_date < anchor AND violation_date >= anchor - 180) AS before_count, count(*) FILTER (violation_date > anchor AND violation_date <= anchor + 180) AS after_count FROM an JOIN v USING ({KEY}) WHERE {_DATED} GROUP BY 1, 2, 3", **_IMP))
over_v("j09_industry_and_nation", lambda df: A.industry_benchmark(df, "62").select("industry_violations", "national_violations"), sql("SELECT count(*) FILTER (substr(naics_code, 1, 2) = '62') AS industry_violations, count(*) AS national_violations FROM v"))
_PEERS = f"SELECT {KEY}, substr(code, 1, 2) AS naics_sector, composite_score, rank() OVER (PARTITION BY substr(code, 1, 2) ORDER BY composite_score) - 1 AS below, count(*) OVER (PARTITION BY substr(code, 1, 2)) AS n FROM r WHERE code IS NOT NULL"
over_v("j10_company_and_peers", lambda df: risk.against_peers(risk.risk_scores(df)).select(KEY, "naics_sector", "peer_count"), sql(f"SELECT {KEY}, naics_sector, n AS peer_count FROM ({_PEERS})", **_RISK))
over_v("w04_peer_percentile", lambda df: risk.against_peers(risk.risk_scores(df)).select(KEY, "percentile"), sql(f"SELECT {KEY}, round(100 * (below / n::DOUBLE), 4) AS percentile FROM ({_PEERS})", **_RISK))
over_v("a27_impact_counts", lambda df: I.summary(I.analyses(df)).select(KEY, "total_analyses", "increased", "reduced", "no_change"), recursive(sql(f"SELECT {KEY}, total_analyses, increased, reduced, no_change FROM ({_SUM})", **_RES)))
over_v("w01_first_high_penalty", lambda df: I.anchors(df).filter("analysis_type = 'first_high_penalty'").select(KEY, "anchor"), sql(f"SELECT {KEY}, h AS anchor FROM pk WHERE h IS NOT NULL", **_IMP))
over_v("w05_mean_ranks", lambda df: I.rank_sums(df, I.anchors(df), 180).agg(F.sum("u1").alias("u1"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2")), sql("SELECT sum(u1) AS u1, sum(n1)::BIGINT AS n1, sum(n2)::BIGINT AS n2 FROM (SELECT coalesce(sum(r) FILTER (side = 'b'), 0) - count(*) FILTER (side = 'b') * (count(*) FILTER (side = 'b') + 1) / 2::DOUBLE AS u1, count(*) FILTER (side = 'b') AS n1, count(*) FILTER (side = 'a') AS n2 FROM rk GROUP BY company_name_normalized, analysis_type, anchor)", **{k: q.replace("anchor - 365", "anchor - 180").replace("anchor + 365", "anchor + 180") for k, q in _GAP.items()}))
_bare = lambda df: df.withColumn("current_penalty", F.lit(None).cast("double"))
_NEAR = f"SELECT {KEY}, min(violation_date) AS f, max(violation_date) AS l, count(*) AS n FROM v WHERE {_DATED} GROUP BY 1"
over_v("w06_nearest_date", lambda df: I.anchors(_bare(df)).filter("analysis_type = 'significant_violation'").select(KEY, "anchor"), sql(f"SELECT {KEY}, CASE WHEN any_value(l - f) > 730 THEN arg_min(violation_date, (abs(violation_date - (f + ((l - f) // 3)::INTEGER)) * 1000000 + (violation_date - f))) ELSE min(violation_date) FILTER (r = n // 2) END AS anchor FROM (SELECT {KEY}, violation_date, row_number() OVER (PARTITION BY {KEY} ORDER BY violation_date) - 1 AS r FROM v WHERE {_DATED}) JOIN nr USING ({KEY}) GROUP BY 1", nr=_NEAR))
# a company's years apart, as only timelines of 730 days at most take their middle row
_yearly = lambda df: _bare(df).filter(F.col("year").isNotNull() & S.filled(KEY)).withColumn(KEY, F.concat_ws(" ", KEY, "year"))
over_v("w07_middle_row", lambda df: I.anchors(_yearly(df)).filter("analysis_type = 'significant_violation'").select(KEY, "anchor"), sql(f"SELECT k AS {KEY}, min(violation_date) FILTER (r = n // 2) AS anchor FROM (SELECT k, violation_date, row_number() OVER (PARTITION BY k ORDER BY violation_date) - 1 AS r, count(*) OVER (PARTITION BY k) AS n FROM (SELECT *, {KEY} || ' ' || year AS k FROM v WHERE {_DATED} AND year IS NOT NULL)) GROUP BY 1"))
over_v("w09_row_numbers", lambda df: A.ranked(df, ROWKEY).filter("row_number <= 20").select("agency", "row_number", *ROWKEY[:4]), sql(f"SELECT agency, r::INTEGER AS row_number, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY agency ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, current_penalty NULLS FIRST) AS r FROM v) WHERE r <= 20"))
over_v("t01_order_by_aggregate", lambda df: A.top_violations(df, 5, 1999), sql(f"SELECT standard, count(*) AS citation_count, coalesce({MEAN}, 0) AS avg_penalty FROM v WHERE year = 1999 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
over_v("t02_page", lambda df: _show(search.page(df, ROWKEY, 50, 1000)), sql(f"SELECT {SEARCHED} FROM v ORDER BY {ORDER} NULLS FIRST LIMIT 50 OFFSET 1000"))
over_v("t03_by_similarity", lambda df: R.find_matches(R.distinct_names(df), "plate", 30, 50), _best("plate", 30, 50))
over_v("t06_sample", lambda df: search.sample(df, ROWKEY[:4], 1000, 42).select(*ROWKEY[:4]), sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM v ORDER BY md5(concat_ws('|', 42, l_orderkey, l_linenumber, l_partkey, l_suppkey)), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000"))
over_i("t05_head", lambda df: search.page(df, ["activity_nr"], 25), sql(f"SELECT {I_COLS} FROM i ORDER BY activity_nr LIMIT 25"))
over_v("u02_merge_sectors", lambda df: A.by_industry_classified(df, n=100).select("naics_sector", "violation_count"), sql("SELECT sector AS naics_sector, sum(c)::BIGINT AS violation_count FROM (SELECT sector, c FROM kn2 UNION ALL SELECT sector, c FROM cs) GROUP BY 1", **_CLS))
over_v("u05_missing_columns", lambda df: V.structure(df.select("agency", "year"), ["year", "company_name", "penalty"]).filter("check = 'missing_column'").select("check", "column", "total_rows"), sql("SELECT 'missing_column' AS \"check\", c AS \"column\", (SELECT count(*) FROM v) AS total_rows FROM (VALUES ('company_name'), ('penalty')) t(c)"))
over_v("x02_punctuation", lambda df: df.select("company_name", F.trim(F.regexp_replace(F.regexp_replace("company_name", r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")).alias("plain")).distinct(), sql(r"SELECT DISTINCT company_name, trim(regexp_replace(regexp_replace(company_name, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM v"))
over_v("x03_token_filter", lambda df: df.select("company_name", F.array_join(F.filter(F.split(F.upper("company_name"), " "), lambda w: ~w.isin("THE", "A", "AN")), "+").alias("tokens")).distinct(), sql("SELECT DISTINCT company_name, array_to_string(list_filter(string_split(upper(company_name), ' '), lambda w: w NOT IN ('THE', 'A', 'AN')), '+') AS tokens FROM v"))
over_v("x04_concat_nonblank", lambda df: n_rows(df.select(F.concat_ws(" | ", S.cleaned(F.when(F.col("l_linenumber") < 4, "  ").otherwise(F.col("viol_type"))), "standard").alias("joined")), "joined"), sql("SELECT concat_ws(' | ', CASE WHEN l_linenumber >= 4 THEN viol_type END, standard) AS joined, count(*) AS row_count FROM v GROUP BY 1"))
over_v("x08_iso_dates", lambda df: n_rows(df.select(S.iso_date("violation_date").alias("day")), "day"), sql("SELECT strftime(violation_date, '%Y-%m-%d') AS day, count(*) AS row_count FROM v GROUP BY 1"))
over_v("x09_arithmetic", lambda df: df.select(F.col("l_orderkey"), F.col("l_linenumber"), F.round(F.log1p(F.coalesce("current_penalty", F.lit(0.0))), 6).alias("log"), F.greatest(F.lit(0.0), F.least("current_penalty", F.lit(50000.0))).alias("clamped")).distinct(), sql("SELECT DISTINCT l_orderkey, l_linenumber, round(ln(1 + coalesce(current_penalty, 0)), 6) AS log, CASE WHEN current_penalty IS NULL THEN 50000 ELSE greatest(0, least(current_penalty, 50000)) END::DOUBLE AS clamped FROM v"))
over_v("x10_coercion", lambda df: df.select("naics_code", F.coalesce(S.number("naics_code", "double"), F.lit(0.0)).alias("x"), S.number(F.concat("naics_code", F.lit("?")), "int").alias("y")).distinct(), sql("SELECT DISTINCT naics_code, coalesce(TRY_CAST(naics_code AS DOUBLE), 0) AS x, NULL::INTEGER AS y FROM v"))
over_v("x11_labels", lambda df: n_rows(df.select(S.risk_level(F.col("current_penalty") / 1000).alias("level"), I.strength(F.col("current_penalty") / 500).alias("strength")), "level", "strength"), sql("SELECT CASE WHEN x / 1000 >= 75 THEN 'Critical' WHEN x / 1000 >= 50 THEN 'High' WHEN x / 1000 >= 25 THEN 'Medium' ELSE 'Low' END AS level, CASE WHEN x / 500 >= 100 THEN 'Very Strong' WHEN x / 500 >= 50 THEN 'Strong' WHEN x / 500 >= 25 THEN 'Moderate' WHEN x / 500 >= 10 THEN 'Weak' ELSE 'Minimal' END AS strength, count(*) AS row_count FROM (SELECT current_penalty AS x FROM v) GROUP BY 1, 2"))
over_v("x12_agency_count_score", lambda df: df.groupBy("activity_nr").agg(F.count_distinct("agency").alias("k")).select("activity_nr", S.agency_count_score(F.col("k")).alias("score")), sql("SELECT activity_nr, CASE k WHEN 1 THEN 0 WHEN 2 THEN 50 WHEN 3 THEN 75 ELSE 100 END::DOUBLE AS score FROM (SELECT activity_nr, count(DISTINCT agency) AS k FROM v GROUP BY 1)"))
over_v("x14_json_rows", lambda df: n_rows(df, "agency", "year").select(F.to_json(F.struct("agency", "year", "row_count")).alias("json")), sql("SELECT '{\"agency\":\"' || agency || '\",\"year\":' || year || ',\"row_count\":' || count(*) || '}' AS json FROM v GROUP BY agency, year"))
over_v("x15_maps", lambda df: A.type_histogram(df).select(KEY, "agency", F.try_element_at("violation_types", F.lit("R")).alias("returned")), sql(f"SELECT {KEY}, agency, nullif(count(*) FILTER (viol_type = 'R'), 0) AS returned FROM v WHERE {KEY} <> '' AND viol_type IS NOT NULL GROUP BY 1, 2"))
for _id, _label, _col in (("r01", "violation", "vs"), ("r02", "penalty", "ps"), ("r03", "recency", "rs"), ("r04", "severity", "ss"), ("r05", "agency", "as_")):
    over_v(f"{_id}_{_label}_score", lambda df, x=_label: risk.risk_scores(df).select(KEY, f"{x}_score"), sql(f"SELECT {KEY}, {_col} AS {_label}_score FROM q", **_RISK))
over_v("i03_rate_change", lambda df: I.windows(df, I.anchors(df)).select(KEY, "analysis_type", "rate_change_pct"), sql(f"SELECT {KEY}, analysis_type, CASE WHEN before_count > 0 THEN round((after_count - before_count) / before_count::DOUBLE * 100, 2) WHEN after_count > 0 THEN 100 ELSE 0 END::DOUBLE AS rate_change_pct FROM wn", **_IMP))
over_v("i05_impact_labels", lambda df: n_rows(I.analyses(df), "analysis_type", "impact", "impact_strength"), recursive(sql("SELECT analysis_type, impact, impact_strength, count(*) AS row_count FROM res GROUP BY ALL", **_RES)))


@add("st7_progress", "SELECT count(*) AS input_rows FROM events")
def _(s, d):
    path, e = _event_files(s, d)
    found = ST.load_progress(ST.files(s, path, e.schema, per_batch=1), store.scratch(s, "progress"), store.scratch(s, "progress-state"))
    return found.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("input_rows"))


@add("st7_rates", "SELECT count(*) AS input_rows, true AS every_batch_has_a_rate FROM events")
def _(s, d):
    path, e = _event_files(s, d)
    found = ST.load_progress(ST.files(s, path, e.schema, per_batch=1), store.scratch(s, "rates"), store.scratch(s, "rates-state"))
    return found.agg(F.sum("rows").alias("input_rows"), F.every(F.coalesce(F.col("rows_per_second") > 0, F.lit(False))).alias("every_batch_has_a_rate"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
