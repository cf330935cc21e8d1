"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docketry import catalog

SF = "/root/testdata/sf0.001"
SOME = [
    "a01_top_violations", "a04_by_industry_classified", "a09_industry_benchmark", "a18_all_years", "a20_type_histogram", "a21_cross_agency", "a30_citation_pairs",
    "f01_normalize", "f03_partial_ratio", "f06_weighted_ratio", "f09_group_similar", "f12_watch_list", "i02_windows", "i04_rank_sums", "i06_impact", "i07_impact_summary", "j01_violations_inspections", "p01_search", "r06_risk_scores", "r07_against_peers", "r09_company_report", "s06_conform_violations",
    "s12_deduplicate", "s25_upsert", "st5_upsert_summary", "v06_comprehensive", "w03_before_after",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(table, names):
    plain = lambda x: None if x is None or x != x else float(x) if type(x).__name__ in ("Decimal", "float", "float64", "int", "int64", "int32") else str(x)
    return sorted((tuple(plain(r[n]) for n in names) for r in table), key=str)


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    want = duck.sql(catalog.oracle_sql()[name]).to_arrow_table()
    want = (want.read_all() if hasattr(want, "read_all") else want).to_pylist()
    assert sorted(df.columns) == sorted(want[0])
    names = sorted(df.columns)
    assert rows(got, names) == rows(want, names)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_stream_windows_match_sql(spark, duck):
    got = [tuple(r) for r in catalog.queries()["st4_running_summary"](spark, SF).select(F.date_format("window_start", "yyyy-MM-dd HH:mm"), "event_type", "violation_count", "total").collect()]
    want = duck.sql(f"SELECT strftime(window_start, '%Y-%m-%d %H:%M'), event_type, violation_count, total FROM ({catalog.oracle_sql()['st4_running_summary']})").fetchall()
    assert sorted(got) == sorted(want) and len(want) > 100
