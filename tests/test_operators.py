import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from docketry import catalog
from docketry.operators import aggregates as A
from docketry.operators import impact as I
from docketry.operators import quality as V
from docketry.operators import risk, search, summaries

COLS = "agency string, company_name string, company_name_normalized string, activity_nr string, standard string, viol_type string, current_penalty double, site_state string, naics_code string, violation_date date, year int"


@pytest.fixture(scope="module")
def sample(spark):
    rows = [("OSHA", f"Test Company {i % 5 + 1}", f"TEST COMPANY {i % 5 + 1}", f"TEST000{i % 5 + 1}", f"1910.{i}", "S", 100.0 * i, "CA", "541330", date(2023, 1, 1), 2023) for i in range(1, 11)]
    rows += [("EPA", None, "", "T", None, None, None, None, "0", None, None)]
    return spark.createDataFrame(rows, COLS)


def test_filters(sample):
    assert search.matching(sample, state="ca").count() == 10
    assert search.matching(sample, min_penalty=0).count() == 10
    assert search.matching(sample, keyword="%").count() == 0
    assert search.matching(sample, naics_prefix="54", year=2023, agency="OSHA").count() == 10
    got = search.page(search.matching(sample, state="CA"), ["activity_nr", "standard"], 3, 9)
    assert got.count() == 1


def test_pages_that_cannot_be_asked_for(sample):
    for limit, offset in ((0, 0), (search.MOST_ROWS + 1, 0), (5, -1)):
        with pytest.raises(ValueError):
            search.page(sample, ["activity_nr"], limit, offset)
        with pytest.raises(ValueError):
            search.page_metadata(sample, limit, offset)


def test_empty_tables(sample):
    none = sample.filter("false")
    assert A.top_violations(none).count() == 0
    assert A.by_industry_classified(none).count() == 0
    assert A.overview(none).first().asDict() == {"total_violations": 0, "total_penalties": 0.0, "avg_penalty": 0.0}
    assert risk.risk_scores(none).count() == 0
    assert I.analyses(none).count() == 0
    assert summaries.with_all_years(none).count() == 0


def test_mean_rounds_half_up(spark):
    df = spark.createDataFrame([("s", 0.01), ("s", 0.02), ("t", None)], "standard string, current_penalty double")
    got = {r["standard"]: r["avg_penalty"] for r in A.top_violations(df.withColumn("year", F.lit(1))).collect()}
    assert got == {"s": 0.02, "t": 0.0}


def test_summaries_add_up(sample):
    assert summaries.by_state(sample).agg(F.sum("violation_count")).first()[0] == 10
    whole = summaries.with_all_years(sample).filter("all_years").agg(F.sum("violation_count")).first()[0]
    assert whole == 10


def test_refresh_replaces_one_agency(spark, sample, tmp_path):
    path = f"file://{tmp_path}/s"
    summaries.refresh(sample.withColumn("year", F.coalesce("year", F.lit(2000))), path)
    paths = summaries.refresh(sample.filter("agency = 'OSHA' and standard = '1910.1'"), path, "OSHA")
    got = {r["agency"]: r["violation_count"] for r in spark.read.parquet(paths["by_year"]).collect()}
    assert got == {"OSHA": 1, "EPA": 1}


def test_risk_components(spark):
    rows = [("OSHA", "a", "A", "1", "s1", "S", 30000.0, "CA", "54", date(2023, 1, 1), 2023), ("EPA", "a", "A", "2", "s1", "S", None, "CA", "54", date(2022, 12, 1), 2022)]
    r = risk.risk_scores(spark.createDataFrame(rows, COLS), as_of=date(2023, 1, 31)).first()
    assert r["violation_score"] == 15.9
    assert r["penalty_score"] == 74.62
    assert r["recency_score"] == 100
    assert r["severity_score"] == 0.5 * 30 + 0.3 * 50 + 0.2 * 100
    assert r["agency_score"] == 50
    want = 15.9 * 0.3 + 74.62 * 0.25 + 100 * 0.2 + 50 * 0.15 + 50 * 0.1
    assert r["composite_score"] == pytest.approx(want, abs=0.006)
    assert r["risk_level"] == "High"


@pytest.mark.parametrize(("days", "want"), [(0, 100), (30, 100), (380, 50), (730, 0), (None, 0)])
def test_recency(spark, days, want):
    df = spark.createDataFrame([(days,)], "d int")
    assert df.select(risk.recency_score(F.col("d"))).first()[0] == want


def test_exact_distribution_by_enumeration():
    from itertools import combinations

    for m, n in ((1, 4), (3, 3), (2, 5), (4, 6)):
        counts = [0] * (m * n + 1)
        for places in combinations(range(m + n), m):
            counts[sum(places) - m * (m - 1) // 2] += 1
        assert list(I._counts(m, n)) == counts


def test_tail_probabilities():
    # three against three, completely apart: 2 of 20 arrangements
    assert I.tail(0, 3, 3, 0) == pytest.approx(0.1)
    assert I.tail(4.5, 3, 3, 6) == pytest.approx(1, abs=0.3)
    assert I.tail(5, 2, 5, 7 * 48) == 1.0


def days(*d):
    return [("OSHA", "a", "A", str(k), "s", "S", p, "CA", "54", date.fromordinal(737000 + x), 2018) for k, (x, p) in enumerate(d)]


def test_anchor_without_penalties(spark):
    df = spark.createDataFrame(days((0, None), (100, None), (300, None), (900, None)), COLS)
    got = {r["analysis_type"]: r["anchor"].toordinal() - 737000 for r in I.anchors(df).collect()}
    assert got == {"significant_violation": 300}
    near = spark.createDataFrame(days((0, None), (10, None), (20, None), (30, None)), COLS)
    got = {r["analysis_type"]: r["anchor"].toordinal() - 737000 for r in I.anchors(near).collect()}
    assert got == {"significant_violation": 20}


def test_impact_one_side_empty(spark):
    df = spark.createDataFrame(days((0, 10.0), (5, 1.0), (9, 1.0)), COLS)
    r = I.analyses(df).filter("analysis_type = 'significant_violation'").first()
    assert (r["p_method"], r["p_value"], r["impact"], r["rate_change_pct"]) == ("one_empty", 0.01, "Increased", 100.0)
    few = I.analyses(spark.createDataFrame(days((0, 10.0), (5, 1.0)), COLS)).first()
    assert few["impact"] == "Unable to Analyze" and few["rate_change_pct"] == 0


def test_quality(spark):
    years = spark.createDataFrame([(y,) for y in (1990, 2000, 2023, 2050, None)], "year int")
    got = {r["check"]: r["failing_rows"] for r in V.years(years, least=1990, most=2024).collect()}
    assert got == {"year_null": 1, "year_range": 1}
    pens = spark.createDataFrame([(p,) for p in (0.0, 100.0, -50.0, 1e6, None)], "current_penalty double")
    assert {r["check"]: r["failing_rows"] for r in V.penalties(pens).collect()} == {"penalty_negative": 1, "penalty_range": 1}
    states = spark.createDataFrame([(s,) for s in ("CA", "ny", "XX", "California", None)], "site_state string")
    assert {r["state"] for r in V.states(states).collect()} == {"XX", "CALIFORNIA"}
    names = spark.createDataFrame([(n,) for n in ("Valid", "", None, "A" * 1000)], "company_name string")
    assert {r["check"] for r in V.names(names).collect()} == {"name_empty", "name_long", "name_nulls"}
    assert {r["check"] for r in V.structure(names.filter("false"), ["year"]).collect()} == {"empty_table", "missing_column"}


def test_first_by_key_is_stable(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), (None, 0, "x")], "key string, o int, v string")
    assert [tuple(r) for r in A.first_by_key(df, "key", ["o"]).collect()] == [("k", 1, "a")]


@pytest.mark.parametrize("name", ["i01_anchors", "i02_windows", "i03_rate_change", "i04_rank_sums", "i09_timeline", "j08_interval_membership", "w05_mean_ranks"])
def test_impact_queries_take_companies_without_penalties(spark, monkeypatch, name):
    df = spark.createDataFrame(days((0, None), (200, None), (300, None), (350, None), (420, None), (900, None)), COLS)
    monkeypatch.setattr(catalog, "v", lambda s, d: df)
    got = [r.asDict() for r in catalog.queries()[name](spark, "").collect()]
    if name == "w05_mean_ranks":
        assert got == [{"u1": 1.0, "n1": 1, "n2": 1}]
    else:
        assert {(r["company_name_normalized"], r["analysis_type"]) for r in got} == {("A", "significant_violation")}


@pytest.mark.parametrize("name", ["i01_anchors", "i02_windows", "i04_rank_sums", "j08_interval_membership"])
def test_impact_sql_takes_companies_without_penalties(spark, monkeypatch, name):
    import duckdb

    named = lambda name, rows: [(*r[:2], name, *r[3:]) for r in rows]
    rows = named("A", days((0, None), (200, 1.0), (300, None), (350, None), (420, None), (900, 5.0))) + named("B", days((0, None), (40, None), (40, None), (300, None)))
    df = spark.createDataFrame(rows + named("C", days((0, None), (40, None), (100, None), (900, None))), COLS)
    monkeypatch.setattr(catalog, "v", lambda s, d: df)
    got = catalog.queries()[name](spark, "")
    # the rows stand in for the view of violations that the text begins with
    text = catalog.oracle_sql()[name]
    text = "WITH v AS (SELECT * FROM given" + text[text.index("), st AS (") :]
    con = duckdb.connect()
    con.register("given", df.toArrow())
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({text})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and {"B", "C"} <= {r[0] for r in want}


def test_sums_before_in_ranges(spark):
    from docketry.operators import aggregates

    rng = random.Random(6)
    rows = [(rng.choice("aaab"), rng.randrange(100), k, rng.randrange(5), "x") for k in range(400)] + [(None, None, 400, 1, "x")]
    df = spark.createDataFrame(rows, "agency string, d int, k int, n int, part string")
    got = {r["k"]: (r["s"], r["part"]) for r in aggregates.sums_before(df, ["d", "k"], "s", ["agency"], "n").collect()}
    assert got == {r[2]: (sum(q[3] for q in rows if q[0] == r[0] and (q[1], q[2]) < (r[1], r[2])) if r[0] else 0, "x") for r in rows}
    numbered = aggregates.ranked(df, ["d", "k"]).collect()
    for agency in "ab":
        mine = sorted((r["d"], r["k"], r["row_number"]) for r in numbered if r["agency"] == agency)
        assert [r[2] for r in mine] == list(range(1, len(mine) + 1))
    assert len(numbered) == 401


def test_exact_median(spark):
    import statistics

    from docketry.operators import aggregates, quality

    for values in ([1.0], [2.0, 1.0], [5.0, 1.0, 1.0, None, 9.0], [float(k % 7) for k in range(100)]):
        df = spark.createDataFrame([(v,) for v in values], "current_penalty double")
        want = statistics.median(v for v in values if v is not None)
        assert aggregates.exact_median(df, "current_penalty").first()[0] == want
        assert quality.penalty_stats(df).first()["median_penalty"] == want
    assert quality.penalty_stats(df.filter("false")).first()["median_penalty"] is None


def test_peers_by_counts(spark):
    import statistics

    from docketry.operators import risk

    rng = random.Random(9)
    rows = [(f"c{k}", round(rng.randrange(3000, 3040) / 100, 2), rng.choice(["11", "22", None])) for k in range(150)]
    df = spark.createDataFrame(rows, "company_name_normalized string, composite_score double, naics_sector string")
    got = risk.against_peers(df).collect()
    assert len(got) == sum(r[2] is not None for r in rows)
    for r in got:
        peers = [q[1] for q in rows if q[2] == r["naics_sector"]]
        assert r["peer_count"] == len(peers) and abs(r["peer_mean"] - statistics.mean(peers)) < 1e-4 and abs(r["peer_median"] - statistics.median(peers)) <= 5.1e-4
        assert abs(r["percentile"] - 100 * sum(p < r["composite_score"] for p in peers) / len(peers)) < 1e-4


def test_sample_is_seeded(spark):
    from docketry.operators import search

    df = spark.range(500).withColumnRenamed("id", "k")
    one, two, other = ([r["k"] for r in search.sample(df.repartition(p), ["k"], 40, seed).collect()] for p, seed in ((2, 1), (5, 1), (2, 2)))
    assert one == two and one != other and len(set(one)) == 40 and search.sample(df.limit(3), ["k"], 40).count() == 3


def test_a_name_leads_though_a_later_leader_took_its_pairs(spark):
    from docketry.operators.resolve import _leaders

    pairs = spark.createDataFrame([("A", "B"), ("B", "M"), ("M", "R"), ("N", "R")], "a string, b string")
    assert sorted(r[0] for r in _leaders(pairs).collect()) == ["A", "M", "N"]
