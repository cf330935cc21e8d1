import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry import catalog
from docketry.functions import names as N
from docketry.operators import resolve as R
from docketry.operators import graph, search, similar


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


CASES = {
    "Amazon.com, Inc.": "AMAZON COM", "Acme Holdings, Inc.": "ACME HOLDINGS", "X INC HOLDINGS": "X INC", None: "", "": "", "  the Café  Co.": "CAFÉ",
    "AN A THE": "", "Box_1 L.L.C.": "BOX_1", "Cox Cox": "COX COX", "INC": "INC",
}


def test_normalized(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "name string")
    got = {r["name"]: r["n"] for r in df.select("name", N.normalized("name").alias("n")).collect()}
    assert got == CASES


@settings(max_examples=200, deadline=None)
@given(st.text("AB C", max_size=12), st.text("AB C", max_size=12))
def test_measures(a, b):
    assert N._lcs(a, b) == lcs(a, b)
    for f in N.MEASURES.values():
        assert 0 <= f(a, b) <= 100.0001
        assert f(a, b) == pytest.approx(f(b, a))
    if a.strip():
        assert N.similarity(a, a) == pytest.approx(100)


def slow_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    windows = lambda x, y: [N.ratio(x, y[max(0, end - len(x)) : min(end, len(y))]) for end in range(1, len(y) + len(x))]
    return max(windows(a, b) + (windows(b, a) if len(a) == len(b) else []))


@settings(max_examples=400, deadline=None)
@given(st.text("AB C", max_size=9), st.text("AB C", max_size=25))
def test_windows_that_are_passed_over_are_never_best(a, b):
    assert N.partial_ratio(a, b) == slow_partial(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("ABC ", min_size=1, max_size=14), st.text("ABC ", min_size=1, max_size=14), st.sampled_from([60, 75, 85, 90]))
def test_no_pair_over_the_threshold_is_passed_over(a, b, threshold):
    a, b = " ".join(a.split()), " ".join(b.split())
    if a and b and a != b:
        want = round(N.similarity(a, b), 6)
        got = similar.compared([a], [b], threshold)[0]
        assert got == ([(min(a, b), max(a, b), want)] if want >= threshold else [])


def test_components_and_large_ones_by_rounds(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(f"N{rng.randrange(60):02}", f"N{rng.randrange(60):02}") for _ in range(45)] + [(f"C{k:03}", f"C{k + 1:03}") for k in range(70)] + [(None, "N01")]
    at = {x: x for e in edges[:-1] for x in e}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges[:-1]:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect())
    assert got == {x: root(x) for x in at}
    names = ["ACME TOOL " + x for x in ("A", "B", "AB", "ABC", "ABCD", "ABCDE", "ABCDEF", "BCDEF")] + ["ZED", "ZEDD"]
    df = spark.createDataFrame([(n,) for n in names], "norm string")
    want = {(m, g[0]) for g in R.brute_groups(names, 85) for m in g}
    for most in (500_000, 3):
        monkeypatch.setattr(R, "COMPONENT", most)
        assert {(r["norm"], r["leader"]) for r in R.group_similar(df, 85).collect()} == want


def test_few_pairs_are_scored(spark):
    rng = random.Random(11)
    parts = ["".join(rng.choices("EEEAAIIOONNRRTTSSLLCUDPMHGBFYWKVXZJQ", k=rng.randrange(4, 10))) for _ in range(900)]
    base = [" ".join(rng.choices(parts, k=rng.randrange(2, 5))) for _ in range(1500)]
    odd = [rng.choice("QXZ") + b[1:] for b in base[:60]] + [" ".join(reversed(b.split(" "))) for b in base[60:120]] + [b[:3] + b[4:] for b in base[120:180]]
    names = sorted(set(base + odd))
    df = spark.createDataFrame([(n,) for n in names], "norm string")
    got = {tuple(r) for r in similar.similar_pairs(df, 85).select("a", "b").collect()}
    want = {(a, b) for a, b in ((min(x, y), max(x, y)) for x, y in zip(base, odd, strict=False) if x != y) if N.similarity(a, b) >= 85}
    assert want <= got and len(want) > 50
    counts = similar.join_counts(df, 85).first()
    assert counts["found"] == len(got) and counts["scored"] < 0.01 * len(names) * (len(names) - 1) / 2


def test_hand_values():
    assert N.ratio("ABC", "ABD") == pytest.approx(200 * 2 / 6)
    assert N.partial_ratio("RED", "BIG RED BOX") == 100
    assert N.token_sort_ratio("B A", "A B") == 100
    assert N.token_set_ratio("A B", "A B C") == 100
    assert N.similarity("", "A") == 0


def test_column_form(spark):
    df = spark.createDataFrame([("RED BOX", "RED BAX"), (None, "A")], "a string, b string")
    got = [r[0] for r in df.select(N.measure("weighted", "a", "b")).collect()]
    assert got == [round(N.similarity("RED BOX", "RED BAX"), 6), None]


def test_groups_match_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices(string.ascii_uppercase, k=6)) + " " + "".join(rng.choices(string.ascii_uppercase, k=7)) for _ in range(30)]
    names = base + [b[:-1] + "Q" for b in base[:20]] + [b + "X" for b in base[:10]]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("norm", N.normalized("name"))
    got = {}
    for r in R.group_similar(df, 85).collect():
        got.setdefault(r["leader"], set()).add(r["norm"])
    want = {g[0]: set(g) for g in R.brute_groups(names, 85)}
    assert got == want


def test_best_match(spark):
    names = R.distinct_names(spark.createDataFrame([("Amazon",), ("Apple",), (None,), ("",)], "company_name string"))
    assert [r["name"] for r in R.best_match(names, "amazon").collect()] == ["Amazon"]
    assert R.best_match(names, "XYZ Company", 80).count() == 0


def test_pairs_without_a_common_beginning(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 3)
    rng = random.Random(7)
    names = ["KENTUCKY", "CENTUCKY", "JACKSON", "YACKSON", "GENERALMOTORS", "JENERALMOTORS", "ACE TOY BOX", "TOY BOX ACE", "É", "X"]
    names += ["".join(rng.choices("ABCD ", k=rng.randrange(4, 14))) for _ in range(60)]
    names = sorted({" ".join(n.split()) for n in names} - {""})
    df = spark.createDataFrame([(n,) for n in names], "norm string")
    for threshold in (70, 85):
        got = sorted(tuple(r) for r in R.similar_pairs(df, threshold).select("a", "b", "similarity").collect())
        score = lambda a, b: round(N.similarity(a, b), 6)
        want = [(a, b, score(a, b)) for k, a in enumerate(names) for b in names[k + 1 :] if score(a, b) >= threshold]
        assert got == want
    assert ("CENTUCKY", "KENTUCKY") in {(a, b) for a, b, _ in want}


def test_watch_list_finds_misspellings(spark):
    names = R.distinct_names(spark.createDataFrame([("Bleu Lapm",), ("Zzz",)], "company_name string"))
    assert [r["name"] for r in R.watch_list(names, ["Blue Lamp LLC"], 70).collect()] == ["Bleu Lapm"]


def test_top_names_and_search_miss_no_name(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_ROWS", 10)
    cols = "company_name string, agency string, activity_nr string"
    rows = [("Red", "OSHA", str(k)) for k in range(30)] + [(n, "EPA", "x") for n in ("Rde", "Redd", "Ret", "Bred", "Zzz", None)]
    df = spark.createDataFrame(rows, cols).withColumn("company_name_normalized", N.normalized("company_name"))
    monkeypatch.setattr(catalog, "v", lambda s, d: df)
    top = [r["company_name"] for r in catalog.queries()["a22_top_matched_names"](spark, "").collect()]
    assert top == sorted(["Red", "Rde", "Redd", "Ret", "Bred"], key=lambda n: (-round(N.similarity(n.upper(), "RED"), 6), n))
    monkeypatch.setattr(search, "MOST_ROWS", 10_000)
    found = {r["company_name"] for r in catalog.queries()["f11_search_company"](spark, "").collect()}
    assert found == {n for n in ("Red", "Rde", "Redd", "Ret", "Bred", "Zzz") if N.similarity(n.upper(), "RED") >= 50} and "Rde" in found


def test_match_rows_has_no_limit(spark):
    df = spark.range(1200).select(F.concat(F.lit("Red Plate Promo "), F.col("id")).alias("company_name"))
    assert R.match_rows(df, "red plate promo", 50).count() == 1200
    assert R.match_rows(df, "red plate promo", 50, limit=7).count() == 7
