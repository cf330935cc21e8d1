import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketry.llm import common, lexical, line_rules, minhash, mixing, periodic, url_templates
from tests.llm.helpers import words

SF = "/root/testdata/sf0.001"


# --- periodic runs ---------------------------------------------------------------
def plain_runs(x):
    """Every run from every lag, its period checked against all smaller ones."""
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and x[e] == x[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(6, 4 * q):
                w = x[s : s + length]
                if not any(w[r:] == w[: length - r] for r in range(1, q)):
                    out.append((s, length, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(x, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(x) if i not in gone)


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n, letters = rng.randint(0, 130), rng.randint(1, 4)
            x = [rng.randint(0, letters) for _ in range(n)]
            if n > 10 and rng.random() < 0.6:
                p, s = rng.randint(1, n // 3), rng.randint(0, n // 2)
                for i in range(s + p, n):
                    x[i] = x[i - p]
                if rng.random() < 0.5:
                    x[rng.randrange(n)] = 9
            docs.append(x)
        got = periodic.find_runs(np.array(sum(docs, []), np.int64), np.append(0, np.cumsum([len(d) for d in docs])))
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, x in enumerate(docs) for r in plain_runs(x)]


def test_runs_with_long_periods():
    rng = np.random.default_rng(2)
    for period, times in ((5000, 4), (700, 9), (18, 2000), (19, 5)):
        unit = rng.integers(0, 10**6, period)
        x = np.concatenate([rng.integers(0, 10**6, 50), np.tile(unit, times), unit[:3], [-1]])
        assert periodic.find_runs(x, np.array([0, len(x)])).tolist() == [[0, 50, period * times + 3, period]]


def test_runs_of_odd_rows(spark):
    long = "a b c " * 40_000
    texts = [None, "", " \n", "x x x x x", "x x x x x x", long, "a b a b a b a b c", "é\u3000ü " * 8, "k " + "y z " * 5 + "y q"]
    df = spark.createDataFrame([(k, t, "r", 1) for k, t in enumerate(texts)] + [(5, long, "r", 1), (None, "t " * 6, "r", 1)], "doc_id long, text string, runs string, whole int")
    got = periodic.periodic_runs(df)
    assert got.columns == ["doc_id", "whole", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        x = words(texts[r["doc_id"]]) if r["doc_id"] is not None else ["t"] * 6
        want = [(0, 120_000, 3)] if r["doc_id"] == 5 else plain_runs(x)
        assert [tuple(run) for run in r["runs"]] == want
        assert (r["n_words"], r["collapsed"]) == (len(x), collapsed(x, want))
    assert periodic.periodic_runs(df.filter("false")).count() == 0


def test_runs_of_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = periodic.op11_periodic_runs(spark, SF).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs) and any(r["n_runs"] for r in got)
    for r in got:
        x, h = words(docs[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and x:
            n, g = len(x), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        if len(x) > 3000:  # quadratic by lags: the words are compared as numbers
            codes = np.unique(x, return_inverse=True)[1]
            runs = []
            for q in range(1, len(x) // 4 + 1):
                same = np.concatenate([[0], (codes[:-q] == codes[q:]).astype(np.int8), [0]])
                edge = np.flatnonzero(np.diff(same))
                for s, e in zip(edge[::2], edge[1::2], strict=True):
                    w = codes[s : e + q]
                    if len(w) >= max(6, 4 * q) and not any(q % d == 0 and (w[d:] == w[:-d]).all() for d in range(1, q)):
                        runs.append((int(s), len(w), q))
            runs.sort(key=lambda run: (run[0], run[2]))
        else:
            runs = plain_runs(x)
        best = max(runs, key=lambda run: (run[1] / run[2], -run[0], -run[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(collapsed(x, runs))


# --- ranked search ---------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=20):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            n = sum(b.values())
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in split(text) if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize(("block", "run"), [(500_000, 1 << 21), (40, 64)])
def test_search_is_exact(spark, monkeypatch, block, run):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "RUN_POSTINGS", run)
    rng = random.Random(block)
    zipf = lambda: f"W{int(rng.paretovariate(0.6)) % 300}"
    docs = [(k, ", ".join(zipf() for _ in range(rng.randrange(1, 60)))) for k in range(400)]
    docs += [(k, docs[7][1]) for k in range(900, 940)] + [(7, docs[7][1]), (None, docs[7][1]), (None, None), (600, ""), (601, "!!! ..."), (602, "é-É Ünï_w1"), (603, "w1 " * 30_000)]
    items = [(k, " ".join(zipf() for _ in range(rng.randrange(1, 25)))) for k in range(30)] + [(30, docs[7][1]), (31, None), (32, ""), (33, "unseen"), (34, "É é W1 w1"), (30, docs[9][1]), (None, "w2 w3")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, codes string").repartition(5)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, item string")
    got = [tuple(r) for r in lexical.ranked_search(d, q).collect()]
    assert sorted(got, key=str) == sorted(plain_search(docs, items), key=str)
    assert lexical.ranked_search(d.filter("false"), q).count() == 0 and lexical.ranked_search(d, q.filter("false")).count() == 0


def test_accumulators_stop(spark):
    # a rare term alone decides, so documents with only the frequent one get no accumulator
    row, code, times = np.arange(100), np.ones(100, np.int32), np.ones(100, np.int64)
    p = lexical.Postings(np.append(row, [3, 4]), np.append(code, np.zeros(2, np.int32)), np.append(times, [1, 1]), np.full(100, 100))
    acc = p.scores(np.array([0, 1], np.int32), np.array([9000, 10], np.int64), 2, 1)
    each = 10**9 // 2200
    assert np.flatnonzero(acc).tolist() == [3, 4] and acc[3] == 9010 * each
    assert np.count_nonzero(p.scores(np.array([0, 1], np.int32), np.array([9000, 10], np.int64), 3, 1)) == 100
    assert not p.scores(np.array([0, 1], np.int32), np.array([9000, 10], np.int64), 3, 10**12).any()


def test_search_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = [tuple(r) for r in lexical.op12_ranked_lexical(spark, SF).collect()]
    assert sorted(got) == sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({lexical.OP12_SQL})").fetchall())


# --- url filters -------------------------------------------------------------------
def test_parts_of_urls_and_rules(spark):
    urls = {
        "HTTP://WWW.Example.ORG/en/1?x#y": ("www.example.org", "/en/1", "example.org/en/1"), "http://example.org/es/a": ("example.org", "/es/a", "example.org/es/"), "http://org/": ("org", "/", "org/"),
        "http://a.org": ("a.org", "", None), "http://borg/": ("borg", "/", None), "x://b.com/fr/://c": ("b.com", "/fr/://c", "com/fr/"), "http://b.com?/de/": ("b.com", "", None), "http://b.com#/de/": ("b.com", "", None),
        "//b.com/de/": ("", "", None), "": ("", "", None), "://": ("", "", None), ":///de/x": ("", "/de/x", None), "http://É.COM/de/É": ("É.com", "/de/É", "com/de/"), "http://x.com/DE/1": ("x.com", "/DE/1", None),
        "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/"), "http://u@h.example.org:80/en/1": ("u@h.example.org:80", "/en/1", None),
    }
    rows = [(k, u, "x", 1) for k, u in enumerate(urls)] + [(None, None, "x", 1), (3, "http://a.org", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string, cut int")
    got = url_templates.judge_urls(df)
    assert got.columns == ["page_id", "url", "cut", *url_templates.RESULTS]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["host"], r["path"], r["rule"]) == urls.get(r["url"], ("", "", None))
        if r["rule"]:
            assert r["verdict"] == {f"{h}{p}": v for h, p, v in url_templates.RULES}[r["rule"]]
        else:
            assert r["verdict"] == r["template_verdict"]
    assert url_templates.judge_urls(df.filter("false")).count() == 0
    assert {r["rule"] for r in url_templates.judge_urls(df, []).collect()} == {None}
    with pytest.raises(ValueError):
        url_templates.judge_urls(df, [("a", "/", "allow"), ("a", "/", "block")])


def test_templates(spark):
    rng = random.Random(9)
    rules = [("shop.test", "/ads/a", "block"), ("shop.test", "/ads/b", "block"), ("shop.test", "/news/a", "allow"), ("spam.test", "/a", "block")]
    urls = [f"http://shop.test/{s}/{rng.choice('abcdefgh')}{k}" for s in ("ads", "news") for k in range(200)]
    urls += [f"http://shop.test/{''.join(rng.choices('klmnop', k=8))}/x{k}" for k in range(50)]
    urls += [f"http://spam.test/{rng.choice('ab')}{k}/z" for k in range(120)] + [f"http://calm.test/ads/{k}" for k in range(40)]
    urls += ["http://shop.test/ads/" + "q/" * 3000, "http://shop.test/ads/" + "é" * 30_000]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    by = {r["url"]: r for r in url_templates.judge_urls(df, rules).collect()}
    of = lambda start: [r for u, r in by.items() if u.startswith(start) and r["rule"] is None]
    # what no rule decides goes with its template: under ads blocked, under news allowed
    assert len(of("http://shop.test/ads/")) > 50 and {r["verdict"] for r in of("http://shop.test/ads/")} == {"block"}
    assert len(of("http://shop.test/news/")) > 50 and {r["verdict"] for r in of("http://shop.test/news/")} == {"allow"}
    # a host that is blocked wherever it is labelled is blocked, one without labels isn't
    assert {r["verdict"] for r in of("http://spam.test/")} == {"block"} and {r["verdict"] for r in of("http://calm.test/")} == {"allow"}
    # rare words are one wildcard
    assert {r["template"].split("/")[1] for r in of("http://shop.test/") if r["path"].count("/x")} == {"*"}
    assert by[urls[-2]]["template"].endswith("**") and by[urls[-2]]["purity"] > 0.8


def test_branches_that_are_alike_merge(spark):
    rules = [("a.test", f"/{s}/1", "block") for s in ("en", "de")] + [("a.test", f"/{s}/2", "allow") for s in ("en", "de", "fr")]
    urls = [f"http://a.test/{s}/{d}{k}" for s in ("en", "de", "fr") for d in (1, 2) for k in range(30)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r["path"].split("/")[1]: r["template"] for r in url_templates.judge_urls(df, rules).collect()}
    assert got == {"en": "/{de|en}/#", "de": "/{de|en}/#", "fr": "/fr/#"}


@pytest.mark.parametrize("size", ["tiny", "odd"])
def test_templates_match_sql(spark, tmp_path, size):
    path = f"{SF}"
    if size == "odd":
        rng = random.Random(4)
        part = lambda: rng.choice(["en", "de", "fr", "es", "a b", "*", "", "x" + "".join(rng.choices("abcd", k=5)), str(rng.randrange(99)), "p1.html"])
        urls = [None, "", "no", "http://"] + [f"http://{rng.choice(['example.org', 'w.example.org', 'b.com', 'c.b.com', 'x.net'])}/{'/'.join(part() for _ in range(rng.randrange(0, 11)))}" for _ in range(1500)]
        pd.DataFrame({"page_id": range(len(urls)), "url": urls, "html": None}).to_parquet(tmp_path / "pages.parquet")
        path = str(tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    columns = "page_id, host, path, rule, verdict, template, purity, template_verdict"
    got = [tuple(r) for r in url_templates.op13_url_templates(spark, path).select(*columns.split(", ")).collect()]
    want = con.sql(f"SELECT {columns} FROM ({url_templates.OP13_SQL})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 20


# --- odd rows of earlier operators ----------------------------------------------------
@pytest.mark.parametrize("order", [1, 2, 3])
def test_one_id_with_several_texts_links_them(spark, order):
    rng = random.Random(6)
    a, b, c = ([f"{x}{k}" for k in range(100)] for x in "abc")
    near = lambda w: " ".join(w[:97] + ["new"] * 3)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (8, near(b)), (9, " ".join(c)), (12, " ".join(c)), (12, "lone words here"), (12, None), (13, None), (2, near(c)), (20, " ".join(a))]
    rng = random.Random(order)
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(order)).collect()
    want = {5: 5, 7: 5, 8: 5, 20: 5, 9: 2, 12: 2, 2: 2, 13: 13}
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, want[i]) for i, _ in rows)


def test_cells_are_cut_by_their_sets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", 1000)
    links = [f"c{k}" for k in range(900)]
    texts = [" ".join(links[k : k + 150]) for k in range(0, 700, 9)] + [" ".join(f"z{k}" for k in range(40_000))] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {k: 0 if k < len(texts) - 2 else len(texts) - 2 for k in range(len(texts))}


def test_mix_with_equal_rows_at_a_cut_and_clashing_names(spark):
    names = ["_of", "_here", "of", "here", "place", "sum", "start", "its_of", "key", "cut"]
    rows = [("one two three", "hot", *"x" * len(names))] * 400 + [("z " * 400, "other", *"x" * len(names))] * 9 + [("q " * 900, None, *"x" * len(names))]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in ("text", "source", *names))).repartition(4)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and {r["_of"] for r in got} == {"x"}
    for source, target in {r["source"]: r["target"] for r in got}.items():
        assert sum(r["taken"] for r in got if r["source"] == source) == int(target + 1e-9)


def test_targets_of_very_large_sources(spark):
    big = 3 * 10**14
    sources = spark.range(20_001).select(F.format_string("s%05d", "id").alias("source"), F.lit(big).alias("source_size"))
    assert mixing._targets(sources, (5, 2, 1), 3).agg(F.sum("target")).first()[0] == pytest.approx(20_001.0 * big)


def test_line_ends_match_sql(spark):
    good = "\n".join(" ".join(f"w{i}x{k}" for k in range(12)) + "." for i in range(5))
    ends = ["", "\r", " ", "\t\r", "\u0085", "\u2028", "\x0b", "\x0c ", "\u00a0", "\r\r", "."]
    texts = [f"{good}\n{head}{mark}{end}" for head in ("ab", "one two", "a b c d", "longer " * 9) for mark in (".", "", "”", "x") for end in ends]
    texts += [t.replace("\n", "\r\n") for t in texts] + [None, "", "\r", "\u2028"]
    pdf = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", pdf)
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars"
    want = con.sql(f"SELECT {columns} FROM ({line_rules.OP6_SQL})").fetchall()
    got = line_rules.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    crlf = next(r for r in got if r["doc_id"] == texts.index(f"{good}\nab.\r"))
    assert crlf["lost_chars"] == 0


def test_stored_tables_are_removed(spark):
    kept = common.stored(spark.range(3), "kept")
    path = kept.inputFiles()[0]
    assert kept.count() == 3 and common.clean(spark) >= 1 and common.clean(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
