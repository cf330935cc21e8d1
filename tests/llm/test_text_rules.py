import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketry.llm import components as components_module
from docketry.llm import line_rules, minhash, mixing
from tests.llm.helpers import components, shingle_set, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, key string, cut string, _of string, Of string, here string, found string"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def repeated(w):
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({p for hits in at.values() if len(hits) > 1 for i in hits for p in (i, i + 1, i + 2)})


def test_line_rules(spark):
    rng = random.Random(1)
    good = "\n".join(prose(rng, 12) + "." for _ in range(8))
    menu = "Home | News | Sport | Contact"
    texts = [
        None, "", " \t\n", "one two", good, f"{menu}\n{good}\nAll rights reserved 2024.\nshort bit", "\n".join([menu + " | a | b"] * 40 + [good[:60] + "."]), "a b c " * 100, "x\ny.\nx\n\n \nx",
        "A!! " * 60, " ".join(f"t{i}###" for i in range(80)), "é\x0bü z　q " + good, good + " " + good, "w " * 20_000, prose(rng, 30_000, 10**7),
    ]
    rows = [(k, t, None, None, None, None, "s", *"abcdef") for k, t in enumerate(texts)] + [(4, good, None, None, None, None, "s", *"abcdef")]
    got = line_rules.clean_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words(r["text"])
        assert r["n_words"] == len(w)
        assert r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum((r["text"] or "").count(c) for c in "#*$%&|<>")
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(w)
        assert r["base_failed"] == (len(w) < 50 or 100 * repeated(w) > 50 * len(w))
    by = {r["doc_id"]: r for r in got}
    assert by[4]["kept"] and by[5]["kept"] and by[5]["clean_text"] == good
    assert by[0]["clean_text"] is None and not by[0]["kept"] and by[1]["clean_text"] == ""
    assert not by[6]["kept"] and not by[9]["kept"] and not by[10]["kept"]
    assert line_rules.clean_lines(spark.createDataFrame([], DOCS)).count() == 0


def targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        weight = sum(w[s] for s in order if s not in full)
        t = {s: 3 * sizes[s] if s in full else rest * w[s] / weight for s in order}
        over = {s for s in order if s not in full and t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 64), (2, 1 << 14)])
def test_mix(spark, seed, ranges):
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.randrange(0, 60)), None, rng.choice(["a", "b", "c", "é", "z", None] + ["a"] * 10), None, None, "s", *"abcdef") for k in range(600)]
    rows += [(1000, None, None, "a", None, None, "s", *"abcdef"), (1001, "", None, "only-empty", None, None, "s", *"abcdef"), (None, "q r", None, "b", None, None, "s", *"abcdef"), (5, "same same", None, "c", None, None, "s", *"abcdef"), (5, "same same", None, "c", None, None, "s", *"abcdef")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(df, ranges=ranges).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert taken[s] == int(t + 1e-9)
    again = mixing.mix_sources(df.repartition(7), ranges=ranges).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert got[0]["key"] == "a" and got[0]["Of"] == "d"
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = mixing.op9_mix_sources(spark, "/root/testdata/sf0.001").select("doc_id", "size", "source_size", "target", "taken", "source").collect()
    want = con.sql(f"SELECT doc_id, size, source_size, target, taken, source FROM ({mixing.OP9_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_mix_keeps_few_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, "t")], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert {r["text"] for r in mixing.mix_sources(df).collect()} == {"a b", None}


def test_mix_of_equal_rows(spark):
    rows = [(None, "one two three", "hot")] * 500 + [(k, "x y", "hot") for k in range(5)] + [(k, "z " * 400, "other") for k in range(9)] + [(1, "q " * 900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_sources(df).collect()
    want = targets({"hot": 1510, "other": 3600, None: 900})
    for s, t in want.items():
        assert sum(r["taken"] for r in got if r["source"] == s) == int(t + 1e-9)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and len(got) == len(rows)


def changed(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("cluster", "chunk"), [(20_000, 512), (2, 512), (20_000, 7)])
def test_near_duplicates(spark, monkeypatch, cluster, chunk):
    monkeypatch.setattr(minhash, "CLUSTER", cluster)
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = random.Random(3)
    texts = [None, "", " \n", "Hi", "hi", "a b c d", "A B\tC\nD", "x y z a b", "x y z a b c"]
    for _ in range(12):
        base = prose(rng, 150)
        texts += [base, base.upper(), base + " tail", *[changed(rng, base, rng.randrange(1, 9)) for _ in range(8)]]
    hot = prose(rng, 140)
    texts += [changed(rng, hot, rng.randrange(1, 8)) for _ in range(120)]
    # members that are alike in chains and by halves, so that leaders don't join them
    for step in (4, 12):
        links = [f"c{step}n{k}" for k in range(700)]
        texts += [" ".join(links[k : k + 120]) for k in range(0, 500, step)]
    texts += [" ".join(hot.split()[:110] + prose(rng, 40).split()) for _ in range(40)]
    texts += [prose(rng, 20_000, 10**6)] * 2
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i * 3, t, "x") for i, t in rows] + [(3 * 9, texts[9], "x"), (None, "null id", "x"), (None, texts[9], "x"), (None, None, "x")], "doc_id long, text string, rep string")
    got = minhash.near_duplicates(df).collect()
    sets = {i * 3: shingle_set(t) for i, t in rows}
    want = components(sets)
    assert len(got) == len(rows) + 4
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == sorted([str(want[27]), "None", "None"])
    for r in got:
        if r["doc_id"] is None:
            assert not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(df.filter("false")).count() == 0


def test_estimate(spark):
    rng = random.Random(8)
    a = [f"u{rng.randrange(10**9)}" for _ in range(2000)]
    for k in (0, 200, 500, 1000):
        b = a[: len(a) - k] + [f"v{i}" for i in range(k)]
        df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
        sig = df.select("doc_id", minhash.shingles("text").alias("sh")).mapInArrow(minhash._signatures, "doc_id long, n_shingles long, p1 long, p2 long, sig array<long>, bands array<long>")
        rows = {r["doc_id"]: r["sig"] for r in sig.collect()}
        pair = spark.createDataFrame([(rows[1], rows[2])], "s array<long>, t array<long>")
        got = pair.select(minhash.estimate(F.col("s"), F.col("t"))).first()[0]
        sa, sb = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        assert got == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.13)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(components_module, "BROADCAST_ROWS", limit)
    rng = random.Random(limit)
    edges = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(400, 520)] + [(900, 900), (None, 3), (4, None)] + [(rng.randrange(600, 800), rng.randrange(600, 800)) for _ in range(150)]
    up = {k: k for e in edges if None not in e for k in e}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        if None not in (a, b):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in components_module.components(df).collect()}
    assert got == {k: root(k) for k in up}
    assert components_module.components(df.filter("false")).count() == 0
    with pytest.raises(RuntimeError):
        components_module.components(df, max_rounds=1)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from docketry.llm import common

    context = SimpleNamespace(getConf=lambda: {}, master="local-cluster[2,1,1024]")
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(sparkContext=context))
    assert common.free(["a", "_A", "b"], "a", "c") == ("__a", "c")
