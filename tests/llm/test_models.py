import math
import random
import re
import zlib

import numpy as np
import pytest

from docketry.llm import langid, pieces, quality_mil

SF = "/root/testdata/sf0.01"
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_vectors_are_sums_of_bound_letters():
    enc = langid.Encoder(dim=64)
    v = {c: langid._letter(ord(c), 64, enc.seed).astype(int) for c in " abc"}
    bind = lambda g: np.roll(v[g[0]], 2) * np.roll(v[g[1]], 1) * v[g[2]]
    want = sum(bind(g) for g in (" ab", "abc", "bc ", "c a", " a "))
    got = enc.encode(["ABC, 1a", "", "?!", "abc a"])
    assert (got[0] == want).all() and (got[3] == want).all() and not got[1:3].any()


@pytest.mark.parametrize("step", [3, 7, 64, 10**6])
def test_long_text_is_bundled_whole(monkeypatch, step):
    enc = langid.Encoder(dim=64)
    text = "abcd efg h. " * 300
    texts = ["x", text, None, "y", "a bc", "", "cab " * 50]
    padded = f" {re.sub(r'[^a-z]+', ' ', text)} "
    v = {c: langid._letter(ord(c), 64, enc.seed).astype(int) for c in set(padded)}
    whole = sum(np.roll(v[p], 2) * np.roll(v[q], 1) * v[r] for p, q, r in zip(padded, padded[1:], padded[2:]))  # noqa: B905
    apart = [enc.encode([t or ""])[0] for t in texts]
    monkeypatch.setattr(langid, "BLOCK_CHARS", 900)
    monkeypatch.setattr(langid, "STEP", step)
    parts = list(langid.vectors(enc, texts))
    assert [(a, b) for a, b, _ in parts] == [(0, 1), (1, 2), (2, 7)]
    got = np.concatenate([x for _, _, x in parts])
    assert (got[1] == whole).all() and (got == np.array(apart)).all()


def test_one_letter_has_a_language():
    enc = langid.Encoder(dim=64)
    v = {c: langid._letter(ord(c), 64, enc.seed).astype(int) for c in " a"}
    want = np.roll(v[" "], 2) * np.roll(v["a"], 1) * v[" "]
    assert (enc.encode(["a"])[0] == want).all() and (enc.encode(["b c", "a"])[1] == want).all()


def test_learning_by_plain_sums(spark):
    enc = langid.Encoder(dim=64)
    rows = [("the cat", "en"), ("the dog and the cat", "en"), ("der hund", "de"), (None, "de"), ("x", None), ("12", "fr")]
    langs, proto = langid.learn(spark.createDataFrame(rows, "text string, lang string").repartition(3), enc)
    assert langs == ["de", "en", "fr"]
    for lang, p in zip(langs, proto, strict=True):
        assert (p == sum(np.sign(enc.encode([t])[0]) for t, x in rows if x == lang and t)).all()
    asked = ["a cat", "hund der", "q"]
    got = langid.identify(spark.createDataFrame([(t,) for t in asked], "text string"), langs, proto, enc).collect()
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b) if b.any() else 0
    for t, r in zip(asked, got, strict=True):
        each = [round(cos(enc.encode([t])[0], p), 9) for p in proto]
        assert r["lang_pred"] == langs[int(np.argmax(each))] and r["score"] == pytest.approx(max(0, max(each)))


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    with pytest.raises(ValueError):
        langid.learn(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, lang string"))


def test_language(spark):
    got = langid.op2_language_id(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in docs if held(i)}
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out)
    assert right >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    train = spark.createDataFrame([("the cat and the dog", "en", 1), ("der hund und die katze", "de", 2), ("null lang", None, 3), (None, "fr", 4)], "text string, lang string, score long")
    langs, proto = langid.learn(train)
    assert langs == ["de", "en"]
    rows = spark.createDataFrame([(None, 1.0), ("", 1.0), ("12 !?", 1.0), ("the dog", 1.0), ("the dog", 1.0), ("\x00der die und", 1.0)], "text string, score double")
    got = [r["lang_pred"] for r in langid.identify(rows, langs, proto).collect()]
    assert got == ["und", "und", "und", "en", "en", "de"]
    assert langid.identify(rows.filter("false"), langs, proto).count() == 0
    none, empty = langid.learn(train.filter("false"))
    assert none == [] and {r["lang_pred"] for r in langid.identify(rows, none, empty).collect()} == {"und"}


def test_quality_gradient():
    rng = np.random.default_rng(0)
    x, bags = rng.normal(size=(40, quality_mil.N_FEATURES)), np.array([1, 5, 4, 10, 20])
    y = np.array([0, 1, 0, 1, 1.0])
    model = quality_mil.Model.fit(x, bags, y, steps=400)
    assert ((model.score(x, bags) > 0.5) == (y > 0.5)).all()
    assert np.isfinite(model.score(x * 1e6, bags)).all()


def plain_score(model, x, bags):
    """The forward pass, passage by passage."""
    p, out, at = model.weights, [], 0
    for n in bags:
        hs = [np.tanh(np.array([sum(v * w for v, w in zip(row, col, strict=True)) for col in p["W"].T]) + p["b"]) for row in x[at : at + n]]
        e = [sum(w * math.tanh(h @ v) / (1 + math.exp(-(h @ u))) for w, v, u in zip(p["w"], p["V"].T, p["U"].T, strict=True)) for h in hs]
        a = [math.exp(k - max(e)) for k in e]
        z = sum(k / sum(a) * h for k, h in zip(a, hs, strict=True))
        out.append(1 / (1 + math.exp(-(z @ p["c"] + p["d"]))))
        at += n
    return np.array(out)


def test_quality_by_plain_forms():
    rng = np.random.default_rng(1)
    x, bags, y = rng.normal(size=(14, 20)), np.array([1, 5, 2, 6]), np.array([0, 1, 1, 0.0])
    model = quality_mil.Model.fit(x, bags, y, hidden=5, gate=3, steps=4)
    z = (x - model.mean) / model.std
    assert np.allclose(model.score(x, bags), plain_score(model, z, bags))
    loss = lambda: -np.mean(y * np.log(s := plain_score(model, z, bags)) + (1 - y) * np.log(1 - s))
    for name, g in model.gradient(z, bags, y).items():
        at = tuple(0 for _ in np.shape(g))
        kept, eps = np.array(model.weights[name]), 1e-5
        each = []
        for sign in (1, -1):
            changed = kept.copy()
            changed[at] += sign * eps
            model.weights[name] = changed
            each.append(loss())
        model.weights[name] = kept
        assert np.asarray(g)[at] == pytest.approx((each[0] - each[1]) / 2 / eps, abs=1e-7)


def test_passages_see_words():
    a, b, c, d = (quality_mil.passages([t])[0][0] for t in ("red house tree", "Tree RED house", "red house lamp", "red  house\ttree"))
    words = slice(quality_mil.N_COUNTS, quality_mil.N_COUNTS + quality_mil.WORDS)
    assert (a[words] == b[words]).all() and (a == d).all() and (a[words] != c[words]).any()
    grams = slice(words.stop, None)
    assert (a[grams] == b[grams]).all() and (a[grams] != c[grams]).any()
    # a word's trigrams don't cross into the next
    assert np.allclose(quality_mil.passages(["ab cd"])[0][0][grams], 0)
    one = quality_mil.passages(["abc " * 64])[0][0]
    assert np.abs(one[words]).sum() == pytest.approx(8) and np.abs(one[grams]).sum() == pytest.approx(4)


def test_quality_of_words_alone(spark):
    rng = random.Random(4)
    good, bad = "ample brook cedar delta ember".split(), "fjord gnome hazel ivory jolly".split()
    rows = []
    for k in range(300):
        own = good if k % 2 else bad
        rows.append((k, " ".join(rng.choice(own) if rng.random() < 0.3 else f"w{rng.randrange(100, 999)}" for _ in range(rng.randrange(5, 300))), k % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_mil.learn(df.filter("doc_id < 200"), df.select("doc_id", "quality"))
    got = {r["doc_id"]: r["score"] for r in quality_mil.score_quality(df.filter("doc_id >= 200"), model).collect()}
    assert sum((s >= 0.5) == bool(k % 2) for k, s in got.items()) >= 90


def test_quality_sample_is_bounded(spark, monkeypatch):
    rows = [(k, "good words here. " * 30 if k % 2 else "X#1 " * 90, k % 2) for k in range(60)] + [(0, "other text", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    labels = df.select("doc_id", "quality")
    seen = []
    fit = quality_mil.Model.fit.__func__
    monkeypatch.setattr(quality_mil.Model, "fit", classmethod(lambda cls, x, bags, y: (seen.append((len(x), len(bags))), fit(cls, x, bags, y, steps=3))[1]))
    one, two = (quality_mil.learn(df, labels, max_train=20, max_passages=25) for _ in range(2))
    assert seen[0][0] <= 25 and seen[0][1] <= 20 and seen[0] == seen[1] and all((one.weights[k] == two.weights[k]).all() for k in one.weights)
    long = spark.createDataFrame([(1, "good words here. " * 60_000), (2, None)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality_mil.score_quality(long, one).collect())


def test_passages():
    x, each = quality_mil.passages(["", "one two", "  ", "w " * 200])
    assert each.tolist() == [1, 1, 1, 4] and len(x) == 7 and not x[0].any() and not x[2].any()
    assert np.allclose(quality_mil.passages(["one two"])[0], x[1:2])


def test_quality(spark):
    got = {r["doc_id"]: r for r in quality_mil.op3_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [(got[i]["score"], y) for i, y in labels.items() if held(i)]
    good, bad = [s for s, y in out if y], [s for s, y in out if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b", 9), (3, "a b", 9)], "doc_id long, text string, score long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_mil.learn(docs, none)
    assert [r["score"] for r in quality_mil.score_quality(docs, model).collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (3, 1), (2, None)], "doc_id long, quality int")
    assert quality_mil.learn(docs, one).constant == 1.0
    assert quality_mil.score_quality(docs.filter("false"), model).count() == 0


def test_pieces_match_library():
    enc = pieces.Encoder(MODEL)
    rng = random.Random(2)
    texts = ["", " ", "  a  b ", "\n\n", "日本語 テスト 🤖", "<s> </s> <0x41>", "▁▁x a▁b", "a" * 500, "ab " * 300, "x\x00y", "é" * 60 + " ñ", "　"]
    texts += ["".join(rng.choice("abcdeé 　\n中🤖ß▁<>s0x") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    want = enc.lib.encode(texts, add_eos=True)
    assert enc.encode(texts, check="texts") == want
    assert enc.encode(texts, check="words") == want
    rows = [[enc.char.get(c, -2 - ord(c)) for c in f"▁{t}"] for t in ("hello", "internationalisation", "aaaaaaa")]
    assert [enc._heap(r) for r in rows] == [enc.lib.encode(t) for t in ("hello", "internationalisation", "aaaaaaa")]


def test_pieces_share_parts():
    """Words that differ by punctuation and line ends only are encoded once."""
    enc = pieces.Encoder(MODEL)
    ends = ["", ".", ",", ";", "!", ".\n", "\n", ")", "***", "$$$", ".\nAnd", ",and", "7", "²."]
    texts = [" ".join(f"{a}{b}{c}{e}" for a in "klmnprst" for b in "aeiou" for c in "dgkn") for e in ends]
    assert enc.encode(texts) == enc.lib.encode(texts, add_eos=True)
    assert len(enc.known) < 400 < len({w for t in texts for w in t.split(" ")})
    marks = ["a\n", "a \n", " \n b", "\n▁", "▁\n▁▁", ". ", "a▁.", "é²\n中 中", "x" * 60 + "\n" + "y" * 60]
    for check in ("words", "texts"):
        enc.forget()
        assert enc.encode(marks, check) == enc.lib.encode(marks, add_eos=True)


@pytest.mark.parametrize("part", [" ", "\n", " the", "The"])
@pytest.mark.parametrize("check", ["words", "texts"])
def test_pieces_see_wrong_ids(monkeypatch, part, check):
    enc = pieces.Encoder(MODEL)
    made = enc.words

    def wrong(words):
        ids, n = made(words)
        at = [k for k, w in enumerate(words) if w == part.replace(" ", pieces.MARK)]
        ids[[n[:k].sum() for k in at]] += 1
        return ids, n

    monkeypatch.setattr(enc, "words", wrong)
    with pytest.raises(ValueError, match="library"):
        enc.encode(["in the\nThe "], check)


def test_pieces_forget(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 3)
    enc = pieces.Encoder(MODEL)
    texts = ["one two three four five", "six one", "two"]
    assert [enc.encode([t])[0] for t in texts] == enc.lib.encode(texts, add_eos=True)


def test_pieces_on_documents(spark):
    import hashlib

    enc = pieces.Encoder(MODEL)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in pieces.op4_sentencepiece(spark, SF).collect()}
    for i, text in docs.items():
        ids = enc.lib.encode(text, add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(enc.lib.decode(ids).encode()).hexdigest()


def test_pieces_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id long, text string, ids string")
    got = [r["ids"] for r in pieces.encode_texts(df, MODEL).collect()]
    assert got[0] == got[1] == [2] and got[2] == got[3] and len(got[2]) > 1
    found = pieces.encode_texts(df, MODEL, ("n_tokens",))
    assert found.columns == ["doc_id", "text", "ids", "n_tokens"] and [r["ids"] for r in found.collect()] == ["x"] * 4
    assert pieces.encode_texts(df.filter("false"), MODEL).count() == 0


@pytest.mark.parametrize("chars", [1, 40, 10**6])
def test_pieces_by_runs(spark, monkeypatch, chars):
    enc = pieces.Encoder(MODEL)
    texts = [None, "", "one two", "x" * 90, "dos tres", "a " * 300, "é🤖"]
    assert [*pieces._runs(np.array([5, 0, 90, 3, 3]), 10)] == [(0, 2), (2, 3), (3, 5)]
    monkeypatch.setattr(pieces, "RUN_CHARS", chars)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = pieces.encode_texts(df, MODEL, ("ids", "decoded"), check="texts").orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == enc.lib.encode([t or "" for t in texts], add_eos=True)
    assert [r["text"] for r in got] == texts and [r["decoded"] for r in got] == enc.lib.decode([r["ids"] for r in got])
