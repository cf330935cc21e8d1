import hashlib
import random
import zlib

import numpy as np
import pytest

from docketry.llm import langid, line_rules
from tests.llm.helpers import components, shingle_set, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Each stage's input and output rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, SF)
        rows = got.collect()
        out.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, got.schema)
    return out


def test_columns(steps):
    for name, before, after in steps[:-1]:
        assert list(after[0].asDict()) == list(before[0].asDict()), name


def test_dedup_stage(steps):
    _, before, after = steps[2]
    want = components({r["doc_id"]: shingle_set(r["text"]) for r in before})
    assert {r["doc_id"] for r in after} == {i for i, c in want.items() if i == c}


def test_mix_stage(steps):
    _, before, after = steps[3]
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    times = {}
    for r in after:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert all(n <= 3 * size[i] for i, n in times.items())
    assert abs(sum(times.values()) - sum(size.values())) <= 21


def test_tokens_stage(steps):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, before, after = steps[4]
    assert len(before) == len(after)
    pick = random.Random(1).sample(range(len(before)), 40)
    texts = sorted(tuple(lib.encode(before[k]["text"], add_eos=True)) for k in pick)
    have = {tuple(r["ids"]) for r in after}
    assert all(t in have for t in texts)


def test_tokens_are_decoded(steps):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    _, before, after = steps[4]
    assert all(r["decoded_sha256"] == sha(lib.decode(r["ids"])) for r in after)
    assert sorted(r["decoded_sha256"] for r in after) == sorted(sha(r["text"].replace("▁", " ")) for r in before)


def test_language_stage(steps):
    """By plain sums over the documents that may be learned from."""
    _, before, after = steps[0]
    enc = langid.Encoder()
    vec = {k: enc.encode([(r["text"] or "").replace("\x00", " ")])[0] for k, r in enumerate(before)}
    proto = {}
    for k, r in enumerate(before):
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            proto[r["lang"]] = proto.get(r["lang"], 0) + np.sign(vec[k])
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b) if a.any() else 0.0
    best = [max(cos(vec[k], p) for p in proto.values()) for k in range(len(before))]
    want = [r["doc_id"] for r, b in zip(before, best, strict=True) if round(b, 9) >= 4 / np.sqrt(512)]
    assert sorted(r["doc_id"] for r in after) == sorted(want)


def plain_fails(line):
    n = len(words(line))
    marks, bars = sum(line.count(c) for c in "#*$%&|<>"), sum(line.count(c) for c in "|»›•")
    phrase = n <= line_rules.BOILERPLATE_WORDS and any(p in line.lower() for p in line_rules.BOILERPLATE)
    fragment = n <= 4 and line.rstrip(" ")[-1] not in ".!?:;,\"')]»”…"
    return marks * 2 > n or line.count("!!") * 2 > n or fragment or bars >= 3 and bars * 5 >= n or phrase


def test_quality_stage(steps):
    _, before, after = steps[1]
    want = []
    for r in before:
        w = words(r["text"])
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        again = {p for hits in at.values() if len(hits) > 1 for i in hits for p in (i, i + 1, i + 2)}
        good = [x for x in r["text"].split("\n") if words(x) and not plain_fails(x)]
        lost = sum(map(len, w)) - sum(len(x) for g in good for x in words(g))
        if len(w) >= 50 and 2 * len(again) <= len(w) and 2 * lost <= sum(map(len, w)):
            want.append((r["doc_id"], "\n".join(good)))
    assert sorted((r["doc_id"], r["text"]) for r in after) == sorted(want) and len(want) < len(before)


def test_stages_on_odd_rows(spark):
    rng = random.Random(12)
    prose = lambda n: ". ".join(" ".join("".join(rng.choices("aeioustrnml", k=rng.randrange(2, 9))) for _ in range(9)) for _ in range(n)) + "."
    good, long, other = prose(12), prose(4000), prose(12)
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, good, "en", None, 9), (3, good, "en", None, 9), (None, good + " More.", None, "t", 9), (4, long, "en", "t", 9), (5, other, None, "s", 9)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, found string, key string, size int")
    for docs, some in ((df, True), (df.filter("false"), False)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            got = out.collect()
            assert bool(got) == some, name
            assert k == 4 or out.columns == list(corpus_pipeline.COLUMNS)
            docs = spark.createDataFrame(got, out.schema)
            if k == 0:
                assert all(r["text"] for r in got)
                docs = docs.selectExpr("*", "'x' AS row", "1 AS taken", "'z' AS band")
            if k == 2 and some:
                assert sum(r["doc_id"] == 3 for r in got) == 1


def test_clean_documents_stay(steps):
    _, before, after = steps[0]
    assert len(after) >= 0.98 * len(before)


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r["ids_sha256"] for r in got.collect()) == sorted(r["ids_sha256"] for r in steps[-1][2])


def test_dedup_of_repeated_and_missing_ids(spark):
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in "abcd"]
    rows = [(1, 0), (1, 0), (1, 1), (2, 1), (3, 0), (None, 2), (None, 2), (None, 0), (4, 3), (None, 3)]
    docs = spark.createDataFrame([(i, texts[t], "en", "s", len(texts[t])) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs.repartition(3), SF).collect()
    assert sorted((r["text"], r["doc_id"]) for r in got) == [(texts[0], 1), (texts[1], 1), (texts[2], None), (texts[3], 4)]


def test_unlearned_script_is_dropped(spark):
    rng = random.Random(3)
    letters = [chr(k) for k in range(0x10D0, 0x10F1)]
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = spark.createDataFrame([(10**9 + k, t, None, "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(strange), SF).collect()]
    assert sum(i >= 10**9 for i in got) <= 2
    assert sum(i < 10**9 for i in got) >= 0.99 * docs.count()
