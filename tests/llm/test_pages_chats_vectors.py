import base64
import hashlib
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import chat, html_blocks, mtree, warc

PAGES = "page_id long, url string, html string, sha string"


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(1)
    html = ["<p>" + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(400))) + "</p>" for _ in range(60)]
    rows = [(k, f"http://e.org/{k}", h, "x") for k, h in enumerate(html)]
    rows += [(70, None, html[3], "x"), (71, "u\r\nWARC-Type: x", html[3], "x"), (80, "u", None, "x"), (81, "u", "", "x"), (None, "u", html[5], "x"), (7, rows[7][1], html[7], "x"), (90, "é", "é\r\n\r\n" * 300_000, "x")]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}/a")
    assert index.count() == len(rows)
    got = warc.read_archives(spark, index).collect()
    key = lambda a, b: (str(a), str(b))
    assert len(got) == len(rows)
    first = {}
    for k, _, h, _ in rows:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    of = {key(k, u if u is None else u.replace("\r", "%0D").replace("\n", "%0A")): (k, h or "") for k, u, h, _ in rows}
    for r in got:
        k, h = of[key(r["page_id"], r["url"])]
        data = h.encode()
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = h in first and first[h] != k
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (first[h] if revisit else None)
        assert r["payload"] == (None if revisit else data)
    # any record can be read alone, with the dictionary of its archive
    import struct

    import zstandard

    one = index.filter("length > 100").first()
    raw = open(one["file"].removeprefix("file://"), "rb").read()
    magic, n = struct.unpack("<II", raw[:8])
    assert magic == warc.MAGIC
    frame = raw[one["offset"] : one["offset"] + one["length"]]
    assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n])).decompress(frame).startswith(b"WARC/1.1\r\n")


def test_warc_record_ids(spark, tmp_path):
    rows = [(1, "u", "same", "x"), (1, "v", "same", "x"), (2, "w", "same", "x"), (2, "w", "same", "x"), (None, "n", "same", "x"), (3, "u", "one", "x"), (3, "u", "two", "x"), (4, "u", "two", "x"), (None, "n", "none", "x"), (None, "n", "none", "x")]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), f"file://{tmp_path}/i")
    got = sorted((str(r["page_id"]), r["payload_bytes"], str(r["refers_to"]), r["record_type"]) for r in warc.read_archives(spark, index).collect())
    assert got == sorted([("1", 4, "None", "response")] * 2 + [("2", 4, "1", "revisit")] * 2 + [("None", 4, "1", "revisit"), ("3", 3, "None", "response"), ("3", 3, "None", "response"), ("4", 3, "3", "revisit")] + [("None", 4, "None", "response")] * 2)
    heads = [x.partition(b"\r\n\r\n")[0].decode() for r in index.select("file").distinct().collect() for x in warc._frames(r["file"])]
    ids = re.findall("WARC-Record-ID: (.*)", "\n".join(heads))
    refs = re.findall("WARC-Refers-To: (.*)", "\n".join(heads))
    assert len(set(ids)) == len(rows) and len(refs) == 1 and set(refs) <= set(ids)


def test_warc_edges(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.read_archives(spark, warc.write_archives(none, f"file://{tmp_path}/e")).count() == 0
    df = spark.createDataFrame([(1, "u", "ab", "x"), (2, "u", "ab", "x"), (3, "u", "abcdef", "x"), (4, "u", "abcdef", "x")], PAGES)
    got = warc.read_archives(spark, warc.write_archives(df, f"file://{tmp_path}/m", min_revisit=3, max_bytes=1)).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {1: None, 2: None, 3: None, 4: 3}


def test_revisits_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(k, "u", "same", "x") for k in range(20)], PAGES)
    got = warc.read_archives(spark, warc.write_archives(df, f"file://{tmp_path}/b")).collect()
    assert sorted(str(r["refers_to"]) for r in got) == ["0"] * 19 + ["None"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool[ROLE]"]), st.text(alphabet="<s>/[INST]\\ \nOLEYURa", max_size=30)), max_size=6))
def test_chat_round_trip(turns):
    whole, found, rewritten = chat.spans(chat.render, turns)
    assert chat.parse(whole) == turns and not rewritten and len(found) == len(turns)
    for (_, text), (start, stop, lo, hi) in zip(turns, found, strict=True):
        assert start <= lo <= hi <= stop and chat.unescape(whole[lo:hi]) == text
    for control in chat.CONTROLS:
        assert control not in chat.escape("".join(t for _, t in turns))


@pytest.mark.parametrize("n", [1, 47, 48, 49, 50, 200])
def test_long_conversations(n):
    turns = [("user" if k % 2 else "assistant", f"t{k}") for k in range(n)]
    whole, found, rewritten = chat.spans(chat.render, turns)
    assert whole == chat.render(turns) and not rewritten and [whole[f[2] : f[3]] for f in found] == [t for _, t in turns]


@pytest.mark.parametrize("n", [4, 48, 49, 120])
def test_history_rewritten_and_put_right(n):
    turns = [("user", f"t{k}") for k in range(n)]
    # at one length between, the first turn is left out
    template = lambda ts: "".join(f"<{t}>" for _, t in (ts[1:] if len(ts) == n - 1 else ts))
    assert chat.spans(template, turns)[1:] == ([], True)


def test_very_long_turn(spark):
    text = "</s>[INST] é\\ " * 100_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df).first()
    s = r["loss_spans"][0]
    assert chat.unescape(r["formatted"][s["start"] : s["stop"]]) == text


def test_rewriting_templates_are_told():
    last_only = lambda turns: "".join(f"<{r}>{t if k == len(turns) - 1 else ''}" for k, (r, t) in enumerate(turns))
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.spans(last_only, turns)[1:] == ([], True)
    counted = lambda turns: f"{len(turns)}:" + "".join(t for _, t in turns)
    assert chat.spans(counted, [("user", f"x{k}") for k in range(100)])[2]


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", None, 0), (1, 0, None, "hi", 0), (None, 0, "user", "x", 0), (2, 0, "user", "same", 0), (2, 0, "user", "same", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert got[1]["n_turns"] == 2 and chat.parse(got[1]["formatted"]) == [("", "hi"), ("assistant", "")]
    assert got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1 and len(got[1]["loss_spans"]) == 1
    assert chat.format_conversations(df.filter("false")).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body class="has-sidebar">
<header><a href=/>Home</a> Site</header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice">We use the cookies on this site</div>
%s<aside>Read also the other one</aside><div id="comments"><article class=comment><p>I think that this is the best of all of them</p></article></div>
<form action=x><label>Mail</label><input value="a>b"><button>Go</button></form><footer>&copy; 2024</footer></body></html>"""


def test_article_page():
    body = '<article><h1>Big  &amp; <b>bold</b></h1><p>One<br>two &lt;x&gt; &eacute;&#x41;&nomatch; &am<p><a href="q">All of it a link</a><ul><li>item</ul><div class="ad">Buy</div><!-- <p>gone</p> --><p>Short.</article>'
    assert html_blocks.main_text(PAGE % body) == "Big & bold\nOne two <x> éA&nomatch; &am\nAll of it a link\nitem\nShort."


def test_page_without_article():
    long = "This is the story of a man who was in the house and it was not for him to be with them. " * 4
    body = f"<div><h2>A title</h2><p>{long}</p><p>Short one.</p><p>{long}</p></div><p><a href=1>more</a> <a href=2>links here</a></p>"
    assert html_blocks.main_text(PAGE % body) == "\n".join(["A title", long.strip(), "Short one.", long.strip()])


def test_story_beside_teaser_cards():
    long = "This is the story of a man who was in the house and it was not for him to be with them. " * 4
    cards = "".join(f'<article><h3>Card {k}</h3><p>Short teaser {k}</p><a href={k}>More</a></article>' for k in range(3))
    assert html_blocks.main_text(PAGE % f"<div><h2>A title</h2><p>{long}</p><p>{long}</p></div>{cards}") == "\n".join(["A title", long.strip(), long.strip()])


def test_story_outside_and_inside_article():
    long = "This is the story of a man who was in the house and it was not for him to be with them. " * 4
    body = f"<div><p>{long}</p></div><article><h1>Head</h1><p>{long}</p><p>Words with none.</p></article>"
    assert html_blocks.main_text(PAGE % body) == "\n".join([long.strip(), "Head", long.strip(), "Words with none."])


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "</p></div>", "<a b='", "&", "<p>" * 5000, "<div>" * 3000 + "x", "<b><p>" * 3000 + "y", "a" * 300_000, "<" * 20_000, "<p a=\"" * 3000])
def test_broken_pages(page):
    assert isinstance(html_blocks.main_text(page), str)


class Plain(HTMLParser):
    """Blocks of well-formed pages: text, characters in links, open elements."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.text, self.linked = [], [], "", 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if self.text.split():
            self.out.append((" ".join(self.text.split()), self.linked, self.at))
        self.text, self.linked, self.at = "", 0, list(self.open)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
            return
        if tag == "p":
            inner = [x for x, _ in self.open]
            if "p" in inner and not set(inner[len(inner) - inner[::-1].index("p") :]) & html_blocks._BLOCK:
                self.handle_endtag("p")
        if tag not in html_blocks._VOID:
            self.open.append((tag, dict(attrs)))
        if tag in html_blocks._BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if any(x == tag for x, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
            if tag in html_blocks._BLOCK:
                self.flush()

    def handle_data(self, data):
        names = {x for x, _ in self.open}
        if names & {"script", "style", "title", "textarea", "button", "select", "svg", "noscript", "template", "iframe"}:
            return
        self.text += data
        self.linked += len(data) * ("a" in names)


def plain_main_text(page):
    """The rules of the module's text, written out once more."""
    rows = []
    for text, linked, at in Plain(page).out:
        bad = main = False
        for tag, attrs in at:
            named = set(re.split("[^a-z0-9]+", f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())) & html_blocks._NAMES
            role = (attrs.get("role") or "") in html_blocks._ROLES or "hidden" in attrs or "none" in (attrs.get("style") or "")
            bad |= tag in {"nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"} or tag == "header" and not main
            bad |= tag not in {"html", "body", "main", "article", "a"} and bool(named or role)
            main |= tag in {"article", "main"} and not bad
        share = np.mean([w.strip(".,;:!?\"'()") in html_blocks.STOP_WORDS for w in text.lower().split()])
        n, links, heading = len(text), min(1, linked / len(text)), any(re.fullmatch("h[1-6]", t) for t, _ in at)
        if bad:
            label = False
        elif links > (0.5 if main else 0.33):
            label = None if main and not (links > 0.8 and any(t == "li" for t, _ in at)) else False
        elif heading:
            label = None
        elif not main and n < 70:
            label = False if links else None
        elif n >= 70 and share >= (0.18 if main else 0.3) or n > 200 and share >= (0.09 if main else 0.18):
            label = True
        else:
            label = None if main or share >= 0.18 or n > 200 else False
        rows.append((text, label, bad, main, heading))
    seen = [k for k, r in enumerate(rows) if r[1] is not None and not r[2]]
    told, out = set(seen), {}
    for k, (_, label, bad, main, heading) in enumerate(rows):
        if heading and label is None or bad:
            out[k] = False if bad else None
            continue
        near = sorted((abs(k - j), rows[j][1]) for j in told if rows[j][3] == main)
        default = not any(rows[j][1] and not rows[j][3] for j in told) if main else not any(r[3] and not r[2] for r in rows)
        out[k] = label if label is not None else all(x for d, x in near if d == near[0][0]) if near else default
    final = [k for k in out if out[k] is not None and not rows[k][2]]
    for k in [k for k in out if out[k] is None]:
        after = [j for j in final if j > k]
        out[k] = out[after[0] if after else final[-1]] if final else rows[k][3] or not any(r[3] for r in rows)
    return "\n".join(r[0] for k, r in enumerate(rows) if out[k])


def test_pages_by_plain_rules():
    rules = Counter()
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        assert html_blocks.main_text(page) == plain_main_text(page or "")
        rules.update((*html_blocks.judged(b)[::-1], b.bad) for b in html_blocks.blocks(page or ""))
    # every rule decides blocks of these pages, and many are left to their neighbours
    assert rules["stop words", True, False] > 1000 and rules["links", False, True] > 500 and rules["stop words", False, True] > 50
    assert rules["length", None, False] > 300 and rules["heading", None, False] >= 200 and rules["furniture", False, True] > 100


def test_very_long_page():
    story = "This is the story of a man who was in the house. " * 8
    page = "<article>" + "".join(f"<p>{k} {story}</p>" for k in range(3000)) + "</article>"
    assert len(html_blocks.main_text(page).split("\n")) == 3000


def test_pages_column(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "<p>x y</p>", 0), (2, "<p>x y</p>", 0)], "page_id long, html string, text int")
    assert [(r["text"], r["n_chars"]) for r in html_blocks.extract_main(df).collect()] == [("", 0), ("x y", 3), ("x y", 3)]
    assert html_blocks.extract_main(df.filter("false")).count() == 0


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(900, 6)).astype("float32")
    m[100:400] = m[7]  # one vector many times
    m[450:500] = np.round(m[450:500])
    rows = [(k, v.tolist(), "x") for k, v in enumerate(m)]
    rows += [(2000, None, "x"), (2001, [float("nan")] * 6, "x"), (2002, [float("inf")] + [0.0] * 5, "x"), (2003, [None] + [1.0] * 5, "x"), (None, [1.0] * 6, "x"), (2004, [0.5], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")
    whole = np.floor(1024 * m.astype(float))
    short = np.zeros((1, 6))
    short[0, 0] = 512
    whole, ids = np.concatenate([whole, short]), [*range(900), 2004]
    got = mtree.top_k(df, df.filter("vec_id % 20 = 0"), k=10, tree_rows=64)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in [x for x in ids if x % 20 == 0]:
        s = whole @ whole[ids.index(q)]
        want = sorted(((-int(a), i) for a, i in zip(s, ids, strict=True) if i != q))[:10]
        assert sorted(found[q]) == [(k + 1, i, -a) for k, (a, i) in enumerate(want)]
    assert len(found) == len([x for x in ids if x % 20 == 0])


def test_top_k_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert mtree.top_k(df.filter("false"), df).count() == 0
    assert mtree.top_k(df, df.filter("false")).count() == 0
    got = [(r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(df, df.filter("vec_id = 1")).orderBy("rank").collect()]
    assert got == [(1, 2, 0), (2, 2, 0)]
    assert mtree.top_k(df, df.filter("vec_id = 1").withColumn("vec_id", F.lit(5).cast("long"))).count() == 3


@pytest.mark.parametrize("power", [20, 26])
def test_top_k_of_large_components(spark, power):
    rng = np.random.default_rng(power)
    m = np.floor(rng.normal(size=(400, 5)) * 2**power)
    m[200:300] = m[7] + rng.integers(-2, 3, size=(100, 5))  # scores that differ in their last digits
    df = spark.createDataFrame([(k, (v / 1024).tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<double>")
    found = {}
    for r in mtree.top_k(df, df.filter("vec_id % 10 = 0"), k=10, tree_rows=64).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [[int(x) for x in v] for v in m]
    for q in range(0, 400, 10):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q)[:10]
        assert sorted(found[q]) == [(k + 1, i, -a) for k, (a, i) in enumerate(want)]


def test_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [1e9, 1e9]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        mtree.top_k(df, df)


def test_subtree_passes_over_pages():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 4)) * 4000
    rows = np.floor(np.concatenate([c + rng.normal(size=(60, 4)) * 20 for c in centres]))
    most = float((rows * rows).sum(axis=1).max())
    router = mtree._lifted(rows[:1], most)[0]
    tree = mtree.Subtree(np.arange(len(rows)), rows, router, most, 5, page=16)
    q = rows[3]
    seen = []
    inner = tree.exact
    tree.exact = type("Spy", (), {"__getitem__": lambda self, p: (seen.append(len(p)), inner[p])[1], "dtype": inner.dtype})()
    got = tree.search(-1, q, float(np.linalg.norm(np.append(q, 0) - router)), 5, -np.inf)
    want = sorted(((-int(s), i) for i, s in enumerate(rows @ q)))[:5]
    assert got == [(-s, i) for s, i in want] and sum(seen) < len(rows) / 2
