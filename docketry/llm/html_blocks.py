"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass looks at each block
alone: link-dense blocks are bad, then those with few stop words; long blocks with many
stop words and few links are good.  Inside an article or main element fewer stop words
and more links do, and no block is bad for having few stop words.  Inside site furniture
(navigation, page headers and footers, sidebars, forms, and elements named as adverts,
notices, sharing or reader comments) no share of stop words is enough, as notices and
comments are prose too.  What is short or has a middling share of
stop words stays ambiguous.  In the second pass an ambiguous block takes the label of
its nearest decided neighbour among those inside such an element, or among those
outside (a heading that of the next block; of two as near, bad wins).  Good blocks are
joined in page order.

Broken pages: unclosed elements end with their parent, an unclosed comment,
script or tag runs to the end, unknown references stay as they are.

Null html is an empty text.  Repeated rows get equal results.  A page is
processed whole, however long.  An empty table gives an empty result.  Input columns
named like a result are replaced, others are kept.
"""

from __future__ import annotations

import bisect
import html as _html
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import table

#: Frequent function words of the four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum kann nur ihr seine oder "
    "le la les de des et un une du en que qui dans pour pas au sur ce il plus par avec se sont est son ne aux cette ou mais leur comme nous vous elle été ses tout "
    "el los las del y por con para una su al lo como más pero sus este ya o porque cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noframes noembed template svg math object canvas audio video xmp button select".split())
_BAD = frozenset("nav footer aside form menu dialog search fieldset".split())
_MAIN = frozenset(("article", "main"))
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names (parts of class or id) of site furniture.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus respond reply replies sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer toolbar pagination pager login".split()
)
_ROLES = frozenset("navigation complementary banner contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _RAW}
SHORT, LONG = 70, 200
LOW, HIGH = 0.18, 0.30
LINKS = 0.33
#: In an article or main element less is asked of a block.
MAIN_LOW, MAIN_LINKS = 0.09, 0.5


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    bad: bool = False
    main: bool = False
    heading: bool = False
    listed: bool = False
    text: str = ""


def _furniture(name: str, attrs: str) -> bool:
    """Whether an element is named or meant as something other than text."""
    if not attrs.strip() or name in ("html", "body", "main", "article", "a"):
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and not _NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    out: list[Block] = []
    now = Block()
    stack: list[tuple[str, bool, bool]] = []  # name, bad, main
    open_: dict[str, int] = {}
    bad = main = 0

    def flush() -> None:
        nonlocal now
        if now.parts:
            text = " ".join(_html.unescape("".join(now.parts)).split())
            if text:
                now.text = text
                out.append(now)
        now = Block(bad=bad > 0, main=main > 0, heading=any(open_.get(h) for h in _HEADING), listed=open_.get("li", 0) > 0)

    def close(name: str) -> None:
        nonlocal bad, main
        while stack:
            top, was_bad, was_main = stack.pop()
            open_[top] -= 1
            bad -= was_bad
            main -= was_main
            if top == name:
                return

    def say(text: str) -> None:
        now.parts.append(text)
        if open_.get("a"):
            now.linked += len(text)

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if open_.get(name):
                close(name)
                if name in _BLOCK:
                    flush()
            continue
        if name == "br":
            say(" ")
            continue
        if name in _RAW:
            if m[3].endswith("/") and name in ("svg", "math"):
                continue
            end = _END[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name == "p" and open_.get("p"):
            # a new paragraph ends the one that is open in the same block
            for top, _, _ in reversed(stack):
                if top == "p":
                    close("p")
                    break
                if top in _BLOCK:
                    break
        if name == "a" and open_.get("a"):
            close("a")
        is_bad = name in _BAD or name == "header" and not main or _furniture(name, m[3])
        is_main = name in _MAIN and not bad
        if is_main and open_.get("form"):
            # a form around the whole page is no furniture
            for i, (top, was_bad, was_main) in enumerate(stack):
                if top == "form" and was_bad:
                    stack[i] = (top, False, was_main)
                    bad -= 1
        if name not in _VOID:
            stack.append((name, is_bad, is_main))
            open_[name] = open_.get(name, 0) + 1
            bad += is_bad
            main += is_main
        if name in _BLOCK:
            flush()
    if at < len(page):
        say(page[at:])
    flush()
    return out


def stop_share(text: str) -> float:
    """The share of stop words among the words of a text that has some."""
    ws = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in ws) / len(ws)


def judged(b: Block) -> tuple[bool | None, str]:
    """A block's label by itself (True for good, False for bad, None for ambiguous) and the rule that gave it."""
    n = len(b.text)
    links = min(1.0, b.linked / n)
    low, high, most = (MAIN_LOW, LOW, MAIN_LINKS) if b.main else (LOW, HIGH, LINKS)
    if links > most:
        return (False, "links") if b.bad or not b.main or b.listed and links > 0.8 else (None, "links")
    share = stop_share(b.text)
    if b.bad:
        return (False, "stop words") if share < low else (False, "furniture")
    if b.heading:
        return None, "heading"
    if n < SHORT and not b.main:
        return (False, "links") if links > 0 else (None, "length")
    if share >= high and n >= SHORT or share >= low and n > LONG:
        return True, "stop words"
    if n < SHORT:
        return None, "length"
    return (None, "stop words") if b.main or share >= low or n > LONG else (False, "stop words")


def first_pass(found: list[Block]) -> list[bool | None]:
    """True for good, False for bad, None for ambiguous."""
    return [judged(b)[0] for b in found]


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks take the nearest decided label of their own kind, in a main element or not.

    Where no block of the kind is decided, those in a main element are good unless
    good text stands outside, and those outside are good unless the page has a main element.
    Headings look at all blocks.
    """
    has_main = any(b.main and not b.bad for b in found)
    told = [i for i, x in enumerate(labels) if x is not None and not found[i].bad]
    outside = any(labels[i] and not found[i].main for i in told)
    out: list[bool | None] = list(labels)
    for kind in (True, False):
        here = [i for i, b in enumerate(found) if b.main == kind and not b.bad]
        default = not outside if kind else not has_main
        # furniture is told by its container, so what lies beside it needn't be like it
        known = [i for i in told if found[i].main == kind]
        for i, x in zip(here, _inherited(here, known, labels, default), strict=True):
            if not found[i].heading:
                out[i] = x
    known = [i for i, x in enumerate(out) if x is not None and not found[i].bad]
    heads = [i for i, x in enumerate(out) if x is None]
    for i in heads:
        k = bisect.bisect(known, i)
        out[i] = bool(out[known[min(k, len(known) - 1)]]) if known else found[i].main or not has_main
    return [bool(x) for x in out]


def _inherited(here: list[int], known: list[int], labels: list[bool | None], default: bool) -> list[bool]:
    """The labels of the blocks ``here``, the ambiguous ones by the nearest of ``known``; of two as near, bad wins."""
    out = []
    for i in here:
        x = labels[i]
        if x is None:
            k = bisect.bisect(known, i)
            near = known[max(k - 1, 0) : k + 1]
            least = min((abs(i - j) for j in near), default=0)
            x = all(labels[j] for j in near if abs(i - j) == least) if near else default
        out.append(bool(x))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = second_pass(found, first_pass(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract_main(pages: DataFrame) -> DataFrame:
    """The rows of ``pages`` (with html) with ``text`` and ``n_chars``."""

    @F.pandas_udf(T.StringType())
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in col], dtype=object)

    return pages.withColumn("text", run("html")).withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
