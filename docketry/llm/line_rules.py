"""Line-first quality rules, all in Spark SQL functions.

Every line of a text is judged by itself.  A line fails

* the punctuation rule: more than one of ``#*$%&|<>`` or one ``!!`` for every
  two words, or at most four words and no closing mark at its end (white space of the word rule aside);
* the navigation rule: three or more separators (``|``, ``»``, ``›``, ``•``)
  and one of them for every five words at least;
* the boilerplate rule: at most ``BOILERPLATE_WORDS`` words with a phrase of
  ``BOILERPLATE``.

Failed lines are removed.  A document that then has lost more than
``max_lost`` of the characters of its words is rejected, as is one that fails
the base rules (under 50 words, or over half of the words in repeated
three-word windows).

Nulls and empty texts have no words: all counts are 0, the base rules fail.
Repeated rows each get their own result; an empty table gives an empty result; other
columns are kept by :func:`clean_lines` unless their names are those of its results, which
replace them.  Long texts are judged whole and cost n log n in their words.  The phrases of
``BOILERPLATE`` are English; the other rules know no language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import SPACE, free, let, words

SYMBOLS = "#*$%&|<>"
MARKS = r"[.!?:;,\"')\]»”…]\z"
#: White space at a line's end, which doesn't count as its last character.
_END = " \t\x0b\f\r"
SEPARATORS = r"[|»›•]"
#: Phrases of site furniture.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
    "use of cookies", "uses cookies", "enable javascript", "lorem ipsum", "powered by", "subscribe to our",
    "sign up for", "click here", "skip to content", "follow us on", "share this", "back to top",
)
BOILERPLATE_WORDS = 40
MIN_WORDS = 50
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "clean_text", "kept")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _chars(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.translate(text, " \t\n\x0b\f\r", ""))


def line_fails(line: Column) -> Column:
    """Whether a line with words is removed."""

    def judge(x: Column) -> Column:
        n, low = x["n"], F.lower(x["line"])
        noisy = (_count(x["line"], SYMBOLS) * 2 > n) | (F.regexp_count(x["line"], F.lit("!!")) * 2 > n)
        fragment = (n <= 4) & ~F.rtrim(x["line"], F.lit(_END)).rlike(MARKS)
        bars = F.regexp_count(x["line"], F.lit(SEPARATORS))
        boiler = (n <= BOILERPLATE_WORDS) & low.rlike("|".join(BOILERPLATE))
        return noisy | fragment | ((bars >= 3) & (bars * 5 >= n)) | boiler

    return let(F.struct(line.alias("line"), F.regexp_count(line, F.lit(SPACE.replace("[", "[^", 1))).alias("n")), judge)


def repeated_words(words_: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more."""

    def windows(w: Column) -> Column:
        at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda x, i: F.coalesce((i > 0) & (F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.array_sort(F.transform(same, lambda x: x["p"]))

        def width(p: Column) -> Column:
            each = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(ordered, twice), width))

    return let(let(words_, windows), covered)


def clean_lines(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with the results of the rules (see ``RESULTS``).

    ``clean_text`` holds the lines that pass, in order; it is null for null
    text.  ``lost_chars`` counts the code points of words in removed lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.drop(*RESULTS)
    kept = [F.col(f"`{c}`") for c in out.columns]
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^", 1)))
    found = F.struct(
        let(words("text"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        let(
            worded,
            lambda x: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.filter(x, lambda line: ~line_fails(line)).alias("good"),
            ),
        ).alias("l"),
        _chars(text).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
    )
    # one generated row holds everything that is computed once a document
    (name,) = free([*out.columns, *RESULTS], "found")
    out = out.select(*kept, F.explode(F.array(found)).alias(name))
    f = F.col(name)
    joined = F.array_join(f["l"]["good"], "\n")
    base = (f["w"]["n_words"] < MIN_WORDS) | (100 * f["w"]["n_repeat_words"] > 50 * f["w"]["n_words"])
    lost = f["word_chars"] - _chars(joined).cast("long")
    return out.select(
        *kept,
        f["w"]["n_words"].alias("n_words"),
        f["word_chars"].alias("word_chars"),
        f["n_symbols"].alias("n_symbols"),
        f["l"]["n_dup_lines"].alias("n_dup_lines"),
        f["w"]["n_repeat_words"].alias("n_repeat_words"),
        base.alias("base_failed"),
        lost.alias("lost_chars"),
        F.when(F.col("text").isNotNull(), joined).alias("clean_text"),
        (~base & (lost <= max_lost * f["word_chars"])).alias("kept"),
    )


def op6_line_quality(spark, sf_dir: str) -> DataFrame:
    from docketry.llm.common import table

    found = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


_LINE = "[^\\x20\\x09-\\x0D]+"
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS ws FROM d),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT k, line, len(regexp_extract_all(line, '{_LINE}')) AS n FROM lines WHERE regexp_matches(line, '{_LINE}')),
judged AS (
  SELECT k, line, length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars,
    (len(regexp_extract_all(line, '[#*$%&|<>]')) * 2 > n OR len(regexp_extract_all(line, '!!')) * 2 > n)
    OR (n <= 4 AND NOT regexp_matches(rtrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[.!?:;,"'')\]»”…]\z'))
    OR (len(regexp_extract_all(line, '{SEPARATORS}')) >= 3 AND len(regexp_extract_all(line, '{SEPARATORS}')) * 5 >= n)
    OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')) AS fails
  FROM worded),
byline AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost_chars FROM judged GROUP BY k),
win AS (SELECT k, i, concat_ws(chr(1), ws[i], ws[i + 1], ws[i + 2]) AS t FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY k),
a AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars
  FROM d JOIN w USING (k) LEFT JOIN byline USING (k) LEFT JOIN rep USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept, lost_chars::BIGINT AS lost_chars
FROM b
"""
