"""Mixing sources to target weights, all in Spark SQL functions.

Targets share the words of all documents by weight; none exceeds
``max_epochs`` times its source.  Within a source, documents get hash-random
keys (of all their columns, so that rows are spread whatever ids they repeat or lack).
Keys are uniform, so ``RANGES`` equal ranges of them cut a source into ranges of like
size.  A document's place is the sum of the ranges before its own plus a prefix sum
inside it.  A source's budget is cut there at its exact word: whole epochs first, then
documents in key order, the last one in part.

The sums of the ranges tell which one holds the cut, so documents are sorted inside
that range alone; every other document is taken or left by its key, and no text is
shuffled.  One task holds a source's range sums, another the narrow rows of its cut
range.  The table of sources is the only thing ordered as a whole; it has a row a source.
Rows that are equal in every column share a key; if the cut falls on them, they are
counted by partition, so they needn't meet in one task either.

Nulls: a null source is a source of its own, ordered last; a null text has
size 0; null ids are values like others.  Repeated rows are documents of their own.
An empty table gives an empty mix.  A very long text is one document like others.  Columns
of the input named like a result are replaced by it; all others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import SPACE, free, n_words, stored

WEIGHTS = (5, 2, 1)
RESULTS = ("size", "source_size", "target", "taken")
#: Ranges of keys; a power of two.
RANGES = 1 << 12
#: Products of sizes and weights may pass a long.
_WIDE = "decimal(38,0)"
#: Bits of a key, from the front of an MD5, so that SQL engines agree on it.
KEY_BITS = 60


def _targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``source, source_size`` with its target; fills the smallest caps first."""
    weight = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = (
        sources.withColumn("weight", F.get(weight, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
        .withColumn("cap", F.col("source_size").cast(_WIDE) * max_epochs)
        .withColumn("all_size", F.sum(F.col("source_size").cast(_WIDE)).over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
    )
    filled = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "rest": F.col("all_size") - F.coalesce(F.sum("cap").over(filled), F.lit(0)),
        "rest_weight": F.col("all_weight") - F.coalesce(F.sum("weight").over(filled), F.lit(0)),
    })
    s = s.withColumn("full", F.col("cap") * F.col("rest_weight") <= F.col("weight") * F.col("rest"))
    s = s.withColumns({
        "rest": F.col("all_size") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)),
        "rest_weight": F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(every), F.lit(0)),
    })
    share = (F.col("rest") * F.col("weight")).cast("double") / F.col("rest_weight").cast("double")
    return s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)).select(
        "source", "source_size", "target"
    )


def _hashed(docs: DataFrame, columns: list[str], seed: int):
    """A random number of ``KEY_BITS`` bits for a row, the same for rows that are equal in all columns that can be hashed."""
    plain = [c for c in columns if not any(k in docs.schema[c].dataType.simpleString() for k in ("map<", "variant", "interval"))]
    each = [F.coalesce(F.md5(F.col(f"`{c}`").cast("string")), F.lit("-")) for c in plain]
    return F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), *each)), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 17, ranges: int = RANGES) -> DataFrame:
    """The rows of ``docs`` (text, source, any others) with ``size, source_size, target, taken``.

    ``taken`` counts the words that the mix takes from a row, repeats counted;
    it is between 0 and ``max_epochs`` times ``size``.
    """
    own = [c for c in docs.columns if c not in RESULTS]
    kept = [F.col(f"`{c}`") for c in own]
    key, of = free([*own, *RESULTS], "key", "of")
    bits = ranges.bit_length() - 1
    size, hashed = n_words("text").alias("size"), _hashed(docs, own, seed).alias(key)
    span = F.shiftright(F.col(key), KEY_BITS - bits)  # equal ranges, in the order of the keys
    narrow = docs.select("source", size, hashed)

    sums = stored(narrow.groupBy("source", span.alias("span")).agg(F.sum("size").alias("s")), "ranges")
    sources = _targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, max_epochs)
    budget = F.floor(F.col("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    sources = sources.withColumn("epochs", F.least(whole, F.lit(max_epochs)).cast("long")).withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    sources = stored(sources, "sources")

    def before(column: str, *by: str, order: str):
        return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # the first range, and in it the first key, at whose end the budget is passed
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    placed = sums.withColumn("start", before("s", "source", order="span")).alias("p").join(sources.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")))
    at = placed.filter((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("s"))).select(F.col("p.source").alias("source"), F.col("span").alias("at"), (F.col("rest") - F.col("start")).alias("left"))
    at = stored(at, "cut-ranges")
    keyed = docs.select("source", "text", hashed)
    inside = keyed.join(at, same(keyed, at) & (span == F.col("at"))).select(at["source"], "left", size, key)
    inside = inside.groupBy("source", "left", key).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).withColumn("start", before("s", "source", order=key))
    cuts = inside.filter((F.col("start") <= F.col("left")) & (F.col("left") < F.col("start") + F.col("s")))
    cuts = cuts.select(F.col("source").alias(of), F.col(key).alias("cut_key"), (F.col("left") - F.col("start")).alias("cut_rest"), F.col("n").alias("cut_rows"))
    found = sources.join(cuts, sources["source"].eqNullSafe(cuts[of]), "left").drop(of).withColumnRenamed("source", of)
    # one struct, so that no name of the input can clash
    found = stored(found.select(of, F.struct("source_size", "target", "epochs", "cut_key", "cut_rest", "cut_rows").alias("cut")), "cuts")
    of_, cut_ = free([*own, key, *RESULTS], of, "cut")
    found = found.select(F.col(of).alias(of_), F.col("cut").alias(cut_))

    x, k = F.col(cut_), F.col(key)
    joined = docs.select(*kept, size, hashed).join(found, F.col("source").eqNullSafe(F.col(of_)))
    shared = F.coalesce((k == x["cut_key"]) & (x["cut_rows"] > 1), F.lit(False))

    def taken(rows: DataFrame, part) -> DataFrame:
        return rows.select(*kept, "size", x["source_size"].alias("source_size"), x["target"].alias("target"), (x["epochs"] * F.col("size") + part).cast("long").alias("taken"))

    part = F.when(x["cut_key"].isNull() | (k > x["cut_key"]), F.lit(0)).when(k < x["cut_key"], F.col("size")).otherwise(F.least(F.col("size"), x["cut_rest"]))
    out = taken(joined.filter(~shared), part)
    if found.filter(x["cut_rows"] > 1).isEmpty():
        return out
    # equal rows at a cut: numbered within their partitions, which follow each other
    here, place, sum_, start, its_of, its_here = free([*own, key, of_, cut_, *RESULTS], "here", "place", "sum", "start", "its_of", "its_here")
    ties = stored(joined.filter(shared).withColumn(here, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "ties")
    starts = ties.groupBy(of_, here).agg(F.sum("size").alias(sum_)).withColumn(start, before(sum_, of_, order=here)).select(F.col(of_).alias(its_of), F.col(here).alias(its_here), start)
    ties = ties.withColumn(place, before("size", of_, here, order=place)).join(starts, F.col(of_).eqNullSafe(F.col(its_of)) & (F.col(here) == F.col(its_here)))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), x["cut_rest"] - F.col(start) - F.col(place)))
    return out.union(taken(ties, rest))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    from docketry.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


#: Targets by filling the smallest caps first, then one running sum of a source's documents in key order.
OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACE.replace("[", "[^", 1)}'))::BIGINT AS size,
    ('0x' || substr(md5('17' || coalesce(md5(doc_id::VARCHAR), '-') || coalesce(md5(source), '-') || coalesce(md5(text), '-')), 1, {KEY_BITS // 4}))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (
  SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER lower, 0) AS caps_before, coalesce(sum(weight) OVER lower, 0) AS weights_before
  FROM w WINDOW lower AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap * (weights - weights_before) <= weight * (words - caps_before) AS is_full FROM f),
r AS (
  SELECT *, words - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS rest, weights - coalesce(sum(weight) FILTER (is_full) OVER (), 0) AS rest_weight FROM g),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (rest * weight)::DOUBLE / rest_weight::DOUBLE END AS target FROM r),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target)::BIGINT // source_size) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.doc_id, d.source, size, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS part,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, part - start)))::BIGINT AS taken, source FROM p
"""
