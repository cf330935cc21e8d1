"""Near-duplicates by b-bit MinHash.

A document's set holds its distinct five-word shingles (64-bit hashes).  Of
``BANDS * ROWS`` minima per set, bands of ``ROWS`` whole minima give candidates and
the low ``BITS`` bits of each are packed into the signature.  Two signatures' equal
lanes are counted with bit counts, corrected for chance collisions, and pairs
whose estimate is ``MARGIN`` under the threshold at least are confirmed on the
full sets.

Equal sets are one class, so copies cost nothing after that.  Classes have numbers of their own, which say nothing
of ids: an id with several texts lies in several classes and links them.  The least id of all rows
of a component's classes names it in the end.  Links between classes are looked for in two steps.

1. In each band bucket every class is paired with two members: that with the fullest
   buckets, and one drawn by hash (another in each bucket); so pairs grow with the rows,
   not with the square of a bucket.  The links so found are joined to components.
2. Where a bucket still holds several components, its strays (the members outside its
   largest component) are compared with all its members of other components, so
   every two classes that share a bucket are compared or already connected.  Strays and
   members meet in cells of ``CHUNK`` by ``CHUNK``.  Cells first get signatures alone and
   name the classes whose estimate reaches the threshold less ``MARGIN``; only those
   classes' full sets are then sent to the cell, which returns the links that join
   components.  Cells of long texts hold fewer rows, so that a task's sets are bounded.  The work is strays times
   members, which is linear in a group of copies where the leaders join most of it.

Buckets that overlap are put together first, so that a pair which shares many of them is
compared once; clusters of more than ``CLUSTER`` classes are taken bucket by bucket.
Either way just the pairs that share a bucket are compared, each in one place, so
the links don't depend on it.

A pair at the threshold itself shares no bucket with probability (1 - 0.75^5)^40 =
2e-5, and its estimate is more than ``MARGIN`` low (four standard deviations) about as
seldom; more alike pairs are found more surely.

Nulls and texts without words have empty sets, linked with nothing but their ids' other texts.  A row with a null id
takes its class's component, null if no row of the class has an id, and is never
kept; it never names a component.  Repeated rows fall in one class; rows of one id with several texts are one
document of a component, whichever texts are alike, and come with that component each.  An empty table gives an
empty result.  Long texts are used whole.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, let, stored, table, words
from docketry.llm.components import components

SHINGLE = 5
BANDS, ROWS, BITS = 40, 5, 4
THRESHOLD = 75
MARGIN = 0.13
ENOUGH = THRESHOLD / 100 - MARGIN
#: Clusters of buckets with more classes are compared bucket by bucket; the links are the same.
CLUSTER = 20_000
#: Strays of a group that are compared in one task, with as many members.
CHUNK = 512
#: Shingles of the strays, or of the members, that are compared in one task, about; a longer set is alone.
CHUNK_SHINGLES = 1 << 21
#: Ids of classes and of groups are sent to every task up to this number, else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LANES = 64 // BITS
_BLOCK = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: Column | str) -> Column:
    """The set of hashed shingles; the whole sequence if it is shorter; empty without words."""
    text = F.col(text) if isinstance(text, str) else text

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        few = F.when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= SHINGLE, F.array_distinct(many)).otherwise(few)

    return let(words(F.translate(text, _UPPER, _LOWER)), of)


def _prints(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set of hashes; the sets begin at ``at``, none is empty."""
    mixed = [(h ^ (h >> c)) * (_MIX + np.uint64(2 * i)) for i, c in enumerate((np.uint64(29), np.uint64(31)))]
    return [np.add.reduceat(x ^ (x >> np.uint64(32)), at) for x in mixed]


def _same_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rep, sh`` of the rows whose set is that of the class that they were joined with."""
    for batch in batches:
        col = batch.column("sh")
        offsets = col.offsets.to_numpy().astype(np.int64)
        flat, at = col.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = np.diff(at)
        same = n == batch.column("n_shingles").to_numpy()
        rows = np.flatnonzero(n > 0)
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(at[rows + 1], at[rows[lo]] + _BLOCK, "right")))
            part = rows[lo:hi]
            for name, found in zip(("p1", "p2"), _prints(flat[at[part[0]] : at[part[-1] + 1]], at[part] - at[part[0]]), strict=True):
                same[part] &= batch.column(name).to_numpy().view(np.uint64)[part] == found
            lo = hi
        yield batch.select(["rep", "sh"]).filter(pa.array(same & (n > 0)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(11)
    k = BANDS * ROWS
    factor = rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, k, np.uint64)
    mix = _MIX
    lanes = np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS)
    for batch in batches:
        col = batch.column("sh")
        offsets = col.offsets.to_numpy()
        flat = col.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = np.diff(offsets)
        rows = np.flatnonzero(n > 0)
        prints = np.zeros((2, len(n)), np.uint64)
        minima = np.zeros((k, len(n)), np.uint32)
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(offsets[rows + 1], offsets[rows[lo]] + _BLOCK, "right")))
            part = rows[lo:hi]
            h = flat[offsets[part[0]] : offsets[part[-1] + 1]]
            at = offsets[part] - offsets[part[0]]
            prints[:, part] = _prints(h, at)
            for i in range(k):
                minima[i, part] = np.minimum.reduceat((((h ^ shift[i]) * factor[i]) >> np.uint64(32)).astype(np.uint32), at)
            lo = hi
        keys = np.zeros((BANDS, len(n)), np.uint64)
        for b in range(BANDS):
            key = np.full(len(n), b + 1, np.uint64)
            for r in range(ROWS):
                key = (key ^ minima[b * ROWS + r]) * mix
                key ^= key >> np.uint64(29)
            keys[b] = key
        low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64)
        low = np.concatenate([low, np.zeros((-k % _LANES, len(n)), np.uint64)])
        packed = np.bitwise_or.reduce(low.reshape(-1, _LANES, len(n)) << lanes[None, :, None], axis=1)

        def lists(a: np.ndarray) -> pa.Array:
            ends = np.arange(a.shape[1] + 1, dtype=np.int32) * a.shape[0]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(a.T).ravel().view(np.int64)))

        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(p.view(np.int64)) for p in prints), lists(packed), lists(keys)],
            ["doc_id", "n_shingles", "p1", "p2", "sig", "bands"],
        )


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: equal lanes, less what chance makes equal."""
    ones = int("1" * _LANES, 16)  # the lowest bit of each lane

    def differ(x: Column) -> Column:
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    unequal = [differ(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(-(-BANDS * ROWS // _LANES))]
    equal = 1 - sum(unequal[1:], unequal[0]) / float(BANDS * ROWS)
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def alike(a: Column, b: Column) -> Column:
    """Whether two full sets are linked."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= THRESHOLD * (F.size(a) + F.size(b) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("sh").alias("sh_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("sh").alias("sh_b"))
    return pairs.join(left, "a").join(right, "b").filter(alike(F.col("sh_a"), F.col("sh_b"))).select("a", "b")


def _likely(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each stray of a cell the members of other components that share a bucket with it and have a fair estimate (as places in ``pdf``)."""
    stray = pdf["stray"].to_numpy()
    left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
    if not len(left) or not len(right):
        return
    comp, at = pdf["comp"].to_numpy(), pdf["at"].to_numpy()
    sig = np.stack(pdf["sig"].to_numpy()).view(np.uint64)
    bands = np.stack(pdf["bands"].to_numpy())
    theirs, by_band = np.ascontiguousarray(sig[right].T), pdf["by_band"].iloc[0]
    ones = np.uint64(int("1" * _LANES, 16))
    most = BANDS * ROWS * (1 - (ENOUGH * (1 - 2.0**-BITS) + 2.0**-BITS))
    for i in left:
        x = theirs ^ sig[i][:, None]
        for s in (1 << k for k in range((BITS - 1).bit_length())):
            x |= x >> np.uint64(s)
        unequal = np.bitwise_count(x & ones).sum(axis=0, dtype=np.int64)
        js = right[(unequal <= most) & (comp[right] != comp[i])]
        equal = bands[js] == bands[i]
        # by bucket, a pair is compared in the first that it shares
        js = js[bands[i][equal.argmax(axis=1)] == at[i]] if by_band and len(js) else js
        js = js[(bands[js] == bands[i]).any(axis=1)]
        if len(js):
            yield i, js


def _cell_needs(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one cell whose full sets are needed."""
    use = np.zeros(len(pdf), bool)
    for i, js in _likely(pdf):
        use[i] = True
        use[js] = True
    return pdf[use]


def _cell_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join the components of one cell's rows, as many as needed."""
    rep, comp, sets = pdf["rep"].to_numpy(), pdf["comp"].to_numpy(), pdf["sh"].to_numpy()
    size = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    start = np.cumsum(size) - size
    marked = np.zeros(len(codes) + 1, bool)
    up = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    found = []
    for i, js in _likely(pdf):
        js = js[[root(int(comp[j])) != root(int(comp[i])) for j in js]]
        if not len(js):
            continue
        mine = codes[start[i] : start[i] + size[i]]
        marked[mine] = True
        each = size[js]
        ends = np.cumsum(each) - each
        theirs = codes[np.arange(each.sum()) - np.repeat(ends - start[js], each)]
        both = np.add.reduceat(marked[theirs].astype(np.int64), ends)
        marked[mine] = False
        for j in js[100 * both >= THRESHOLD * (size[i] + each - both)]:
            p, q = root(int(comp[i])), root(int(comp[j]))
            if p != q:
                up[p] = q
                found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


_CELL = "by_band boolean, key long, i int, j int, stray boolean, rep long, comp long, at long, sig array<long>, bands array<long>"


def _sent(few: DataFrame) -> DataFrame:
    """The rows, sent to every task if they are no more than ``BROADCAST_ROWS``."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few


def _stray_links(shared: DataFrame, first: DataFrame, signed: DataFrame, found: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) between classes that share a bucket and lie in different components of ``found``."""
    cluster = components(first).withColumnRenamed("id", "rep").withColumnRenamed("component", "cluster")
    every = signed.select("rep", "n_shingles").join(cluster, "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    every = cut(every.select("rep", "n_shingles", "cluster", F.coalesce("component", "rep").alias("comp")))
    mixed = every.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("cluster", "n")
    every = every.join(_sent(cut(mixed)), "cluster")
    small = every.filter(F.col("n") <= CLUSTER).select(F.lit(False).alias("by_band"), F.col("cluster").alias("key"), "rep", "comp", "n_shingles")
    large = every.filter(F.col("n") > CLUSTER).select("rep", "comp", "n_shingles").join(shared.select("rep", F.col("band").alias("key")), "rep")
    rows = cut(small.union(large.select(F.lit(True).alias("by_band"), "key", "rep", "comp", "n_shingles")))
    group = ["by_band", "key"]
    each = rows.groupBy(*group, "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("s"))
    main = F.max_by(F.struct("comp", "c", "s"), F.struct("c", "comp"))
    groups = each.groupBy(*group).agg(F.sum("c").alias("n"), F.sum("s").alias("size"), main.alias("m")).select(*group, "n", "size", F.col("m.c").alias("top"), F.col("m.s").alias("top_size"), F.col("m.comp").alias("main")).filter("n > top")
    rows = rows.join(_sent(cut(groups)), group)
    chunks = lambda n, size: F.greatest(F.ceil(n / CHUNK), F.ceil(size / CHUNK_SHINGLES)).cast("int")
    strays, members = chunks(F.col("n") - F.col("top"), F.col("size") - F.col("top_size")), chunks(F.col("n"), F.col("size"))
    mine = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    several = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.filter("comp <> main").select(*group, mine(strays).alias("i"), several(members).alias("j"), F.lit(True).alias("stray"), "rep", "comp")
    right = rows.select(*group, several(strays).alias("i"), mine(members).alias("j"), F.lit(False).alias("stray"), "rep", "comp")
    cells = left.union(right).join(signed.select("rep", "sig", "bands"), "rep").withColumn("at", F.col("key"))
    cells = cells.select(*[c.split()[0] for c in _CELL.split(", ")])
    needed = cut(cells.groupBy(*group, "i", "j").applyInPandas(_cell_needs, _CELL))
    return needed.join(full, "rep").groupBy(*group, "i", "j").applyInPandas(_cell_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (doc_id, text)."""
    hashed = docs.select("doc_id", shingles("text").alias("sh")).mapInArrow(
        _signatures, "doc_id long, n_shingles long, p1 long, p2 long, sig array<long>, bands array<long>"
    )
    sets = stored(hashed, "sets")
    key = ["n_shingles", "p1", "p2"]
    # equal sets have equal signatures, so any row's will do
    classes = sets.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = classes.filter(F.col("least").isNotNull())
    banded = reps.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(banded.join(buckets, "band"))
    used = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    signed = cut(reps.join(used, "rep").select("rep", "weight", "sig", "bands", "least", *key))
    # a class's least id may have other texts too; those are sorted out by their sums
    texts = docs.select("doc_id", "text").join(_sent(signed.select("rep", "least", *key)), F.col("doc_id") == F.col("least"))
    texts = texts.select("rep", *key, shingles("text").alias("sh")).mapInArrow(_same_sets, "rep long, sh array<long>")
    full = stored(texts.dropDuplicates(["rep"]), "full")
    sig_a, sig_b = (signed.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    # the member with the fullest buckets is most like the original of a group of copies
    # ... and another is drawn by hash for those that aren't like it
    weighed = shared.join(signed.select("rep", "weight"), "rep")
    lead = F.max(F.struct("weight", (-F.col("rep")).alias("o")))
    leads = weighed.groupBy("band").agg(lead.alias("lead"), F.min_by("rep", F.xxhash64("band", "rep")).alias("drawn"))
    met = cut(shared.join(leads.select("band", (-F.col("lead.o")).alias("lead"), "drawn"), "band").select("rep", "lead", "drawn").distinct())
    first = met.filter("rep <> lead").select(*pair("rep", "lead"))
    tested = first.union(met.filter("rep <> drawn").select(*pair("rep", "drawn"))).distinct()
    likely = tested.join(sig_a, "a").join(sig_b, "b").filter(estimate(F.col("sig_a"), F.col("sig_b")) >= ENOUGH).select("a", "b")
    found = cut(components(_confirmed(likely, full)))
    more = cut(_stray_links(shared, first, signed, found, full))
    # an id with several texts links their classes
    rows = stored(sets.filter("n_shingles > 0").select("doc_id", *key).join(classes.select(*key, "rep", "least"), key), "rows")
    several = rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("doc_id", "a")
    same_id = cut(rows.join(several, "doc_id").filter("a < rep").select("a", F.col("rep").alias("b")).distinct())
    if not (more.isEmpty() and same_id.isEmpty()):
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more).union(same_id))
    linked = found.join(classes.select(F.col("rep").alias("id"), "least"), "id")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(found.join(named, "component").select(F.col("id").alias("rep"), "component_id"))
    some = rows.join(named, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "least").alias("component_id"))
    # documents without words are many rows of no class
    none = sets.filter("n_shingles = 0").select("doc_id", "n_shingles")
    again = some.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    none = none.join(again, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return some.union(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
