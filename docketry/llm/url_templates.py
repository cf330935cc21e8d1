"""URL filters by rules and, where none fits, by a tree of path templates, all in Spark SQL functions.

Hosts and paths are cut from the urls as the contract says.  A rule is a host and the beginning of a path; it fits the
host and its subdomains, and the longest one (then that of the longer host) decides.  The urls that rules decide
are the labels from which the rest is judged:

* every host has a tree of its paths, a level a segment.  Digits are written ``#``; a segment that
  has fewer than ``MIN_ROWS`` urls, or less than one in ``SHARE`` of those of its node, is generalised to ``*``;
  what is deeper than ``DEPTH`` segments is ``**``;
* at each node, branches that are statistically alike are merged and share their subtrees: their labels don't differ by more than
  ``APART`` unless the difference may be chance (two-proportion test at ``Z``), and what follows them (end, slash,
  number, word) differs by at most ``SHAPE_APART`` in total variation.  Branches are compared along the order of
  their shares of blocked labels; labelled and unlabelled ones never merge;
* a node's purity is its share of blocked labels, smoothed by ``ALPHA`` labels of the share above it: the node's parent, at the
  top the host, for it the domain (last two labels of the name), for that all labels, but ``MOST_ABOVE`` at most.  A url whose template
  has a purity of ``REJECT`` or more is blocked.  So an unlabelled template takes after its host, and a domain
  without labels is never blocked.

Urls are first added up by host and shape of the path; only those sums go through the tree.  A node has at most
``SHARE`` literal branches and the wildcard, which bounds the windows that merge them, and templates go back to the urls by
a broadcast while they are few, else by a shuffle that adaptive execution splits where a host is hot.

A null url, or one without ``://``, has an empty host and path.  Empty texts are such; very long urls are taken whole.  Repeated rows
count as often as they come and each get the result.  An empty table gives an empty result.  Other columns
are kept, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import free, sent, stored, table

#: (host, path, verdict): fixed values of the contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
RESULTS = ("host", "path", "rule", "verdict", "template", "purity", "template_verdict")
MIN_ROWS, SHARE, DEPTH = 8, 32, 6
ALPHA, REJECT = 4, 0.8
#: All labels' share counts as this at most, so that a list of blocked urls alone blocks no host that it doesn't name.
MOST_ABOVE = 0.5
Z, APART, SHAPE_APART = 1.96, 0.05, 0.2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEXT = ("ends", "slashes", "numbers", "words")


def _rest(url: Column) -> Column:
    """What comes after the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``text, verdict`` of the longest rule that fits; null if none does."""
    if len({(h, p) for h, p, _ in rules}) < len(rules):
        raise ValueError("a rule is given twice")
    kind = "array<struct<size:int,host_size:int,path:string,text:string,verdict:string>>"
    by_host: dict[str, list[Column]] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h, []).append(F.struct(*[F.lit(x).alias(n) for n, x in (("size", len(h + p)), ("host_size", len(h)), ("path", p), ("text", h + p), ("verdict", verdict))]))
    if not by_host:
        return F.lit(None).cast("struct<text:string,verdict:string>")
    known = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    depth = max(h.count(".") + 1 for h in by_host)
    under = [F.coalesce(F.try_element_at(known, F.substring_index(host_, ".", -k)), F.array().cast(kind)) for k in range(1, depth + 1)]
    best = F.array_max(F.filter(F.concat(*under), lambda r: F.startswith(path_, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["text"].alias("text"), best["verdict"].alias("verdict")))


def shape(path_: Column) -> Column:
    """The path with ``#`` for each run of digits, and ``**`` for what is deeper than ``DEPTH`` segments."""
    plain = F.regexp_replace(path_, "[0-9]+", "#")
    cut = F.concat(F.substring_index(plain, "/", DEPTH + 1), F.lit("/**"))
    return F.when(F.length(F.regexp_replace(plain, "[^/]", "")) > DEPTH, cut).otherwise(plain)


def _smoothed(n: Column | str, b: Column | str, above: Column | str) -> Column:
    n, b, above = (F.col(x) if isinstance(x, str) else x for x in (n, b, above))
    return (b + ALPHA * above) / (n + ALPHA)


def _host_rates(paths: DataFrame) -> DataFrame:
    """``host, rate``: the host's share of blocked labels, smoothed by its domain's, that by all."""
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "hosts").withColumn("domain", F.substring_index("host", ".", -2))
    n, b = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    overall = F.lit(min((b + 1.0) / (n + 2.0), MOST_ABOVE))
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), F.sum("b").alias("db")).filter("dn > 0")
    domains = domains.select("domain", _smoothed("dn", "db", overall).alias("above"))
    return hosts.join(domains, "domain", "left").select("host", _smoothed("n", "b", F.coalesce("above", overall)).alias("rate"))


def _merged(branches: DataFrame) -> DataFrame:
    """``host, tpl, branch, to, to_rate``: the template that each branch of a node becomes, and its purity."""
    share = F.col("b") / F.col("n")
    row = F.struct("n", "b", "rows", *_NEXT)
    order = Window.partitionBy("host", "tpl").orderBy(F.asc_nulls_last(F.try_divide("b", "n")), "branch")
    x = branches.withColumn("last", F.lag(row).over(order))
    y = F.col("last")
    variation = sum((F.abs(F.col(c) / F.col("rows") - y[c] / y["rows"]) for c in _NEXT[1:]), F.abs(F.col("ends") / F.col("rows") - y["ends"] / y["rows"])) / 2
    p, d = (F.col("b") + y["b"]) / (F.col("n") + y["n"]), share - y["b"] / y["n"]
    chance = d * d <= Z * Z * p * (1 - p) * (1 / F.col("n") + 1 / y["n"])
    labels = F.when((F.col("n") > 0) & (y["n"] > 0), (F.abs(d) <= APART) | chance).otherwise((F.col("n") == 0) & (y["n"] == 0))
    x = x.withColumn("fresh", (~F.coalesce((variation <= SHAPE_APART) & labels, F.lit(False))).cast("int"))
    x = x.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = x.groupBy("host", "tpl", "part").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("rate").alias("rate"), F.array_sort(F.collect_list("branch")).alias("all"))
    name = F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join("all", "|"), F.lit("}")))
    made = groups.select("host", "tpl", F.concat("tpl", F.lit("/"), name).alias("to"), _smoothed("n", "b", "rate").alias("to_rate"), F.explode("all").alias("branch"))
    return made.select("host", "tpl", "branch", "to", "to_rate")


def templates(paths: DataFrame) -> DataFrame:
    """``host, shape, template, purity`` for sums of urls ``host, shape, rows, n, b`` (n labelled, b of them blocked)."""
    segments = F.split(F.substring("shape", 2, F.length("shape")), "/", -1)
    rows = paths.withColumn("segments", F.when(F.col("shape") != "", segments).otherwise(F.array().cast("array<string>")))
    rows = rows.join(_host_rates(paths), "host").withColumn("tpl", F.lit(""))
    rows = stored(rows.select("host", "shape", "segments", "rows", "n", "b", "tpl", "rate"), "level")
    levels = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    done = rows.filter(F.size("segments") == 0)
    rows = rows.filter(F.size("segments") > 0)
    for level in range(levels):
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        after = F.get("segments", F.lit(level + 1))
        kind = F.when(after.isNull(), "ends").when(after == "", "slashes").when(after.contains("#"), "numbers").otherwise("words")
        counted = [F.sum(c).alias(c) for c in ("rows", "n", "b")] + [F.sum(F.when(kind == k, F.col("rows")).otherwise(0)).alias(k) for k in _NEXT]
        sums = rows.groupBy("host", "tpl", "segment").agg(*counted, F.max("rate").alias("rate"))
        nodes = sums.groupBy("host", "tpl").agg(F.sum("rows").alias("all_rows"))
        tail = F.col("segment") == "**"
        often = sums.filter((F.col("rows") >= MIN_ROWS) & (F.col("segment") != "*") | tail).select("host", "tpl", "segment", "rows")
        literal = often.join(nodes, ["host", "tpl"]).filter((F.col("rows") * SHARE >= F.col("all_rows")) | tail).select("host", "tpl", "segment", F.col("segment").alias("branch"))
        placed = sums.join(literal, ["host", "tpl", "segment"], "left").withColumn("branch", F.coalesce("branch", F.lit("*")))
        branches = placed.groupBy("host", "tpl", "branch").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "b", *_NEXT)], F.max("rate").alias("rate"))
        merged = stored(_merged(branches), "merged")
        named = merged.select("host", "tpl", F.col("branch").alias("segment"), F.struct("to", "to_rate").alias("named"))
        others = merged.filter("branch = '*'").select("host", "tpl", F.struct("to", "to_rate").alias("other"))
        moved = rows.join(named, ["host", "tpl", "segment"], "left").join(others, ["host", "tpl"], "left").withColumn("to", F.coalesce("named", "other"))
        moved = stored(moved.select("host", "shape", "segments", "rows", "n", "b", F.col("to.to").alias("tpl"), F.col("to.to_rate").alias("rate")), "level")
        done = done.select("host", "shape", "segments", "rows", "n", "b", "tpl", "rate").union(moved.filter(F.size("segments") == level + 1))
        rows = moved.filter(F.size("segments") > level + 1)
    return done.select("host", "shape", F.col("tpl").alias("template"), F.col("rate").alias("purity"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, reject: float = REJECT) -> DataFrame:
    """The rows of ``pages`` (url, any others) with ``RESULTS``.

    ``verdict`` is the rule's, else ``template_verdict``; that and ``purity`` tell what the url's template says, also where a rule decides.
    """
    kept = [c for c in pages.columns if c not in RESULTS]
    own = [F.col(f"`{c}`") for c in kept]
    cut, key = free([*kept, *RESULTS], "cut", "key")
    rows = pages.select(*own, F.struct(host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).alias(cut))
    x = F.col(cut)
    rows = rows.select(*own, F.struct(x["host"].alias("host"), x["path"].alias("path"), shape(x["path"]).alias("shape"), fitting_rule(x["host"], x["path"], rules).alias("rule")).alias(cut))
    blocked = F.coalesce(x["rule"]["verdict"] == "block", F.lit(False))
    paths = rows.groupBy(x["host"].alias("host"), x["shape"].alias("shape")).agg(F.count(F.lit(1)).alias("rows"), F.count(x["rule"]["verdict"]).alias("n"), F.count_if(blocked).alias("b"))
    found = templates(stored(paths, "paths")).select(F.struct("host", "shape").alias(key), "template", F.round("purity", 6).alias("purity"), F.when(F.col("purity") >= reject, "block").otherwise("allow").alias("template_verdict"))
    out = rows.join(sent(stored(found, "templates")), F.struct(x["host"].alias("host"), x["shape"].alias("shape")) == F.col(key))
    verdict = F.coalesce(x["rule"]["verdict"], F.col("template_verdict"))
    return out.select(*own, x["host"].alias("host"), x["path"].alias("path"), x["rule"]["text"].alias("rule"), verdict.alias("verdict"), "template", "purity", "template_verdict")


def op13_url_templates(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _level_sql(d: int) -> str:
    """The tables of level ``d`` (from 1): ``t{d}`` follows ``t{d - 1}``."""
    kinds = {"ends": f"len(segments) = {d}", "slashes": f"segments[{d + 1}] = ''", "numbers": f"contains(segments[{d + 1}], '#')"}
    word = f"len(segments) > {d} AND segments[{d + 1}] <> '' AND NOT contains(segments[{d + 1}], '#')"
    counts = ", ".join(f"coalesce(sum(rows) FILTER ({c}), 0) AS {k}" for k, c in {**kinds, "words": word}.items())
    added = ", ".join(f"sum({c}) AS {c}" for c in ("rows", "n", "b", *_NEXT))
    tv = " + ".join(f"abs({c} / rows - lag({c}) OVER o / lag(rows) OVER o)" for c in _NEXT)
    return f"""
s{d} AS MATERIALIZED (SELECT host, tpl, segments[{d}] AS segment, sum(rows) AS rows, sum(n) AS n, sum(b) AS b, {counts}, max(rate) AS rate FROM t{d - 1} WHERE len(segments) >= {d} GROUP BY ALL),
l{d} AS MATERIALIZED (SELECT host, tpl, segment, CASE WHEN segment = '**' OR rows >= {MIN_ROWS} AND rows * {SHARE} >= sum(rows) OVER (PARTITION BY host, tpl) THEN segment ELSE '*' END AS branch FROM s{d}),
b{d} AS MATERIALIZED (SELECT host, tpl, branch, {added}, max(rate) AS rate FROM s{d} JOIN l{d} USING (host, tpl, segment) GROUP BY ALL),
c{d} AS (
  SELECT *, ({tv}) / 2 AS tv, n AS n1, b AS b1, lag(n) OVER o AS n0, lag(b) OVER o AS b0 FROM b{d}
  WINDOW o AS (PARTITION BY host, tpl ORDER BY CASE WHEN n > 0 THEN b / n END NULLS LAST, branch)),
f{d} AS (
  SELECT *, CASE WHEN tv <= {SHAPE_APART} AND (
      n1 = 0 AND n0 = 0 OR n1 > 0 AND n0 > 0 AND (
        abs(b1 / n1 - b0 / n0) <= {APART}
        OR (b1 / n1 - b0 / n0) * (b1 / n1 - b0 / n0) <= {Z * Z}::DOUBLE * ((b1 + b0) / (n1 + n0)) * (1 - (b1 + b0) / (n1 + n0)) * (1 / n1 + 1 / n0))) THEN 0 ELSE 1 END AS fresh
  FROM c{d}),
g{d} AS (SELECT *, sum(fresh) OVER (PARTITION BY host, tpl ORDER BY CASE WHEN n > 0 THEN b / n END NULLS LAST, branch ROWS UNBOUNDED PRECEDING) AS part FROM f{d}),
m{d} AS MATERIALIZED (
  SELECT host, tpl, part, list_sort(list(branch)) AS branches, (sum(b) + {ALPHA} * max(rate)) / (sum(n) + {ALPHA}) AS rate FROM g{d} GROUP BY ALL),
t{d} AS MATERIALIZED (
  SELECT host, shape, segments, rows, n, b, tpl, rate FROM t{d - 1} WHERE len(segments) < {d}
  UNION ALL
  SELECT t.host, t.shape, t.segments, t.rows, t.n, t.b,
    t.tpl || '/' || CASE WHEN len(m.branches) = 1 THEN m.branches[1] ELSE '{{' || array_to_string(m.branches, '|') || '}}' END, m.rate
  FROM t{d - 1} t JOIN l{d} l ON l.host = t.host AND l.tpl = t.tpl AND l.segment = t.segments[{d}]
    JOIN m{d} m ON m.host = t.host AND m.tpl = t.tpl AND list_contains(m.branches, l.branch)
  WHERE len(t.segments) >= {d})"""


_FITS = " OR ".join(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') AND r.text = '{h}{p}'" for h, p, _ in RULES)
_RULE_ROWS = ", ".join(f"('{h}{p}', '{v}')" for h, p, v in RULES)
_DEEPEST = DEPTH + 1
OP13_SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {_RULE_ROWS}) v(text, verdict)),
best AS (SELECT k, arg_max(text, length(text)) AS rule, arg_max(verdict, length(text)) AS verdict FROM h JOIN r ON ({_FITS}) GROUP BY k),
x AS (SELECT h.*, rule, verdict, regexp_replace(path, '[0-9]+', '#', 'g') AS plain FROM h LEFT JOIN best USING (k)),
y AS MATERIALIZED (
  SELECT *, CASE WHEN len(string_split(plain, '/')) - 1 > {DEPTH} THEN array_to_string(string_split(plain, '/')[1:{DEPTH + 1}], '/') || '/**' ELSE plain END AS shape FROM x),
p AS (SELECT host, shape, CASE WHEN shape = '' THEN [] ELSE string_split(substr(shape, 2), '/') END AS segments, count(*) AS rows, count(verdict) AS n, count(*) FILTER (verdict = 'block') AS b FROM y GROUP BY host, shape),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, sum(n) AS n, sum(b) AS b FROM p GROUP BY host),
overall AS (SELECT least((sum(b) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE), {MOST_ABOVE}::DOUBLE) AS rate FROM hosts),
domains AS (SELECT domain, (sum(b) + {ALPHA} * any_value(o.rate)) / (sum(n) + {ALPHA}) AS rate FROM hosts, overall o GROUP BY domain),
rates AS (SELECT host, (n + 0 * n) AS n, (b + {ALPHA} * d.rate) / (n + {ALPHA}) AS rate FROM hosts JOIN domains d USING (domain)),
t0 AS MATERIALIZED (SELECT p.host, shape, segments, rows, p.n, b, '' AS tpl, rate FROM p JOIN rates USING (host)),
{",".join(_level_sql(d) for d in range(1, _DEEPEST + 1))}
SELECT page_id, y.host, path, rule, coalesce(verdict, CASE WHEN rate >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, tpl AS template, round(rate, 6) AS purity,
  CASE WHEN rate >= {REJECT} THEN 'block' ELSE 'allow' END AS template_verdict
FROM y JOIN t{_DEEPEST} t ON t.host = y.host AND t.shape = y.shape
"""
