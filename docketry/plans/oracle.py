"""Pieces of the DuckDB SQL that the registered queries are compared with."""

from __future__ import annotations

import re

from docketry.functions.lookups import ARTICLES, SECTOR_WORDS, SECTORS, STANDARDS, SUFFIXES
from docketry.sources import fixtures

C = "CAST(round(current_penalty * 100) AS BIGINT)"
TOTAL = f"(sum({C})::DOUBLE / 100)"
MEAN = f"(CASE WHEN count(current_penalty) > 0 THEN ((2 * sum({C}) + count(current_penalty)) // (2 * count(current_penalty)))::DOUBLE / 100 END)"
STATS = f"count(*) AS violation_count, coalesce({TOTAL}, 0) AS total_penalties, coalesce({MEAN}, 0) AS avg_penalty"
VALID = "(naics_code IS NOT NULL AND naics_code <> '' AND naics_code NOT LIKE '0%' AND length(naics_code) >= 2)"


def norm(x: str) -> str:
    """The normaliser for ASCII names."""
    out = f"trim(upper(coalesce({x}, '')))"
    for s in SUFFIXES:
        out = f"trim(regexp_replace({out}, '{re.escape(s).replace(chr(92) + ' ', ' ')}$', ''))"
    out = rf"trim(regexp_replace(regexp_replace({out}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    words = ", ".join(f"'{w}'" for w in (*ARTICLES, ""))
    return f"array_to_string(list_filter(string_split({out}, ' '), lambda w: w NOT IN ({words})), ' ')"


def sector_name(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTORS.items()) + " ELSE 'Unknown' END"


def sector_words(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(upper({x}), '{'|'.join(keys)}') THEN '{code}'" for keys, code in SECTOR_WORDS) + " END"


def standard_text(x: str) -> str:
    whens = [f"WHEN {x} = '{k}' THEN '{v}'" for k, v in STANDARDS.items()] + [f"WHEN {x} LIKE '{k}%' THEN '{v}'" for k, v in STANDARDS.items()]
    return "CASE " + " ".join(whens) + " ELSE 'Unknown Standard' END"


_PARTS = {
    "v": f"SELECT *, {norm('company_name')} AS company_name_normalized FROM ({fixtures.VIOLATIONS.format(**fixtures.names_sql())})",
    "i": fixtures.INSPECTIONS.format(**fixtures.names_sql()),
    "a": fixtures.ACCIDENTS.format(**fixtures.names_sql()),
}


def sql(body: str, **more: str) -> str:
    """``body`` with the tables v, i and a that it (or ``more``) names, then ``more``, as common table expressions."""
    text = body + " ".join(more.values())
    parts = {k: q for k, q in _PARTS.items() if re.search(rf"(FROM|JOIN|,)\s+{k}\b", text)} | more
    return "WITH " + ", ".join(f"{k} AS ({q})" for k, q in parts.items()) + f" {body}" if parts else body


def recursive(text: str, *kept: str) -> str:
    """The SQL with common table expressions that may name themselves; those ``kept`` are computed once, not in each round."""
    for name in kept:
        text = text.replace(f" {name} AS (", f" {name} AS MATERIALIZED (", 1)
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _masks(short: str, other: str) -> str:
    """For each character of ``other`` the places of ``short`` that hold it, as bits."""
    bit = f"CASE WHEN substr({short}, pos, 1) = chr_ THEN 1::BIGINT << (pos - 1) ELSE 0 END"
    return f"list_transform(string_split({other}, ''), lambda chr_: coalesce(list_sum(list_transform(range(1, length({short}) + 1), lambda pos: {bit})), 0)::BIGINT)"


def _lcs(short: str, masks: str) -> str:
    """Length of the longest common subsequence of ``short`` (60 characters at most) and what the masks stand for."""
    full = f"((1::BIGINT << length({short})) - 1)"
    return f"(length({short}) - bit_count(list_reduce({masks}, lambda s_, m_: ((s_ + (s_ & m_)) | (s_ - (s_ & m_))) & {full}, {full})))"


def _ratio(short: str, other: str) -> str:
    return f"CASE WHEN {short} = '' AND {other} = '' THEN 100::DOUBLE ELSE 200::DOUBLE * {_lcs(short, _masks(short, other))} / (length({short}) + length({other})) END"


def _best_window(short: str, masks: str, length: str) -> str:
    window = f"{masks}[greatest(0, end_ - length({short})) + 1:least(end_, {length})]"
    size = f"(least(end_, {length}) - greatest(0, end_ - length({short})))"
    return f"list_max(list_transform(range(1, {length} + length({short})), lambda end_: 200::DOUBLE * {_lcs(short, window)} / (length({short}) + {size})))"


def scored(pairs: str) -> dict[str, str]:
    """Common table expressions up to ``sm``, the measures of each row of ``pairs`` (t, n): normalised names, t short."""
    tokens = lambda x: f"list_filter(string_split({x}, ' '), lambda w_: w_ <> '')"
    joined = lambda x: f"array_to_string(list_sort({x}), ' ')"
    apart = lambda x, y, no="": joined(f"list_filter({x}, lambda w_: {no} list_contains({y}, w_))")
    return {
        "nm": pairs,
        "tk": f"SELECT t, n, list_distinct({tokens('t')}) AS x, list_distinct({tokens('n')}) AS y, {joined(tokens('t'))} AS ts, {joined(tokens('n'))} AS ns, CASE WHEN length(t) <= length(n) THEN t ELSE n END AS sh, CASE WHEN length(t) <= length(n) THEN n ELSE t END AS lo FROM nm",
        "st3": f"SELECT *, {apart('x', 'y')} AS tboth, {apart('x', 'y', 'NOT')} AS only_t, {apart('y', 'x', 'NOT')} AS only_n, {_masks('sh', 'lo')} AS ml, {_masks('lo', 'sh')} AS ms FROM tk",
        "wt": "SELECT *, trim(tboth || ' ' || only_t) AS with_t, trim(tboth || ' ' || only_n) AS with_n FROM st3",
        "me": f"""SELECT t, n, {_ratio('t', 'n')} AS simple, {_ratio('ts', 'ns')} AS token_sort,
          CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN tboth <> '' AND (only_t = '' OR only_n = '') THEN 100 WHEN tboth = '' THEN {_ratio('with_t', 'with_n')}
            ELSE greatest({_ratio('with_t', 'with_n')}, {_ratio('tboth', 'with_t')}, {_ratio('tboth', 'with_n')}) END::DOUBLE AS token_set,
          CASE WHEN lo = '' THEN 100 WHEN sh = '' THEN 0 WHEN length(sh) < length(lo) THEN {_best_window('sh', 'ml', 'length(lo)')}
            ELSE greatest({_best_window('sh', 'ml', 'length(lo)')}, {_best_window('lo', 'ms', 'length(sh)')}) END::DOUBLE AS "partial" FROM wt""",
        "sm": """SELECT t, n, round(simple, 6) AS simple, round("partial", 6) AS "partial", round(token_sort, 6) AS token_sort, round(token_set, 6) AS token_set,
          CASE WHEN t = '' OR n = '' THEN 0 ELSE round(0.2::DOUBLE * simple + 0.2::DOUBLE * "partial" + 0.3::DOUBLE * token_sort + 0.3::DOUBLE * token_set, 6) END AS weighted FROM me""",
    }


#: erf(z / sqrt(2)) for 0 < z <= 7 by its series of positive terms.
_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 160), lambda k_: exp(2 * k_ * ln(2) + (2 * k_ + 1) * ln(z / sqrt(2)) - z * z / 2 - lgamma(2 * k_ + 2) + lgamma(k_ + 1))))"


def impacts(key: str) -> dict[str, str]:
    """Common table expressions up to ``res``, the analyses, from anchor windows ``wn`` and ranked gaps ``rk``."""
    by = f"{key}, analysis_type, anchor"
    change = "CASE WHEN before_count > 0 THEN round((after_count - before_count) / before_count::DOUBLE * 100, 2) WHEN after_count > 0 THEN 100 ELSE 0 END::DOUBLE"
    return {
        "rs": f"SELECT {by}, coalesce(sum(r) FILTER (side = 'b'), 0) - count(*) FILTER (side = 'b') * (count(*) FILTER (side = 'b') + 1) / 2::DOUBLE AS u1, count(*) FILTER (side = 'b') AS n1, count(*) FILTER (side = 'a') AS n2, sum(t * t - 1)::DOUBLE AS ties FROM rk GROUP BY ALL",
        "im": f"SELECT *, n1 + n2 AS nn, least(n1, n2) AS fewer, greatest(u1, n1 * n2 - u1) AS u, CASE WHEN before_count = 0 AND after_count = 0 THEN 'both_empty' WHEN before_count = 0 OR after_count = 0 THEN 'one_empty' ELSE 'rank_sum' END AS p_method FROM wn LEFT JOIN rs USING ({by})",
        "mx": "SELECT max(nn) AS most FROM im WHERE p_method = 'rank_sum' AND ties = 0 AND fewer <= 8",
        # ways to take some of the ranks 1 to items, by their sum
        "dp": "SELECT 0::BIGINT AS items, 0::BIGINT AS taken, 0::BIGINT AS ranks, 1::DOUBLE AS ways UNION ALL SELECT items + 1, taken + b, (ranks + b * (items + 1))::BIGINT, sum(ways) FROM dp CROSS JOIN mx CROSS JOIN (VALUES (0), (1)) c(b) WHERE items < most AND taken + b <= 8 GROUP BY ALL",
        "ex": "SELECT nn, fewer, u, least(1, 2 * coalesce(sum(ways) FILTER (ranks - fewer * (fewer + 1) // 2 >= ceil(u)), 0) / sum(ways)) AS pe FROM (SELECT DISTINCT nn, fewer, u FROM im WHERE p_method = 'rank_sum' AND ties = 0 AND fewer <= 8) JOIN dp ON items = nn AND taken = fewer GROUP BY ALL",
        "zs": "SELECT *, CASE WHEN var > 0 THEN (u - n1 * n2 / 2::DOUBLE - 0.5::DOUBLE) / sqrt(var) ELSE 0 END AS z FROM (SELECT *, n1 * n2 / 12::DOUBLE * (nn + 1 - ties / (nn * (nn - 1))) AS var FROM im)",
        "pv": f"SELECT zs.*, round(CASE p_method WHEN 'both_empty' THEN 1 WHEN 'one_empty' THEN 0.01 ELSE CASE WHEN pe IS NOT NULL AND ties = 0 THEN pe WHEN z <= 0 THEN 1 WHEN z > 7 THEN 0 ELSE greatest(0, 1 - {_ERF}) END END::DOUBLE, 4) AS p_value FROM zs LEFT JOIN ex USING (nn, fewer, u)",
        "kd": f"SELECT *, n_dated >= 3 AND p_value < 0.05 AS significant, CASE WHEN n_dated >= 3 THEN {change} ELSE 0 END AS rate_change_pct, CASE WHEN n_dated < 3 THEN 'Unable to Analyze' WHEN p_value >= 0.05 THEN 'No Significant Change' WHEN after_count > before_count THEN 'Increased' WHEN after_count < before_count THEN 'Reduced' ELSE 'No Change' END AS impact FROM pv",
        "res": f"""SELECT {by}, n_dated, before_count, after_count, before_count::DOUBLE AS before_rate, after_count::DOUBLE AS after_rate, rate_change_pct, p_method, p_value, significant, impact,
          CASE WHEN impact NOT IN ('Increased', 'Reduced') THEN 'None' WHEN abs(rate_change_pct) >= 100 THEN 'Very Strong' WHEN abs(rate_change_pct) >= 50 THEN 'Strong' WHEN abs(rate_change_pct) >= 25 THEN 'Moderate' WHEN abs(rate_change_pct) >= 10 THEN 'Weak' ELSE 'Minimal' END AS impact_strength FROM kd""",
    }
