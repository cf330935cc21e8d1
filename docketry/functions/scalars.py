"""Column expressions: cleaning, dates, money, labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.lookups import SECTOR_WORDS, SECTORS, STANDARDS

DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "MM/dd/yyyy")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cleaned(x: Column | str, width: int | None = None) -> Column:
    """Trimmed, cut to ``width``, blank to null."""
    out = F.regexp_replace(c(x).cast("string"), r"(?U)^\s+|\s+$", "")
    return F.nullif(F.substring(out, 1, width) if width else out, F.lit(""))


def parsed_date(x: Column | str) -> Column:
    """A date in one of the known formats, else null."""
    return F.coalesce(*[F.try_to_timestamp(c(x).cast("string"), F.lit(f)) for f in DATE_FORMATS]).cast("date")


def number(x: Column | str, type_: str = "decimal(18,2)") -> Column:
    return c(x).try_cast(type_)


def cents(x: Column | str) -> Column:
    """Money as whole cents, so that sums are exact whatever their order."""
    return F.round(c(x).cast("decimal(18,2)") * 100).cast("long")


def total(x: Column | str) -> Column:
    """Sum of money; null without values."""
    return F.sum(cents(x)).cast("double") / 100


def mean2(x: Column | str) -> Column:
    """Mean of money, half a cent rounded up; null without values."""
    s, n = F.sum(cents(x)), F.count(c(x))
    return F.when(n > 0, F.floor((2 * s + n) / (2 * n)).cast("double") / 100)


def per(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def positive(x: Column | str) -> Column:
    return F.when(c(x) > 0, c(x))


def filled(x: Column | str) -> Column:
    """Neither null nor empty."""
    return c(x).isNotNull() & (c(x) != "")


def valid_industry(code: Column | str) -> Column:
    return filled(code) & ~c(code).startswith("0") & (F.length(c(code)) >= 2)


def unknown_industry(code: Column | str) -> Column:
    return F.coalesce(c(code).isin("0", "0.0"), F.lit(False))


def sector(code: Column | str) -> Column:
    return F.substring(c(code), 1, 2)


def sector_name(code: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SECTORS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, c(code)), F.lit("Unknown"))


def sector_from_words(name: Column | str) -> Column:
    """Sector told by a company's name; null if no rule matches."""
    upper, out = F.upper(c(name)), None
    for keys, code in SECTOR_WORDS:
        hit = upper.rlike("|".join(keys))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def standard_description(standard: Column | str) -> Column:
    """Exact match, else the first listed key that the standard begins with."""
    s = c(standard)
    out = None
    for key, text in STANDARDS.items():
        out = F.when(s == key, text) if out is None else out.when(s == key, text)
    for key, text in STANDARDS.items():
        out = out.when(s.startswith(key), text)
    return out.otherwise("Unknown Standard")


def risk_level(score: Column) -> Column:
    return F.when(score >= 75, "Critical").when(score >= 50, "High").when(score >= 25, "Medium").otherwise("Low")


def agency_count_score(n: Column) -> Column:
    return F.when(n <= 1, 0.0).when(n == 2, 50.0).when(n == 3, 75.0).otherwise(100.0)


def peer_label(mine: Column, mean: Column) -> Column:
    out = F.when(mine > 1.5 * mean, "Much Higher Risk").when(mine > mean, "Higher Risk")
    return out.when(mine < 0.5 * mean, "Much Lower Risk").when(mine < mean, "Lower Risk").otherwise("Average")


def iso_date(x: Column | str) -> Column:
    return F.date_format(c(x), "yyyy-MM-dd")


def free(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores in front as make it unlike all of ``taken`` (cases don't count)."""
    used = {x.lower() for x in taken}

    def one(name: str) -> str:
        while name.lower() in used:
            name = f"_{name}"
        return name

    return tuple(map(one, names))
