"""Identifier, text and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(c: Column | str) -> Column:
    """Trimmed and upper-cased."""
    return F.upper(F.trim(col(c)))


def full_match(c: Column | str, pattern: str) -> Column:
    """Whether the whole text matches; ``rlike`` alone finds."""
    return col(c).rlike(rf"\A(?:{pattern})\z")


def canonical_case_id(c: Column | str) -> Column:
    """``C`` and nine digits as they are, up to nine bare digits padded, anything else null."""
    t = tidy(c)
    return F.when(full_match(t, "C[0-9]{9}"), t).when(full_match(t, "[0-9]{1,9}"), F.concat(F.lit("C"), F.lpad(t, 9, "0")))


def joined_key(*cs: Column | str, missing: str = "<NULL>", sep: str = "|") -> Column:
    """Columns as one text, nulls spelled out. Values that hold the separator or spell the null mark can meet others; a caller that has such values must escape them."""
    return F.concat_ws(sep, *(F.coalesce(col(c).cast("string"), F.lit(missing)) for c in cs))


def digest(*cs: Column | str) -> Column:
    return F.sha2(joined_key(*cs).cast("binary"), 256)


def coalesce_generations(current: Column | str, legacy: Column | str, backfilled: str = "UNKNOWN") -> tuple[Column, Column]:
    """A column that two schema generations spell differently, and which generation gave it."""
    new, old = tidy(current), tidy(legacy)
    usable = new.isNotNull() & (new != backfilled)
    value = F.when(usable, new).when(old.isNotNull(), old).otherwise(new)
    origin = F.when(usable & old.isNotNull() & (new != old), "conflict").when(usable, "current").when(old.isNotNull(), "legacy").when(new.isNotNull(), "backfilled").otherwise("missing")
    return value, origin


def age_years(born: Column | str, on: Column | str) -> Column:
    """Completed years, null without a birth date."""
    b, d = col(born), col(on)
    early = (F.month(d) * 100 + F.dayofmonth(d)) < (F.month(b) * 100 + F.dayofmonth(b))
    return F.when(b.isNotNull(), F.year(d) - F.year(b) - F.when(early, 1).otherwise(0))


def age_band(age: Column | str, edges: tuple[int, int] = (50, 70)) -> Column:
    a = col(age)
    low, high = edges
    return F.when(a.isNull() | (a < 0), "unknown").when(a < low, f"<{low}").when(a < high, f"{low}-{high - 1}").otherwise(f"{high}+")


def valid_token(c: Column | str, longest: int = 128) -> Column:
    """Letters, digits and ``._:-``, starting with a letter or digit."""
    return F.coalesce(full_match(c, rf"[A-Za-z0-9][A-Za-z0-9._:\-]{{0,{longest - 1}}}"), F.lit(False))


def valid_commit(c: Column | str) -> Column:
    return F.coalesce(full_match(c, "[0-9a-f]{40}"), F.lit(False))


def bounded(c: Column | str, low: float, high: float) -> Column:
    """A finite number within bounds."""
    v = col(c)
    return F.coalesce(~F.isnan(v) & v.between(low, high), F.lit(False))


def offset_instant(c: Column | str) -> Column:
    """An ISO-8601 text with a mandatory offset as a UTC wall clock, else null."""
    t = col(c)
    return F.when(t.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})\z"), F.try_to_timestamp(t)).cast("timestamp_ntz")


def micros(c: Column | str) -> Column:
    """Microseconds of a wall clock since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(c))


def week_start(c: Column | str) -> Column:
    """Monday of the week, as a date."""
    d = F.to_date(col(c))
    return F.date_sub(d, F.weekday(d))


def boundary_seconds(start: Column | str, end: Column | str) -> Column:
    """Whole-second boundaries between two wall clocks, which elapsed seconds undercount."""
    trunc = lambda x: F.date_trunc("second", x).cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", trunc(col(start)), trunc(col(end)))


def cents(c: Column | str) -> Column:
    """Money as an exact number of cents."""
    return F.round(col(c) * 100).cast("long")
