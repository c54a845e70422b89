"""Offsets of naive wall clocks."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_offsets(wall: Column, zone: str | Column) -> Column:
    """Offsets in seconds that a wall clock can have in a zone: none in a gap, two in a fold, else one.

    The offsets of the day before and after are the candidates; those that lead back to the wall
    clock are valid.
    """
    z = F.lit(zone) if isinstance(zone, str) else zone
    utc = F.lit("UTC")
    day = F.expr("interval 1 day")
    near = F.array_distinct(F.transform(F.array(wall - day, wall + day), lambda x: F.timestamp_diff("SECOND", x, F.convert_timezone(utc, z, x))))
    back = lambda o: F.convert_timezone(utc, z, wall - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), o.cast("decimal(18,6)"))) == wall
    return F.array_sort(F.filter(near, back))


def resolve_offset(offsets: Column, stated: Column, fixed_utc: Column) -> tuple[Column, Column]:
    """The offset to use, and how it was found."""
    n = F.size(offsets)
    stated_fits = stated.isNotNull() & F.array_contains(offsets, stated)
    label = (
        F.when(fixed_utc, "fixed_utc").when(n == 0, "nonexistent_local_time")
        .when(stated_fits & (n == 2), "stated_in_fold").when(stated.isNotNull() & ~stated_fits, "stated_offset_invalid")
        .when(n == 2, "ambiguous_local_time").otherwise("unique")
    )
    value = F.when(fixed_utc, F.lit(0)).when(stated_fits, stated).when(n == 1, F.element_at(offsets, 1))
    return value, label


def to_utc(wall: Column, offset: Column) -> Column:
    """UTC wall clock of a wall clock with an offset in seconds."""
    return wall - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset.cast("decimal(18,6)"))


def scalar_offsets(wall: datetime, zone: str) -> list[int]:
    """``valid_offsets`` of one wall clock, from the standard library: what the Column expression must equal."""
    z = ZoneInfo(zone)
    found = {wall.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1)}
    return sorted(int(o.total_seconds()) for o in found if (wall.replace(tzinfo=ZoneInfo("UTC")) - o).astimezone(z).replace(tzinfo=None) == wall)


def scalar_elapsed(start: datetime, start_offset: int, end: datetime, end_offset: int) -> float:
    """Seconds between two wall clocks with their offsets."""
    return ((end - timedelta(seconds=end_offset)) - (start - timedelta(seconds=start_offset))).total_seconds()


def elapsed(start: Column, start_offset: Column, end: Column, end_offset: Column) -> Column:
    """Seconds between two wall clocks with their offsets; null where an offset isn't known."""
    micros = F.timestamp_diff("MICROSECOND", to_utc(start, start_offset), to_utc(end, end_offset))
    return micros / F.lit(1e6)
