"""Date parts and casts. Text that does not parse is null; naive timestamps stay zone-free."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

PARTS = ("Year", "Month", "Day", "DayOfWeek", "Hour", "Minute", "IsWeekend")


def as_time(df: DataFrame, col: str) -> Column:
    kind = dict(df.dtypes)[col]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.col(col)
    if kind == "date":
        return F.col(col).cast("timestamp_ntz")
    return F.col(col).cast("string").try_cast("timestamp_ntz")


def part(t: Column, name: str) -> Column:
    """Monday is 0; IsWeekend of a null date is 0."""
    if name == "Year":
        return F.year(t)
    if name == "Month":
        return F.month(t)
    if name == "Day":
        return F.dayofmonth(t)
    if name == "DayOfWeek":
        return F.weekday(t)
    if name == "Hour":
        return F.hour(t)
    if name == "Minute":
        return F.minute(t)
    if name == "IsWeekend":
        return F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0))
    raise ValueError(f"unknown date part {name!r}")


def add_parts(df: DataFrame, col: str, parts=PARTS) -> DataFrame:
    t = as_time(df, col)
    return df.withColumns({f"{col}_{p}": part(t, p) for p in parts})


def epoch_seconds(t: Column) -> Column:
    """Whole seconds since 1970 of a naive timestamp, whatever the session time zone."""
    return (F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
            + F.floor(F.second(t))).cast("long")


def epoch_time(t: Column) -> Column:
    """Seconds since 1970 with their fraction, to the microsecond."""
    return epoch_seconds(t) + (F.extract(F.lit("SECOND"), t).cast("double") - F.floor(F.second(t)))


def month_cycle(t: Column) -> tuple[Column, Column]:
    angle = F.month(t) * F.lit(2 * math.pi / 12)
    return F.sin(angle), F.cos(angle)


def cast_to(df: DataFrame, col: str, kind: str) -> Column:
    """int (non-integral is null), float, string, datetime, category (as string), bool.

    bool follows "any non-zero number or non-empty text is true"; null stays null.
    """
    c = F.col(col)
    if kind == "int":
        d = c.try_cast("double")
        return F.when(d == F.floor(d), d.try_cast("long"))
    if kind == "float":
        return c.try_cast("double")
    if kind in ("string", "category"):
        return c.cast("string")
    if kind == "datetime":
        return as_time(df, col)
    if kind == "bool":
        source = dict(df.dtypes)[col]
        if source == "string":
            return F.length(c) > 0
        return c if source == "boolean" else c != 0
    raise ValueError(f"unknown cast {kind!r}")
