"""Weeks, week keys and cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lenient_ts(text: Column) -> Column:
    """Parse a time string; anything unreadable becomes NULL."""
    return F.try_to_timestamp(text)


def week_end(ts: Column) -> Column:
    """The Sunday that closes the Monday-to-Sunday week of ``ts``."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "SUN")


def week_key(sunday: Column) -> Column:
    """Calendar year of the Sunday plus its ISO week, e.g. ``2021-W53`` for 2021-01-03."""
    week = F.lpad(F.weekofyear(sunday).cast("string"), 2, "0")
    return F.concat(F.year(sunday).cast("string"), F.lit("-W"), week)


def week_number(key: Column) -> Column:
    """Week of a ``YYYY-Www`` key, or the ISO week of a date string; NULL for anything else."""
    from_key = F.nullif(F.regexp_extract(key, r"-W(\d+)$", 1), F.lit("")).try_cast("int")
    # the padding mark is common, and a failed parse is expensive
    from_date = F.weekofyear(F.try_to_timestamp(F.nullif(key, F.lit("NA"))))
    return F.coalesce(from_key, from_date)


def cyclic(week: Column, weeks: int = 52) -> tuple[Column, Column]:
    """(sin, cos) of the angle of a week number; NULL gives (0, 0)."""
    angle = F.lit(2 * math.pi) * week / F.lit(weeks)
    zero = F.lit(0.0)
    return F.coalesce(F.sin(angle), zero), F.coalesce(F.cos(angle), zero)


def cyclic_week(key: Column, weeks: int = 52) -> tuple[Column, Column]:
    """`cyclic` of a week key or date string; unreadable text gives (0, 0)."""
    return cyclic(week_number(key), weeks)


def week_index(pos: Column) -> Column:
    """Week slot of a series position (a position, not an ISO week)."""
    return F.pmod(pos, F.lit(52)).cast("int")


def _sin_or_cos(angle: Column, dim: Column) -> Column:
    return F.when(F.pmod(dim, F.lit(2)) == 0, F.sin(angle)).otherwise(F.cos(angle))


def position_encoding(pos: Column, dim: Column, dims: int, base: float = 10000.0) -> Column:
    """Sinusoid position code of one dimension: sine on even, cosine on odd dimensions."""
    pair = F.floor(dim / F.lit(2)) * F.lit(2)
    return _sin_or_cos(pos / F.pow(F.lit(base), pair / F.lit(float(dims))), dim)


def week_encoding(week: Column, dim: Column, weeks: int = 52) -> Column:
    """Week code of one dimension; all dimensions share the angle of the week."""
    return _sin_or_cos(F.lit(2 * math.pi) * week / F.lit(weeks), dim)


def position_table(positions: DataFrame, dims: int) -> DataFrame:
    """(pos, dim, position_code, week_code) for every row of ``positions(pos)``."""
    return positions.select(
        "pos", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim")
    ).select(
        "pos",
        "dim",
        position_encoding(F.col("pos"), F.col("dim"), dims).alias("position_code"),
        week_encoding(F.pmod(F.col("pos"), F.lit(52)), F.col("dim")).alias("week_code"),
    )
