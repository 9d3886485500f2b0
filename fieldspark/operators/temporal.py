"""Weekly series: resampling, gap filling, clipping, calendar grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as TM
from ..functions import values as V
from . import ranking

WEEKS = 52


def weekly_resample(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    variables: Sequence[str],
    agg: str = "mean",
    heavy_rows: int = ranking.HEAVY_ROWS,
) -> DataFrame:
    """One row per (keys, week ending Sunday); missing values are skipped per variable.

    ``agg`` is ``mean``, ``median`` or ``max``; any other name means ``mean``. Mean and max
    pre-aggregate before the exchange, so a key with very many rows costs nothing extra.
    """
    rows = (
        df.where(F.col(ts).isNotNull())
        .withColumn("week_end", TM.week_end(F.col(ts)))
        .withColumns({v: V.nan_to_null(F.col(v)) for v in variables})
    )
    keys = [*keys, "week_end"]
    if agg == "median":
        return median_by(rows, keys, variables, heavy_rows)
    fn = F.max if agg == "max" else F.avg
    return rows.groupBy(*keys).agg(*[fn(v).alias(v) for v in variables])


# Value ranges a heavy group's distinct values are cut into.
MEDIAN_RANGES = 256


def median_by(
    df: DataFrame, keys: Sequence[str], variables: Sequence[str], heavy_rows: int = ranking.HEAVY_ROWS
) -> DataFrame:
    """Exact interpolated medians.

    A median cannot be pre-aggregated, so groups too large for one task take another way: their
    distinct values are counted, and a running count over value ranges finds the middle rows.
    """
    keys = list(keys)
    medians = [F.median(v).alias(v) for v in variables]
    heavy = ranking.heavy_groups(df, keys, heavy_rows)
    if heavy is None:
        return df.groupBy(*keys).agg(*medians)
    heavy = heavy.drop("_n")
    light = ranking.join_groups(df, heavy, keys, "left_anti").groupBy(*keys).agg(*medians)
    group = [*keys, "_variable"]
    counted = (
        ranking.join_groups(df, heavy, keys, "left_semi")
        .unpivot(keys, list(variables), "_variable", "_value")
        .where(F.col("_value").isNotNull())
        .groupBy(*group, "_value")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # ranges of about equally many distinct values, whatever their distribution
    shares = [i / MEDIAN_RANGES for i in range(1, MEDIAN_RANGES)]
    bounds = counted.groupBy(*group).agg(
        F.percentile_approx("_value", shares).alias("_bounds"), F.sum("_c").alias("_n")
    )
    slot = F.size(F.filter("_bounds", lambda b: b < F.col("_value")))
    placed = ranking.join_groups(counted, bounds, group, "inner").withColumn("_slot", slot).drop("_bounds")
    earlier = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*group, "_slot")
        .agg(F.sum("_c").alias("_s"))
        .select(*group, "_slot", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    )
    so_far = Window.partitionBy(*group, "_slot").orderBy("_value")
    ranked = ranking.join_groups(
        placed.withColumn("_sum", F.sum("_c").over(so_far)), offsets, [*group, "_slot"], "inner"
    )
    upto, n = F.col("_before") + F.col("_sum"), F.col("_n")
    holds = lambda m: ((upto - F.col("_c") < m) & (m <= upto)).cast("int")
    times = holds(F.floor((n + 1) / 2)) + holds(F.floor((n + 2) / 2))
    middle = ranked.withColumn("_times", times).where("_times > 0")
    half = F.col("_value") * F.col("_times") / 2
    pick = lambda v: F.sum(F.when(F.col("_variable") == v, half)).alias(v)
    found = middle.groupBy(*keys).agg(*[pick(v) for v in variables])
    # a heavy group without any value still has its row
    return light.unionByName(ranking.join_groups(heavy, found, keys, "left"))


def fill_weeks(
    weekly: DataFrame, keys: Sequence[str], variables: Sequence[str], length: int | None = None
) -> DataFrame:
    """Every week between the first and last of a key, or its first ``length`` weeks.

    Each row also produces the empty weeks up to its successor, so there is no calendar join.
    """
    order = Window.partitionBy(*keys).orderBy("week_end")
    last = F.coalesce(F.date_sub(F.lead("week_end").over(order), 7), F.col("week_end"))
    rows = weekly.withColumn("_last", last)
    if length is not None:
        # weeks the caller would clip are not produced in the first place
        first = F.first("week_end").over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_limit", F.date_add(first, 7 * (length - 1)))
        rows = rows.where(F.col("week_end") <= F.col("_limit")).withColumn(
            "_last", F.least("_last", "_limit")
        )
    spread = rows.select(
        *keys,
        F.col("week_end").alias("_start"),
        *variables,
        F.explode(F.sequence("week_end", "_last", F.expr("interval 7 days"))).alias("week_end"),
    )
    own = F.col("week_end") == F.col("_start")
    return spread.select(
        *keys, "week_end", *[F.when(own, F.col(v)).alias(v) for v in variables]
    )


def clip_pad(
    weekly: DataFrame,
    keys: Sequence[str],
    variables: Sequence[str],
    length: int = WEEKS,
    samples: DataFrame | None = None,
) -> DataFrame:
    """The earliest ``length`` weeks at positions 0..length-1, padded with invalid steps.

    A step is valid when any variable is present. The last row of a short series produces the
    padding. Keys of ``samples`` without any week get a fully invalid series.
    """
    order = Window.partitionBy(*keys).orderBy("week_end")
    pos = F.row_number().over(order) - 1
    ranked = weekly.withColumn("_pos", pos).where(F.col("_pos") < length)
    is_last = F.lead("week_end").over(order).isNull()
    end = F.when(F.col("_is_last"), F.lit(length - 1)).otherwise(F.col("_pos"))
    spread = ranked.withColumn("_is_last", is_last).select(
        *keys, "week_end", *variables, "_pos", F.explode(F.sequence(F.col("_pos"), end)).alias("pos")
    )
    own = F.col("pos") == F.col("_pos")
    series = spread.select(
        *keys,
        "pos",
        F.when(own, F.col("week_end")).alias("week_end"),
        *[F.when(own, F.col(v)).alias(v) for v in variables],
    )
    if samples is not None:
        empty = (
            samples.select(*keys)
            .join(weekly.select(*keys).distinct(), list(keys), "left_anti")
            .withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
        )
        series = series.unionByName(empty, allowMissingColumns=True)
    present = F.coalesce(*[F.col(v) for v in variables]).isNotNull()
    return series.select(
        *keys,
        "pos",
        "week_end",
        F.when(F.col("week_end").isNull(), F.lit("NA"))
        .otherwise(TM.week_key(F.col("week_end")))
        .alias("week_key"),
        present.alias("valid"),
        *variables,
    )


def with_week_encoding(series: DataFrame) -> DataFrame:
    sin, cos = TM.cyclic(F.weekofyear("week_end"))
    return series.withColumns({"week_sin": sin, "week_cos": cos})


def clean_series(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    variables: Sequence[str],
    nodata: float | None = None,
    agg: str = "mean",
    samples: DataFrame | None = None,
) -> DataFrame:
    """Raw observations to the 52-step cleaned and encoded series of each key.

    Two exchanges: the pre-aggregated weekly rows, then the weeks of a key for the two windows.
    """
    if nodata is not None:
        df = df.withColumns({v: V.null_if_nodata(F.col(v), nodata) for v in variables})
    weekly = weekly_resample(df, keys, ts, variables, agg)
    filled = fill_weeks(weekly, keys, variables, WEEKS)
    return with_week_encoding(clip_pad(filled, keys, variables, samples=samples))


def calendar_grid(
    df: DataFrame, keys: Sequence[str], ts: str, variables: Sequence[str], agg: str = "mean"
) -> DataFrame:
    """Weeks W01..W52 of the year of the first observation; weeks outside are dropped.

    Where two Sundays of the year share a key, the later one stays.
    """
    stamped = df.where(F.col(ts).isNotNull())
    weekly = weekly_resample(stamped, keys, ts, variables, agg)
    firsts = stamped.groupBy(*keys).agg(F.year(F.min(ts)).alias("year"))
    own = weekly.join(firsts, list(keys)).withColumn("_week", F.weekofyear("week_end"))
    inside = (F.year("week_end") == F.col("year")) & (F.col("_week") <= WEEKS)
    values = F.struct(*[F.col(v) for v in variables])
    by_week = own.groupBy(*keys, "year", "_week").agg(
        F.max_by(F.when(inside, values), F.when(inside, F.col("week_end"))).alias("_v")
    )
    # at most 53 ISO weeks per key: the map is bounded
    lookup = by_week.groupBy(*keys, "year").agg(
        F.map_from_entries(F.collect_list(F.struct("_week", "_v"))).alias("_map")
    )
    grid = lookup.select(
        *keys, "year", "_map", F.explode(F.sequence(F.lit(1), F.lit(WEEKS))).alias("_week")
    ).withColumn("_v", F.try_element_at("_map", F.col("_week")))
    return grid.select(
        *keys,
        (F.col("_week") - 1).alias("pos"),
        F.concat(
            F.col("year").cast("string"), F.lit("-W"), F.lpad(F.col("_week").cast("string"), 2, "0")
        ).alias("week_key"),
        F.col("_v").isNotNull().alias("valid"),
        *[F.col("_v").getField(v).alias(v) for v in variables],
    )


def first_valid(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, valid: Column
) -> DataFrame:
    """The first ``k`` valid observations of every key."""
    return ranking.first_rows(df.where(valid), keys, order, k)


def first_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """The first record of every key; an aggregate, so it combines before the exchange."""
    first = F.min(F.struct(*order, *[f for f in fields if f not in order])).alias("_first")
    names = [*order, *[f for f in fields if f not in order]]
    return df.groupBy(*keys).agg(first).select(
        *keys, *[F.col("_first").getField(n).alias(n) for n in names]
    )
