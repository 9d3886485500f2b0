"""Masked statistics, histograms and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, values as V
from . import ranking, temporal


def masked_stats(
    df: DataFrame, value: str, by: Sequence[str], valid: Column | None = None
) -> DataFrame:
    """Mean, population std, min, max and count of valid present values per group.

    A group without any gives 0, 1, 0, 0, 0.
    """
    x = V.nan_to_null(F.col(value))
    if valid is not None:
        x = F.when(valid, x)
    return (
        df.withColumn("_x", x)
        .groupBy(*by)
        .agg(
            F.coalesce(F.avg("_x"), F.lit(0.0)).alias("mean"),
            F.coalesce(F.stddev_pop("_x"), F.lit(1.0)).alias("std"),
            F.coalesce(F.min("_x"), F.lit(0.0)).alias("min"),
            F.coalesce(F.max("_x"), F.lit(0.0)).alias("max"),
            F.count("_x").alias("count"),
        )
    )


def long_form(
    df: DataFrame,
    section: str,
    modality: str,
    variables: Sequence[str],
    valid: Column | None = None,
) -> DataFrame:
    """(section, modality, variable, value) rows of a wide table; invalid rows give NULL."""
    names = list(variables)
    present = {
        v: F.when(valid, F.col(v)) if valid is not None else F.col(v) for v in names
    }
    wide = df.select(*[present[v].cast("double").alias(v) for v in names])
    return wide.unpivot([], names, "variable", "value").select(
        F.lit(section).alias("section"), F.lit(modality).alias("modality"), "variable", "value"
    )


def dataset_stats(sections: Sequence[DataFrame]) -> DataFrame:
    """`masked_stats` of any number of `long_form` tables in one aggregation."""
    rows = sections[0]
    for other in sections[1:]:
        rows = rows.unionByName(other)
    return masked_stats(rows, "value", ["section", "modality", "variable"])


def depth_stats(df: DataFrame, variables: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Statistics per ``<variable>_<depth>`` of depth arrays."""
    names = F.array(*[F.lit(d) for d in labels])
    rows = df.unpivot([], list(variables), "_var", "_depths").select(
        "_var", F.posexplode_outer("_depths").alias("_i", "value")
    )
    named = rows.select(
        F.concat_ws("_", "_var", F.element_at(names, F.col("_i") + 1)).alias("variable"), "value"
    )
    return masked_stats(named, "value", ["variable"])


def encoding_sections(
    points: DataFrame, series: DataFrame, modality: str, variables: Sequence[str] = ()
) -> list[DataFrame]:
    """Encoded coordinates of all points and week codes of the valid steps, in long form.

    ``variables`` of the series join its week codes, so that the series is read once.
    """
    coords = points.select(
        *[c.alias(n) for n, c in geo.cyclic_coords(F.col("lon"), F.col("lat")).items()]
    )
    return [
        long_form(
            coords, "metadata", "encoded_coordinates", ["lon_sin", "lon_cos", "lat_sin", "lat_cos"]
        ),
        long_form(
            temporal.with_week_encoding(series),
            "temporal_modalities",
            modality,
            ["week_sin", "week_cos", *variables],
            F.col("valid"),
        ),
    ]


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts of ``bins`` equal bins over [min, max], last bin closed, empty bins included.

    Bounds, total and mean come from a one-row scalar subquery; counts combine before the
    exchange.
    """
    x = V.nan_to_null(F.col(column))
    values = df.select(x.alias("_v")).where(F.col("_v").isNotNull())
    bounds = values.agg(
        F.struct(
            F.min("_v").alias("lo"),
            F.max("_v").alias("hi"),
            F.count("_v").alias("n"),
            F.avg("_v").alias("mean"),
        ).alias("b")
    )
    b = bounds.scalar()
    share = F.coalesce(F.try_divide(F.col("_v") - b["lo"], b["hi"] - b["lo"]), F.lit(0.0))
    slot = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (F.col("b")["hi"] - F.col("b")["lo"]) / bins
    return (
        every.join(counts, "bin", "left")
        .withColumn("b", b)
        .select(
            "bin",
            (F.col("b")["lo"] + F.col("bin") * width).alias("bin_start"),
            F.coalesce("n", F.lit(0)).alias("n"),
            F.col("b")["n"].alias("total"),
            F.col("b")["mean"].alias("mean"),
        )
    )


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """`histogram` of many columns at once: (variable, bin, bin_start, n, total, mean).

    One pass finds the bounds of all columns, a second one counts all their bins. A column without
    values has empty bins and no bounds.
    """
    names = list(columns)
    values = df.select(*[V.nan_to_null(F.col(c)).cast("double").alias(c) for c in names])
    bounds = [
        F.struct(
            F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"), F.avg(c).alias("mean")
        )
        for c in names
    ]
    b = values.agg(F.array(*bounds).alias("b")).scalar()

    def slot(i: int) -> Column:
        lo, hi = b[i]["lo"], b[i]["hi"]
        share = F.coalesce(F.try_divide(F.col(names[i]) - lo, hi - lo), F.lit(0.0))
        place = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
        return F.when(F.col(names[i]).isNotNull(), place).alias(names[i])

    slots = values.select(*[slot(i) for i in range(len(names))]).unpivot([], names, "variable", "bin")
    counts = slots.where(F.col("bin").isNotNull()).groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"))
    place = F.floor(F.col("id") / F.lit(bins)).cast("int")
    every = df.sparkSession.range(bins * len(names)).select(
        place.alias("_i"),
        F.get(F.array(*[F.lit(c) for c in names]), place).alias("variable"),
        (F.col("id") % bins).cast("int").alias("bin"),
    )
    own = F.get(F.col("_b"), F.col("_i"))
    return (
        every.join(counts, ["variable", "bin"], "left")
        .withColumn("_b", b)
        .select(
            "variable",
            "bin",
            (own["lo"] + F.col("bin") * ((own["hi"] - own["lo"]) / bins)).alias("bin_start"),
            F.coalesce("n", F.lit(0)).alias("n"),
            own["n"].alias("total"),
            own["mean"].alias("mean"),
        )
    )


def zero_stats(df: DataFrame, bands: Sequence[str], small: float = 10.0) -> DataFrame:
    """Zero and very small values per band, with a warning flag above one percent zeros."""
    rows = df.select(*[V.nan_to_null(F.col(b)).alias(b) for b in bands]).unpivot(
        [], list(bands), "band", "value"
    )
    total = F.count("value")
    pct = lambda n: F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0))
    zeros, smalls = F.count_if(F.col("value") == 0), F.count_if(F.col("value") < small)
    return (
        rows.groupBy("band")
        .agg(
            total.alias("total_valid"),
            zeros.alias("zero_count"),
            pct(zeros).alias("zero_pct"),
            smalls.alias("small_count"),
            pct(smalls).alias("small_pct"),
            F.coalesce(F.min("value"), F.lit(0.0)).alias("min"),
            F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"),
        )
        .withColumn("warn", F.col("zero_pct") > 1)
    )


def quality_report(stats: DataFrame) -> DataFrame:
    """Band lines of `zero_stats` plus how many bands exceed one and five percent zeros.

    The summary is one row, read as a scalar subquery.
    """
    above = stats.agg(
        F.struct(
            F.count_if(F.col("zero_pct") > 1).alias("above_1"),
            F.count_if(F.col("zero_pct") > 5).alias("above_5"),
        )
    ).scalar()
    return stats.withColumn("_a", above).select(
        "band",
        "total_valid",
        "zero_count",
        "zero_pct",
        F.col("_a")["above_1"].alias("bands_above_1_pct"),
        F.col("_a")["above_5"].alias("bands_above_5_pct"),
    )


def zero_cooccurrence(df: DataFrame, bands: Sequence[str], flag: str) -> DataFrame:
    """Share of band zeros that fall where the quality flag is zero, both present."""
    rows = df.where(F.col(flag).isNotNull()).unpivot([flag], list(bands), "band", "value")
    zeros = F.count_if(F.col("value") == 0)
    both = F.count_if((F.col("value") == 0) & (F.col(flag) == 0))
    return rows.groupBy("band").agg(
        zeros.alias("zeros"),
        both.alias("zeros_flagged"),
        F.coalesce(F.try_divide(both * 100.0, zeros), F.lit(0.0)).alias("flagged_pct"),
    )


def null_audit(
    series: DataFrame,
    sample: str,
    variables: Sequence[str],
    first_samples: int = 10,
    fail: bool = False,
) -> DataFrame:
    """Missing values at valid steps: in total, per variable, per week, and for the samples.

    Samples appear as their number (``samples``) and as the first ten by index. With ``fail`` any
    missing value raises.
    """
    names = list(variables)
    nulls = [F.when(F.col(v).isNull(), 1).otherwise(0).alias(f"_n{i}") for i, v in enumerate(names)]
    cells = series.where(F.col("valid")).select(F.col(sample).alias("_s"), F.col("pos").alias("_p"), *nulls)
    every = F.sum(sum((F.col(f"_n{i}") for i in range(1, len(names))), F.col("_n0")))
    # the whole, the weeks and the samples leave one expanded pass over the series
    sets = cells.groupingSets([[], [F.col("_p")], [F.col("_s")]], "_s", "_p").agg(
        F.grouping_id().alias("_set"),
        *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(names))],
        every.alias("_n"),
        F.count(F.lit(1)).alias("_rows"),
    )
    whole, weeks, samples = (F.col("_set") == k for k in (3, 2, 1))
    total = F.col("_n")
    if fail:
        message = F.concat(F.col("_n").cast("string"), F.lit(" missing values in valid steps"))
        total = F.when(F.col("_n") > 0, F.raise_error(message)).otherwise(F.col("_n"))

    def line(when: Column, scope: str, key: Column, n: Column, c: Column) -> Column:
        first = F.when(F.lit(scope == "sample"), F.col("_s"))
        values = [F.lit(scope), key.cast("string"), n.cast("bigint"), c.cast("bigint"), first]
        fields = ("scope", "key", "nulls", "cells", "_s")
        return F.when(when, F.struct(*[v.alias(f) for v, f in zip(values, fields)]))

    size, some = F.col("_rows") * len(names), F.col("_n") > 0
    lines = [
        line(whole, "total", F.lit("all"), total, size),
        *[line(whole, "variable", F.lit(v), F.col(f"_n{i}"), F.col("_rows")) for i, v in enumerate(names)],
        line(weeks & some, "week", F.col("_p"), F.col("_n"), size),
        line(samples, "samples", F.lit("with_nulls"), some.cast("int"), F.lit(1)),
        line(samples & some, "sample", F.col("_s"), F.col("_n"), size),
    ]
    found = sets.select(F.explode(F.array(*lines)).alias("l")).where(F.col("l").isNotNull()).select("l.*")
    # a series without valid steps still has the lines of the whole
    zeros = [("total", "all"), *[("variable", v) for v in names], ("samples", "with_nulls")]
    none = [F.struct(F.lit(a).alias("scope"), F.lit(k).alias("key")) for a, k in zeros]
    empty = series.sparkSession.range(1).select(F.explode(F.array(*none)).alias("l")).select(
        "l.*", F.lit(0).cast("bigint").alias("nulls"), F.lit(0).cast("bigint").alias("cells"),
        F.lit(None).cast(series.schema[sample].dataType).alias("_s"),
    )
    summed = found.unionByName(empty).groupBy("scope", "key").agg(
        F.sum("nulls").alias("nulls"), F.sum("cells").alias("cells"), F.min("_s").alias("_s")
    )
    # all samples share one group of the ranking, which keeps the first ones; other lines are alone in theirs
    one = [F.col("scope"), F.when(F.col("scope") != "sample", F.coalesce("key", F.lit("")))]
    rank = F.row_number().over(Window.partitionBy(*one).orderBy("_s"))
    first = summed.withColumn("_rank", rank).where(F.col("_rank") <= max(first_samples, 1))
    if first_samples < 1:
        first = first.where(F.col("scope") != "sample")
    return first.select("scope", "key", "nulls", "cells")


def members_by(df: DataFrame, group: str, member: str) -> DataFrame:
    """Sorted distinct members of each group as (group, position, member) rows.

    Long rows instead of one array per group: a group may be of any size.
    """
    distinct = df.select(group, member).distinct()
    ranked = ranking.rank_within(distinct, [group], [F.col(member)], F.substring(F.col(member), 1, 2))
    return ranked.select(
        group, F.col("_rank").alias("position"), member, F.col("_n").alias("members")
    )


def group_summary(df: DataFrame, group: str) -> DataFrame:
    """Row count per group and the grand total under ``Total``."""
    counts = df.rollup(group).agg(F.count(F.lit(1)).alias("n"), F.grouping(group).alias("_all"))
    return counts.select(
        F.when(F.col("_all") == 1, F.lit("Total")).otherwise(F.col(group)).alias(group), "n"
    )


def class_distribution(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def dense_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of the codes 0..max, codes without rows included.

    The upper end is one value per job, read before the plan is built.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(
        F.col(column).cast("bigint").alias("class")
    ).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("class")).first()[0]
    every = df.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", "class")
    return every.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def top_k(df: DataFrame, column: str, k: int = 20, sentinel: int | None = -1) -> DataFrame:
    """The most frequent values, ties by value."""
    rows = df if sentinel is None else df.where(F.col(column) != sentinel)
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(k)


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column)).distinct().orderBy(column)


def head_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """A sorted preview of ``n`` rows."""
    return df.orderBy(*order).limit(n)
