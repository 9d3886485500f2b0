"""Predicates, projections and array packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from . import ranking


def date_range(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Half-open ``[start, end)``; compares the raw column so the filter reaches the scan."""
    kind = df.schema[ts].dataType
    bound = lambda s: F.lit(s).cast(kind)
    return df.where((F.col(ts) >= bound(start)) & (F.col(ts) < bound(end)))


def below(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.where(F.col(column) < F.lit(threshold))


def contains_all(df: DataFrame, array: str, wanted: Sequence) -> DataFrame:
    for value in wanted:
        df = df.where(F.array_contains(array, value))
    return df


def select_variables(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The named variables in the given order; an unknown name is an error."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown variables: {unknown}")
    return df.select(*keep, *names)


def select_packed(values: Column, all_names: Sequence[str], names: Sequence[str]) -> Column:
    """`select_variables` for a value array whose slots are named by ``all_names``."""
    index = {n: i + 1 for i, n in enumerate(all_names)}
    unknown = [n for n in names if n not in index]
    if unknown:
        raise ValueError(f"unknown variables: {unknown}")
    return F.array(*[F.element_at(values, index[n]) for n in names])


def with_metadata_defaults(df: DataFrame) -> DataFrame:
    """Fill the optional point properties of ``(id, properties, ...)``."""
    p = lambda name: F.col("properties").getField(name)
    # the prefix counts only when there is an underscore
    prefix = F.when(F.col("id").contains("_"), F.split_part("id", F.lit("_"), F.lit(1)))
    return df.select(
        F.col("id").alias("sample_id"),
        F.coalesce(p("grid_id"), prefix.try_cast("int"), F.lit(0)).alias("grid_id"),
        F.coalesce(p("country"), F.lit("Unknown")).alias("country"),
        F.coalesce(p("continent"), F.lit("Europe")).alias("continent"),
        F.coalesce(p("classification"), F.lit(0)).alias("classification"),
        F.coalesce(p("tempCropArea"), F.lit(0.0)).alias("temp_crop_area"),
        F.coalesce(p("cellArea"), F.lit(0.0)).alias("cell_area"),
        *[c for c in df.columns if c not in ("id", "properties")],
    )


def null_if_nodata(df: DataFrame, columns: Sequence[str], nodata: float = 0.0) -> DataFrame:
    return df.withColumns({c: V.null_if_nodata(F.col(c), nodata) for c in columns})


def trim_valid(df: DataFrame, valid: str = "valid") -> DataFrame:
    """Keep valid observations only, interior gaps included."""
    return df.where(F.col(valid))


def trim_valid_packed(steps: Column) -> Column:
    return F.filter(steps, lambda s: s["valid"])


def drop_sentinel(df: DataFrame, columns: Sequence[str], sentinel: int = -1) -> DataFrame:
    """Scalars have to differ from the sentinel; arrays need any element that does."""
    for c in columns:
        if isinstance(df.schema[c].dataType, T.ArrayType):
            df = df.where(F.exists(c, lambda x: x != sentinel))
        else:
            df = df.where(F.col(c) != sentinel)
    return df


def drop_targets(df: DataFrame, targets: Sequence[str] = ("reference_embedding",)) -> DataFrame:
    """Without the columns that only the scoring step reads."""
    return df.drop(*targets)


def fill_invalid(
    df: DataFrame, placeholder: dict[str, float | Column], valid: str = "valid"
) -> DataFrame:
    """Replace variables of invalid steps by their placeholder; valid steps stay as they are."""
    value = lambda p: p if isinstance(p, Column) else F.lit(float(p))
    return df.withColumns(
        {v: F.when(F.col(valid), F.col(v)).otherwise(value(p)) for v, p in placeholder.items()}
    )


def pack(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    variables: Sequence[str],
    max_time: int,
) -> DataFrame:
    """One array of exactly ``max_time`` steps per group.

    Steps are in time order and padded with NaN, 'NA' and False. A longer series is an error.
    """
    steps = df.select(
        *keys,
        F.col(ts),
        *ties,
        F.date_format(ts, "yyyy-MM-dd").alias("timestamp"),
        F.lit(True).alias("valid"),
        F.array(*[F.col(v).cast("double") for v in variables]).alias("values"),
    )
    rows = ranking.bounded_lists(
        steps,
        keys,
        [F.col(ts), *[F.col(t) for t in ties]],
        ["timestamp", "valid", "values"],
        max_time,
        "steps",
    )
    nan = F.lit(float("nan"))
    pad = F.struct(
        F.lit("NA").alias("timestamp"),
        F.lit(False).alias("valid"),
        F.array(*[nan for _ in variables]).alias("values"),
    )
    return rows.withColumn(
        "steps", F.concat("steps", F.array_repeat(pad, F.lit(max_time) - F.size("steps")))
    )


def unpack(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Inverse of `pack`: one row per step with ``pos, timestamp, valid`` and the variables."""
    rows = df.select(*keys, F.posexplode("steps").alias("pos", "s"))
    return rows.select(
        *keys,
        "pos",
        F.col("s.timestamp").alias("timestamp"),
        F.col("s.valid").alias("valid"),
        *[
            F.nullif(F.col("s.values")[i], F.lit(float("nan"))).alias(v)
            for i, v in enumerate(variables)
        ],
    )


def pack_depths(
    df: DataFrame, keys: Sequence[str], labels: Sequence[str], depth: str = "depth", value: str = "value"
) -> DataFrame:
    """Long depth rows to one fixed-order array per (keys); all-missing gives a NULL array."""
    slots = [F.max(F.when(F.col(depth) == d, F.col(value))) for d in labels]
    wide = df.groupBy(*keys).agg(*[s.alias(f"_d{i}") for i, s in enumerate(slots)])
    columns = [F.col(f"_d{i}") for i in range(len(labels))]
    return wide.select(
        *keys, F.when(F.coalesce(*columns).isNotNull(), F.array(*columns)).alias("depths")
    )


def unpack_depths(df: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(d) for d in labels])
    return df.select(*keys, F.posexplode("depths").alias("_i", "value")).select(
        *keys, F.element_at(names, F.col("_i") + 1).alias("depth"), "value"
    )


def year_long(
    df: DataFrame, keys: Sequence[str], year: str, variables: Sequence[str], years: Sequence[int], prefix: str
) -> DataFrame:
    """One row per supported year and variable, named ``<prefix>_<variable>``; NULLs skipped."""
    kept = df.where(F.col(year).isin(list(years)))
    return (
        kept.unpivot([*keys, year], list(variables), "variable", "value")
        .where(F.col("value").isNotNull())
        .withColumn("variable", F.concat(F.lit(prefix + "_"), F.lower("variable")))
    )
