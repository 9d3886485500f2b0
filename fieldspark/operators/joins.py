"""Dictionary, statistics, embedding and assembly joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import ranking


def lookup_continent(
    df: DataFrame, dim: DataFrame, key: str = "country", default: str = "Unknown"
) -> DataFrame:
    """Add ``continent`` from a (key, continent) dictionary; unlisted keys get the default.

    A key listed more than once has its first continent by name, and no row is multiplied.
    """
    side = ranking.small_table(dim.groupBy(key).agg(F.min("continent").alias("continent")))
    return df.join(side, key, "left").withColumn(
        "continent", F.coalesce("continent", F.lit(default))
    )


def normalise_long(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """z-score of (by.., value) rows; a variable without statistics uses mean 0 and std 1.

    Statistics have one row per variable; that is checked before they are broadcast.
    """
    side = ranking.small_table(stats.select(*by, "mean", "std"))
    joined = df.join(side, list(by), "left")
    scaled = V.zscore(
        F.col("value"), F.coalesce("mean", F.lit(0.0)), F.coalesce("std", F.lit(1.0))
    )
    return joined.withColumn("value", scaled).drop("mean", "std")


def wide_stats(df: DataFrame, variables: Sequence[str], valid: str | None = None) -> DataFrame:
    """One row with a struct column per variable holding mean and std of its valid values."""
    x = lambda v: F.when(F.col(valid), F.col(v)) if valid else F.col(v)
    return df.agg(
        F.struct(
            *[
                F.struct(
                    F.coalesce(F.avg(x(v)), F.lit(0.0)).alias("mean"),
                    F.coalesce(F.stddev_pop(x(v)), F.lit(1.0)).alias("std"),
                ).alias(v)
                for v in variables
            ]
        ).alias("stats")
    )


def normalise_wide(df: DataFrame, stats: DataFrame, variables: Sequence[str]) -> DataFrame:
    """z-score of wide columns by the one row of `wide_stats`, read as a scalar subquery."""
    known = stats.schema["stats"].dataType.names
    row = stats.scalar()
    return df.withColumns(
        {
            v: V.zscore(F.col(v).cast("double"), row[v]["mean"], row[v]["std"])
            for v in variables
            if v in known
        }
    )


def assemble(meta: DataFrame, sides: dict[str, DataFrame], key: str = "sample_idx") -> DataFrame:
    """One record per sample with a struct per modality; a missing modality is a NULL struct.

    Every side has to be aggregated to one row per sample. All joins use the same key, so the
    sides meet on one partitioning and no key repeats.
    """
    out = meta
    for name, side in sides.items():
        fields = [c for c in side.columns if c != key]
        out = out.join(side.select(key, F.struct(*fields).alias(name)), key, "left")
    return out


def attach_embeddings(
    samples: DataFrame, embeddings: DataFrame, key: str = "sample_idx"
) -> DataFrame:
    """Join by index; a sample without an embedding fails the job instead of vanishing.

    The check is a filter, so every plan keeps it, also one that does not read the vector.
    """
    missing = F.raise_error(F.concat(F.lit("no embedding for sample "), F.col(key).cast("string")))
    side = embeddings.select(key, "embedding")
    covered = F.when(F.col("embedding").isNull(), missing.cast("boolean")).otherwise(True)
    return samples.join(side, key, "left").where(covered)


def missing_samples(meta: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """Samples absent from a modality; its keys are reduced to distinct ones before they move."""
    return meta.join(observations.select(key).distinct(), key, "left_anti")


def present_samples(meta: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    return meta.join(observations.select(key).distinct(), key, "left_semi")


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().intersect(b.distinct())


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct keys on one side only, with the side."""
    a, b = a.distinct(), b.distinct()
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(
        b.subtract(a).withColumn("side", F.lit("b"))
    )


def inspect_sample(tables: dict[str, DataFrame], sample: int, key: str = "sample_idx") -> DataFrame:
    """Everything stored about one sample as (source, row) lines; the filter reaches each scan."""
    lines = None
    for name, df in tables.items():
        rows = df.where(F.col(key) == sample)
        part = rows.select(F.lit(name).alias("source"), F.to_json(F.struct(*df.columns)).alias("row"))
        lines = part if lines is None else lines.unionByName(part)
    return lines


def scatter_dense(
    embeddings: DataFrame, dim: int, index: str = "sample_idx", vector: str = "embedding"
) -> DataFrame:
    """Rows 0..max(index); an absent index is the zero vector, a repeated one is an error."""
    unique = embeddings.groupBy(index).agg(
        F.count(F.lit(1)).alias("_c"), F.first(vector).alias("_v")
    )
    repeated = F.raise_error(F.concat(F.lit("repeated index "), F.col(index).cast("string")))
    checked = unique.select(
        F.when(F.col("_c") > 1, repeated.cast("bigint")).otherwise(F.col(index)).alias(index), "_v"
    )
    top = embeddings.agg(F.max(index)).first()[0]
    every = embeddings.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", index)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return every.join(checked, index, "left").select(
        index, F.coalesce(F.col("_v"), zeros).alias(vector)
    )
