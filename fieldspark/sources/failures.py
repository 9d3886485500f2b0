"""Dead letters: points whose modalities failed wholly or in part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import join_groups


def split_failures(
    results: DataFrame, point: str, modality: str, error: str, saves: DataFrame | None = None
) -> DataFrame:
    """(point, kind, reason) of every point with a failure.

    ``results`` has one or more rows per point and modality; ``error`` is NULL on success. Errors
    are first reduced to one per point and modality, so the list that is joined into ``reason``
    has at most one entry per modality. ``saves`` holds points whose record could not be stored, with the
    same columns for point and error, as `ranking.split_long` gives them: these are of kind ``save``,
    whatever became of their modalities.
    """
    per_modality = results.groupBy(point, modality).agg(
        F.min(error).alias("_e"), F.bool_or(F.col(error).isNull()).alias("_ok")
    )
    failed = ~F.col("_ok")
    text = F.when(failed, F.concat_ws(": ", modality, "_e"))
    per_point = per_modality.groupBy(point).agg(
        F.count_if(F.col("_ok")).alias("_good"),
        F.count_if(failed).alias("_bad"),
        F.concat_ws("; ", F.array_sort(F.collect_list(text))).alias("_list"),
    )
    kind = F.when(F.col("_good") == 0, "full").otherwise("partial")
    prefix = F.when(F.col("_good") == 0, "No modality delivered: ").otherwise("Some modalities missing: ")
    failed_points = per_point.where(F.col("_bad") > 0).select(
        point, kind.alias("kind"), F.concat(prefix, "_list").alias("reason")
    )
    if saves is None:
        return failed_points
    unsaved = _unsaved(saves, point, error)
    reason = F.concat(F.lit("Record not stored: "), F.col("_save"))
    return join_groups(failed_points, unsaved, [point], "left_anti").unionByName(
        unsaved.select(point, F.lit("save").alias("kind"), reason.alias("reason"))
    )


def _unsaved(saves: DataFrame, point: str, error: str) -> DataFrame:
    """One row per point; of several reasons the first by name."""
    return saves.groupBy(point).agg(F.coalesce(F.min(error), F.lit("unknown")).alias("_save"))


def failure_summary(
    results: DataFrame, point: str, modality: str, error: str, saves: DataFrame | None = None
) -> DataFrame:
    """Number of points, of full failures or records that were not stored, and of partial failures."""
    points = (
        results.groupBy(point, modality)
        .agg(F.bool_or(F.col(error).isNull()).alias("_ok"))
        .groupBy(point)
        .agg(F.bool_or("_ok").alias("_any"), F.bool_and("_ok").alias("_all"))
    )
    if saves is not None:
        points = join_groups(points, _unsaved(saves, point, error), [point], "left")
        points = points.withColumn("_any", F.col("_any") & F.col("_save").isNull())
    return points.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("_any")).alias("failed"),
        F.count_if(F.col("_any") & ~F.col("_all")).alias("partial"),
    )


def write_failures(failures: DataFrame, path: str) -> None:
    """One directory per kind."""
    failures.write.mode("overwrite").partitionBy("kind").json(path)
