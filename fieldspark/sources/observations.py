"""Observation tables: one directory per modality, partitioned by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters


def write_modality(
    df: DataFrame, path: str, name: str, ts: str = "ts", key: str = "sample_idx"
) -> None:
    """Write one modality by month, ordered by sample and time.

    Rows are rebalanced by month: AQE merges small months into one task and splits large ones.
    """
    dated = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    (
        dated.hint("rebalance", F.col("month"))
        .sortWithinPartitions("month", key, ts)
        .write.mode("overwrite")
        .partitionBy("month")
        .parquet(f"{path}/{name}")
    )


def read_modality(
    spark: SparkSession,
    path: str,
    name: str,
    start: str,
    end: str,
    variables: Sequence[str],
    keep: Sequence[str] = ("sample_idx", "ts"),
) -> DataFrame:
    """The named variables of ``[start, end)``.

    Months outside are never listed, the time filter reaches the row groups, and only the chosen
    columns are read. An unknown variable is an error.
    """
    months = F.col("month").cast("string").between(start[:7], end[:7])
    rows = filters.date_range(spark.read.parquet(f"{path}/{name}").where(months), "ts", start, end)
    return filters.select_variables(rows, variables, keep)
