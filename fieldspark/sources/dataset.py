"""The cleaned dataset as a directory of Parquet tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling


def write_dataset(
    tables: dict[str, DataFrame],
    path: str,
    created: str,
    merged_from: int = 1,
    chunk: int = sampling.CHUNK,
    shard: int = sampling.SHARD,
    index: str = "sample_idx",
) -> None:
    """Write every table (``metadata`` is required) and a one-row ``dataset_info``."""
    for name, df in tables.items():
        order = [c for c in ("pos", "ts") if c in df.columns]
        laid = sampling.relayout(df, chunk, shard, index, order).drop("chunk_id", "shard_id")
        laid.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = tables["metadata"].sparkSession
    info = spark.read.parquet(f"{path}/metadata").agg(
        F.lit(created).alias("created"),
        F.count(F.lit(1)).alias("total_samples"),
        F.lit(merged_from).cast("bigint").alias("merged_from_batches"),
        F.lit(chunk).cast("bigint").alias("chunk_size"),
        F.lit(shard).cast("bigint").alias("shard_size"),
    )
    info.write.mode("overwrite").parquet(f"{path}/dataset_info")


def read_dataset(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in (*names, "dataset_info")}


def write_relayout(
    df: DataFrame,
    path: str,
    chunk: int = sampling.CHUNK,
    shard: int = sampling.SHARD,
    index: str = "sample_idx",
    order: Sequence[str] = (),
    partitions: int | None = None,
) -> None:
    """Index-ordered Parquet with lz4; readers of an index range skip files and row groups."""
    ordered = sampling.relayout(df, chunk, shard, index, order, partitions)
    ordered.write.mode("overwrite").option("compression", "lz4_raw").parquet(path)


def read_batches(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All batch outputs with their ``batch`` number; absent ones are skipped with a warning."""
    found = []
    for number, path in enumerate(paths):
        try:
            found.append(spark.read.parquet(path).withColumn("batch", F.lit(number)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"batch output not found: {path}", stacklevel=2)
    if not found:
        raise FileNotFoundError("no batch output found")
    return union_batches(found)


def union_batches(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a batch lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def batch_offsets(samples: DataFrame) -> DataFrame:
    """(batch, _off): samples in earlier batches, as a small local table.

    ``samples`` has one row per sample. One count per batch is read, and there are as many as
    paths were handed to the job.
    """
    counts = samples.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, running = [], 0
    for row in sorted(counts, key=lambda r: r["batch"]):
        offsets.append((row["batch"], running))
        running += row["n"]
    return samples.sparkSession.createDataFrame(offsets, "batch int, _off bigint")


def merge_batches(
    batches: DataFrame, index: str = "sample_idx", offsets: DataFrame | None = None
) -> DataFrame:
    """Shift each batch's own 0-based index behind the samples of earlier batches.

    Without ``offsets`` the table itself has to have one row per sample.
    """
    table = batch_offsets(batches) if offsets is None else offsets
    return (
        batches.join(F.broadcast(table), "batch")
        .withColumn(index, F.col(index) + F.col("_off"))
        .drop("_off")
    )


def merge_datasets(
    spark: SparkSession, paths: Sequence[str], names: Sequence[str], index: str = "sample_idx"
) -> dict[str, DataFrame]:
    """Merge whole batch datasets; all tables share the offsets of ``metadata``."""
    metadata = read_batches(spark, [f"{p}/metadata" for p in paths])
    offsets = batch_offsets(metadata)
    merged = {"metadata": merge_batches(metadata, index, offsets)}
    for name in names:
        table = read_batches(spark, [f"{p}/{name}" for p in paths])
        merged[name] = merge_batches(table, index, offsets)
    return merged


def first_nonempty_names(batches: DataFrame) -> DataFrame:
    """Variable names per modality from the first batch whose list is not empty."""
    filled = F.size("names") > 0
    return batches.groupBy("modality").agg(
        F.min_by(F.when(filled, F.col("names")), F.when(filled, F.col("batch"))).alias("names")
    )


def write_names(df: DataFrame, column: str, path: str) -> None:
    """Sorted distinct names, one per line."""
    names = df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value")
    names.write.mode("overwrite").text(path)
