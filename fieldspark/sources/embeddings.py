"""Embedding matrices."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def embedding_columns(columns: list[str]) -> list[str]:
    """The ``emb_<i>`` columns by numeric suffix; none at all is an error."""
    found = [c for c in columns if re.fullmatch(r"emb_\d+", c)]
    if not found:
        raise ValueError("no emb_* columns")
    return sorted(found, key=lambda c: int(c.split("_")[1]))


def read_embeddings(spark: SparkSession, path: str, index: str = "sample_idx") -> DataFrame:
    """CSV files with a header to (index, embedding ARRAY<FLOAT>).

    Without an index column, row ``i`` of the files in name order belongs to sample ``i``. The
    schema comes from one file's header; nothing is inferred from the data, and a file whose header
    has other names or another order is an error.
    """
    header = spark.read.csv(path, header=True).columns
    vector = embedding_columns(header)
    kinds = {c: "float" for c in vector} | {index: "bigint"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header)
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    if index not in header:
        rows = _with_row_number(rows, index)
    return rows.select(index, F.array(*vector).alias("embedding"))


def _with_row_number(rows: DataFrame, index: str) -> DataFrame:
    """Number the rows of a file scan in file order.

    Rows keep their order inside a file split, so a row's number is its place in the split plus
    the rows of earlier splits: those of the same file and those of earlier files. Counts stay
    tables, with a row per split and a row per file.
    """
    split = ["_path", "_start"]
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_order"),
    )
    counts = placed.groupBy(*split).agg(F.min("_order").alias("first"), F.count(F.lit(1)).alias("n"))
    files = counts.groupBy("_path").agg(F.sum("n").alias("_rows"))
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_path", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_files_before"))
    inside = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.col("_files_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)) - F.col("first")
    table = counts.join(files, "_path").select(*split, shift.alias("_shift"))
    return (
        placed.join(table, split)
        .withColumn(index, F.col("_order") + F.col("_shift"))
        .drop("_order", "_shift", *split)
    )


def write_embeddings(df: DataFrame, path: str, dim: int, index: str = "sample_idx") -> None:
    columns = [F.col("embedding")[i].alias(f"emb_{i}") for i in range(dim)]
    df.select(index, *columns).write.mode("overwrite").csv(path, header=True)
