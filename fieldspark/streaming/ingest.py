"""Incremental ingest of new batch files into a clean table and dead letters."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


KEY = ["sample_idx", "modality", "ts", "variable"]


# Hash buckets per month of the stored rows.
BUCKETS = 16
LAYOUT = ["month", "bucket", "batch_id"]


def _placed(rows: DataFrame, batch: int) -> DataFrame:
    """``rows`` with the partition they are stored in: month of ``ts`` (0 without one), bucket, micro-batch."""
    month = F.coalesce(F.year("ts") * 100 + F.month("ts"), F.lit(0))
    bucket = F.pmod(F.xxhash64("sample_idx"), F.lit(BUCKETS)).cast("int")
    return rows.withColumns({"month": month.cast("int"), "bucket": bucket, "batch_id": F.lit(batch).cast("bigint")})


def _write(rows: DataFrame, path: str) -> None:
    """Replaces the partitions that ``rows`` are in, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def stored_near(rows: DataFrame, path: str, batch: int) -> DataFrame | None:
    """What other micro-batches stored in the months and buckets of ``rows``; None before the first one.

    The partitions are named in the scan's filters, so a small delivery reads little of a large store. At
    most one pair per month and bucket reaches the driver.
    """
    spark = rows.sparkSession
    try:
        store = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    touched: dict[int, list[int]] = {}
    for month, bucket in rows.select("month", "bucket").distinct().collect():
        touched.setdefault(month, []).append(bucket)
    there = [
        (F.col("month") == month) & F.col("bucket").isin(sorted(buckets)) for month, buckets in sorted(touched.items())
    ]
    return store.where(reduce(or_, there, F.lit(False))).where(F.col("batch_id") != batch)


def _unseen(rows: DataFrame, path: str, batch: int, columns: list[str]) -> DataFrame:
    """The rows whose ``columns`` are in no other micro-batch stored at ``path``."""
    stored = stored_near(rows, path, batch)
    if stored is None:
        # an empty file, which only carries the schema, makes the store readable
        _first = rows.limit(0).drop(*LAYOUT)
        _first.write.mode("overwrite").parquet(f"{path}/month=0/bucket=0/batch_id=-1")
        return rows
    stored = stored.select("month", "bucket", *columns)
    same = [rows["month"] == stored["month"], rows["bucket"] == stored["bucket"]]
    same += [rows[c].eqNullSafe(stored[c]) for c in columns]
    return rows.join(stored, reduce(and_, same), "left_anti")


def write_micro_batch(rows: DataFrame, batch: int, out_dir: str) -> None:
    """Stores a micro-batch by month, bucket of the key and number: a repeated one replaces its own rows only.

    Failures are set apart first, so that they never stand in the way of a good row with their key.
    A good row is kept unless its key was stored before; of several in one batch the least by its
    other columns is kept. Equal failures are stored once.
    """
    rows = rows.persist()
    try:
        good = rows.where(F.col("error").isNull()).drop("error")
        others = [c for c in good.columns if c not in KEY]
        first = good.groupBy(*KEY).agg(F.min(F.struct(*others)).alias("_row"))
        first = first.select(*[c if c in KEY else F.col("_row")[c].alias(c) for c in good.columns])
        bad = rows.where(F.col("error").isNotNull()).distinct()
        for found, label, columns in ((first, "clean", KEY), (bad, "dead_letters", bad.columns)):
            path = f"{out_dir}/{label}"
            _write(_unseen(_placed(found, batch), path, batch, columns), path)
    finally:
        rows.unpersist()


def stream_ingest(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    schema: T.StructType,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Ingest every file not seen before, then stop; the next run goes on from the checkpoint.

    Deliveries may come in any order of observation time: nothing is ever late, because repeated rows
    are found by their key in the stored table and not in a window of streaming state.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(in_dir)
        .writeStream.foreachBatch(lambda df, n: write_micro_batch(df, n, out_dir))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/clean").drop(*LAYOUT)


def read_dead_letters(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/dead_letters").drop(*LAYOUT)
