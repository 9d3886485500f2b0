"""Written intermediate tables in the folder all executors share."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

# Bytes of rows that a Python worker is sent at a time. A batch is held as Arrow by the executor and the worker,
# and there as strings too, in every task that runs.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(operator):
    """``operator(df, ...)`` with rows sent to Python in batches of ``BATCH_BYTES``, as long as it runs.

    For operators that write what Python gives them before they return. Any batches give the same rows.
    """

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        conf = df.sparkSession.conf
        before = conf.get(_BATCH_CONF)
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
        try:
            return operator(df, *args, **kwargs)
        finally:
            conf.set(_BATCH_CONF, before)

    return run


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Marks a narrow table for broadcast once a count has shown that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
