"""Weekly aggregation over a stream.

``stream_weekly`` keeps open weeks in streaming state, up to a watermark. ``merge_weekly`` keeps none: each
micro-batch leaves the sums, counts and maxima of its weeks, which add up in any order, so that nothing is
late and a repeated delivery of a micro-batch replaces its own part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.time import week_end

# Fixed value: seven-day windows are anchored at a Thursday; four days later is a Monday.
MONDAY_OFFSET = "4 days"


def stream_weekly(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    variables: Sequence[str],
    agg: str = "mean",
    watermark: str = "14 days",
) -> DataFrame:
    """Running weekly mean or max per key; rows later than the watermark are dropped.

    In append mode a week appears once it is older than the watermark; complete or update mode
    shows it at once. State is one row per key and open week.
    """
    if agg not in ("mean", "max"):
        raise ValueError("a stream has mean and max; medians need the batch job")
    fn = F.max if agg == "max" else F.avg
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    value = lambda v: F.nullif(F.col(v).cast("double"), F.lit(float("nan")))
    weeks = timed.groupBy(*keys, F.window("_ts", "7 days", "7 days", MONDAY_OFFSET).alias("_w")).agg(
        *[fn(value(v)).alias(v) for v in variables]
    )
    return weeks.select(
        *keys, F.date_sub(F.to_date("_w.end"), 1).alias("week_end"), *variables
    )


def _merged(parts: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Parts of weeks added up: one row per key and week."""
    return parts.groupBy(*keys, "week_end").agg(
        *[F.sum(f"{v}_{kind}").alias(f"{v}_{kind}") for v in variables for kind in ("sum", "count")],
        *[F.max(f"{v}_max").alias(f"{v}_max") for v in variables],
    )


def write_week_parts(
    rows: DataFrame, batch: int, out_dir: str, keys: Sequence[str], ts: str, variables: Sequence[str]
) -> None:
    """The weeks of one micro-batch as sums, counts and maxima, under its number."""
    value = lambda v: F.nullif(F.col(v).cast("double"), F.lit(float("nan")))
    weeks = rows.withColumn("week_end", week_end(F.col(ts))).groupBy(*keys, "week_end")
    parts = weeks.agg(
        *[fn(value(v)).alias(f"{v}_{kind}") for v in variables for kind, fn in (("sum", F.sum), ("count", F.count))],
        *[F.max(value(v)).alias(f"{v}_max") for v in variables],
    )
    parts.write.mode("overwrite").parquet(f"{out_dir}/parts/batch_id={batch}")


def merge_weekly(
    stream: DataFrame, out_dir: str, checkpoint: str, keys: Sequence[str], ts: str, variables: Sequence[str]
) -> StreamingQuery:
    """Adds all rows not seen before to the stored weeks, then stops; the next run goes on from the checkpoint."""
    return (
        stream.writeStream.foreachBatch(lambda df, n: write_week_parts(df, n, out_dir, keys, ts, variables))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _upto(spark: SparkSession, out_dir: str) -> int:
    """The last micro-batch that is in the compacted table; -1 without one."""
    try:
        table = spark.read.parquet(f"{out_dir}/weeks")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    return table.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]


def _parts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The compacted weeks and the parts written since."""
    upto = _upto(spark, out_dir)
    since = spark.read.parquet(f"{out_dir}/parts").where(F.col("batch_id") > upto).drop("batch_id")
    if upto < 0:
        return since
    return spark.read.parquet(f"{out_dir}/weeks").where(F.col("upto") == upto).drop("upto").unionByName(since)


def read_weeks(
    spark: SparkSession, out_dir: str, keys: Sequence[str], variables: Sequence[str], agg: str = "mean"
) -> DataFrame:
    """(keys, week_end, variables): the weekly mean or max of everything delivered so far."""
    if agg not in ("mean", "max"):
        raise ValueError("stored weeks have mean and max; medians need the batch job")
    weeks = _merged(_parts(spark, out_dir), keys, variables)
    mean = lambda v: F.try_divide(f"{v}_sum", f"{v}_count")
    return weeks.select(*keys, "week_end", *[(mean(v) if agg == "mean" else F.col(f"{v}_max")).alias(v) for v in variables])


def compact_weeks(spark: SparkSession, out_dir: str, keys: Sequence[str], variables: Sequence[str]) -> None:
    """Folds all parts into one row per key and week.

    The folded table says up to which micro-batch it goes, and readers take the newest one and the parts after
    it: a run that is cut off changes nothing, and a part is never counted twice. Only to be run while
    the stream stands still, as a micro-batch that is not yet committed may be delivered again.
    """
    last = spark.read.parquet(f"{out_dir}/parts").agg(F.max("batch_id")).first()[0]
    if last is not None and last > _upto(spark, out_dir):
        _merged(_parts(spark, out_dir), keys, variables).write.mode("overwrite").parquet(f"{out_dir}/weeks/upto={last}")
