"""Streaming jobs, run over the event table until it is consumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..streaming import ingest, weekly
from . import bindings as B
from .registry import query


@query(
    "r01_stream_ingest",
    "sample_idx:i modality:s variable:s value:f event_id:i error:s",
    """SELECT user_id AS sample_idx, 'events' AS modality, event_type AS variable, value, event_id,
              CASE WHEN event_type = 'error' THEN 'sensor error' END AS error FROM events""",
)
def stream_ingest(spark, d):
    """Events delivered twice, a group of users with all their time at a time, in several
    micro-batches: clean rows and dead letters, each once."""
    base = scratch_dir(spark, "ingest")
    raw = B.events(spark, d).select(
        "sample_idx",
        F.lit("events").alias("modality"),
        "ts",
        "variable",
        "value",
        "event_id",
        F.when(F.col("variable") == "error", F.lit("sensor error")).alias("error"),
        (F.col("sample_idx") % 3).alias("users"),
    )
    for copy in (1, 2):
        raw.repartition("users").write.partitionBy("users").mode("overwrite").parquet(f"{base}/in/copy={copy}")
    schema = raw.drop("users").schema
    ingest.stream_ingest(
        spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", schema, files_per_batch=2
    ).awaitTermination()
    clean = ingest.read_ingested(spark, f"{base}/out").withColumn("error", F.lit(None).cast("string"))
    return clean.unionByName(ingest.read_dead_letters(spark, f"{base}/out"))


@query(
    "r02_stream_weekly",
    "sample_idx:i variable:s week_end:d value:f",
    """SELECT sample_idx, variable,
              CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS week_end, avg(value) AS value
       FROM obs GROUP BY 1, 2, 3""",
    B.EVENTS,
)
def stream_weekly(spark, d):
    """The weekly means of events delivered in two runs of several micro-batches, in no order of time:
    every week is met again after it was stored, and after it was compacted."""
    base = scratch_dir(spark, "weekly")
    rows = B.table(spark, d, "events").select(
        F.col("user_id").alias("sample_idx"), "ts", F.col("event_type").alias("variable"), "value"
    )
    keys, schema = ["sample_idx", "variable"], rows.schema
    delivery = F.pmod(F.xxhash64("sample_idx", "ts"), F.lit(4))
    for run in (1, 0):
        part = rows.withColumn("delivery", delivery).where(F.col("delivery") % 2 == run)
        part.repartition("delivery").write.partitionBy("delivery").mode("append").parquet(f"{base}/in/run={run}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
        stream = source.parquet(f"{base}/in")
        weekly.merge_weekly(stream, f"{base}/out", f"{base}/checkpoint", keys, "ts", ["value"]).awaitTermination()
        if run:
            weekly.compact_weeks(spark, f"{base}/out", keys, ["value"])
    return weekly.read_weeks(spark, f"{base}/out", keys, ["value"])
