"""Normalisation statistics as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEAF = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("mean", "std", "min", "max")]
    + [T.StructField("count", T.LongType())]
)
_NESTED = T.MapType(T.StringType(), T.MapType(T.StringType(), _LEAF))


def write_stats(stats: DataFrame, path: str) -> None:
    """One JSON line per section: modality -> variable -> numbers.

    The input has one row per variable of the dataset, so the maps are small.
    """
    collected = lambda key, value: F.map_from_entries(
        F.collect_list(F.struct(key, value))
    )
    leaf = F.struct("mean", "std", "min", "max", "count").alias("s")
    variables = stats.select("section", "modality", "variable", leaf)
    modalities = variables.groupBy("section", "modality").agg(
        collected("variable", "s").alias("v")
    )
    sections = modalities.groupBy("section").agg(collected("modality", "v").alias("modalities"))
    lines = sections.select(F.to_json(F.struct("section", "modalities")).alias("value"))
    lines.write.mode("overwrite").text(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Back to one row per section, modality and variable."""
    schema = T.StructType(
        [T.StructField("section", T.StringType()), T.StructField("modalities", _NESTED)]
    )
    rows = spark.read.schema(schema).json(path)
    by_modality = rows.select("section", F.explode("modalities").alias("modality", "v"))
    by_variable = by_modality.select("section", "modality", F.explode("v").alias("variable", "s"))
    return by_variable.select("section", "modality", "variable", "s.*")
