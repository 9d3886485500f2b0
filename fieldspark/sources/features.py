"""Point and polygon features as GeoJSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import POINT_FEATURE, POLYGON_FEATURE


def read_features(spark: SparkSession, path: str, collection: bool = False) -> DataFrame:
    """Point features as (id, lon, lat, properties).

    The default layout is one feature per line, which splits at any size. ``collection`` reads
    FeatureCollection documents; each document is parsed as a whole, so large inputs should come
    as many documents or as lines.
    """
    if collection:
        document = T.StructType([T.StructField("features", T.ArrayType(POINT_FEATURE))])
        rows = spark.read.schema(document).json(path, multiLine=True)
        rows = rows.select(F.explode("features").alias("f")).select("f.*")
    else:
        rows = spark.read.schema(POINT_FEATURE).json(path)
    return rows.select(
        "id",
        F.col("geometry.coordinates")[0].alias("lon"),
        F.col("geometry.coordinates")[1].alias("lat"),
        "properties",
    )


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygon and MultiPolygon features, one per line, as (id, ring, parts, properties).

    ``parts`` has every polygon with all its rings, the outer one first; ``ring`` is the first
    part's outer ring. Features of other types have neither.
    """
    rows = spark.read.schema(POLYGON_FEATURE).json(path)
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    polygon = "array<array<array<double>>>"
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, polygon))).when(
        kind == "MultiPolygon", F.from_json(text, f"array<{polygon}>")
    )
    # a ring closes by repeating its first vertex; the geometry functions close it themselves
    vertex = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    open_ring = lambda r: F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), vertex)
    rows = rows.withColumn("parts", F.transform(parts, lambda rings: F.transform(rings, open_ring)))
    return rows.select("id", F.get(F.get("parts", F.lit(0)), F.lit(0)).alias("ring"), "parts", "properties")


def _write(df: DataFrame, path: str, kind: str, coordinates: Column, properties: Sequence[str]) -> None:
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.col("id").cast("string").alias("id"),
        F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def write_features(df: DataFrame, path: str, properties: Sequence[str]) -> None:
    """Points (id, lon, lat, properties..) as one feature per line, one file per partition."""
    _write(df, path, "Point", F.array("lon", "lat"), properties)


def write_polygons(df: DataFrame, path: str, properties: Sequence[str]) -> None:
    """Polygons (id, ring, properties..), or (id, parts, properties..) as MultiPolygons, with their
    rings closed."""

    def closed(ring: Column) -> Column:
        return F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["x"], p["y"]))

    if "parts" in df.columns:
        shapes = F.transform("parts", lambda rings: F.transform(rings, closed))
        _write(df, path, "MultiPolygon", shapes, properties)
    else:
        _write(df, path, "Polygon", F.array(closed(F.col("ring"))), properties)
