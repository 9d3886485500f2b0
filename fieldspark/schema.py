"""Logical table schemas and the modality catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FEATURE_PROPERTIES = T.StructType(
    [
        T.StructField("grid_id", T.IntegerType()),
        T.StructField("country", T.StringType()),
        T.StructField("continent", T.StringType()),
        T.StructField("classification", T.IntegerType()),
        T.StructField("tempCropArea", T.DoubleType()),
        T.StructField("cellArea", T.DoubleType()),
    ]
)

POINT_FEATURE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField(
            "geometry",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("coordinates", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
        T.StructField("properties", FEATURE_PROPERTIES),
    ]
)

POLYGON_FEATURE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField(
            "geometry",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    # as text: its depth depends on the type
                    T.StructField("coordinates", T.StringType()),
                ]
            ),
        ),
        T.StructField("properties", FEATURE_PROPERTIES),
    ]
)

OBSERVATIONS = T.StructType(
    [
        T.StructField("sample_idx", T.LongType(), False),
        T.StructField("modality", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("variable", T.StringType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)

NORM_STATS = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("count", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Modality:
    name: str
    temporal: bool
    max_time: int
    resolution_m: float | None
    variables: tuple[str, ...]
    nodata: float | None = None


# Names, variables, series lengths and sampling resolutions of the data model.
MODALITIES = {
    m.name: m
    for m in (
        Modality(
            "agera5",
            True,
            365,
            10_000.0,
            (
                "Precipitation_Flux",
                "Vapour_Pressure_Mean_24h",
                "Temperature_Air_2m_Max_24h",
                "Temperature_Air_2m_Min_24h",
                "Temperature_Air_2m_Mean_24h",
                "Solar_Radiation_Flux",
                "Wind_Speed_10m_Mean_24h",
                "Derived_Relative_Humidity_2m_Max_24h",
            ),
        ),
        Modality("sentinel1", True, 200, 10.0, ("VV", "VH", "angle")),
        Modality(
            "sentinel2",
            True,
            100,
            10.0,
            (
                "B1",
                "B2",
                "B3",
                "B4",
                "B5",
                "B6",
                "B7",
                "B8",
                "B8A",
                "B9",
                "B11",
                "B12",
                "SCL",
                "MSK_CLDPRB",
                "QA60",
            ),
            0.0,
        ),
        Modality("fapar", True, 110, 5_566.0, ("FAPAR", "LAI")),
        Modality("soil", False, 1, 250.0, ("clay", "nitrogen", "phh2o", "soc")),
        Modality("elevation", False, 1, 10.0, ("elevation", "slope")),
        Modality("worldcereal_cropmask", False, 1, 10.0, ("aez_id", "crop_mask")),
        Modality(
            "worldcereal_cropcalendar",
            False,
            1,
            None,
            (
                "maize_sos",
                "maize_eos",
                "winter_sos",
                "winter_eos",
                "spring_sos",
                "spring_eos",
            ),
        ),
        Modality("landcover", False, 1, 10.0, ("Map",)),
        Modality("alphaearth", False, 1, 1_000.0, tuple(f"A{i:02d}" for i in range(64))),
    )
}

SOIL_DEPTHS = ("0-5cm", "5-15cm", "15-30cm")


def modality_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a table, one row per modality."""
    return spark.createDataFrame(
        [
            (m.name, m.temporal, m.max_time, m.resolution_m, list(m.variables), m.nodata)
            for m in MODALITIES.values()
        ],
        "name string, temporal boolean, max_time int, resolution_m double, "
        "variables array<string>, nodata double",
    )
