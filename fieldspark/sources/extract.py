"""Modality extractors: functions from points to long observations, registered by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[DataFrame], DataFrame]
PointFunction = Callable[[Any], Iterable[tuple]]
COLUMNS = ("sample_idx", "ts", "variable", "value", "error")
_ROW_SCHEMA = "sample_idx bigint, ts timestamp_ntz, variable string, value double, error string"
_REGISTRY: dict[str, Extractor] = {}


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    """Register a DataFrame function that handles all points at once.

    It returns (sample_idx, ts, variable, value) and may add ``error``.
    """

    def register(fn: Extractor) -> Extractor:
        _REGISTRY[name] = fn
        return fn

    return register


def point_extractor(name: str) -> Callable[[PointFunction], Extractor]:
    """Register outside code that handles one point at a time.

    It gets the point as a named tuple and returns (ts, variable, value) triples. Spark spreads
    the points; a point whose call fails becomes one ``error`` row and the others go on.
    """

    def register(fn: PointFunction) -> Extractor:
        def rows_of(point: Any) -> list[tuple]:
            try:
                return [(point.sample_idx, *row, None) for row in fn(point)]
            except Exception as error:
                return [(point.sample_idx, None, None, None, f"{type(error).__name__}: {error}")]

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for points in parts:
                rows = [row for p in points.itertuples(index=False) for row in rows_of(p)]
                frame = pd.DataFrame(rows, columns=list(COLUMNS))
                frame["ts"] = pd.to_datetime(frame["ts"])
                yield frame.astype({"value": "float64"})

        def run(points: DataFrame) -> DataFrame:
            return points.mapInPandas(batches, _ROW_SCHEMA)

        _REGISTRY[name] = run
        return run

    return register


def registered() -> list[str]:
    return sorted(_REGISTRY)


def run_extractors(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long rows of all named modalities, errors included; an unknown name is an error."""
    unknown = [n for n in names if n not in _REGISTRY]
    if unknown:
        raise KeyError(f"unknown modalities: {unknown}")
    parts = []
    for name in names:
        rows = _REGISTRY[name](points)
        if "error" not in rows.columns:
            rows = rows.withColumn("error", F.lit(None).cast("string"))
        parts.append(rows.select(F.lit(name).alias("modality"), *COLUMNS))
    return reduce(lambda a, b: a.unionByName(b), parts)


def observations(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNull()).drop("error")
