"""Model-input records: one row per sample with a struct per modality."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time as TM
from ..functions import values as V
from . import filters, joins, ranking, temporal

# Modalities whose missing inputs become 0; elsewhere they stay missing.
FILLED = ("sentinel2", "soil")


@dataclass(frozen=True)
class Source:
    """A modality table and the variables a model reads, in order."""

    table: DataFrame
    variables: Sequence[str]


def scaler(stats: DataFrame, modality: str) -> dict[str, tuple[float, float]]:
    """Mean and std per variable of one modality; one row per variable is read."""
    rows = stats.where(F.col("modality") == modality).select("variable", "mean", "std").collect()
    return {r["variable"]: (r["mean"], r["std"]) for r in rows}


def _prepared(
    name: str, source: Source, stats: DataFrame, keep: Sequence[str], filled: Sequence[str]
) -> DataFrame:
    """Chosen variables, normalised; one without statistics uses mean 0 and std 1."""
    chosen = filters.select_variables(source.table, source.variables, keep)
    known = scaler(stats, name)

    def scaled(v: str):
        mean, std = known.get(v, (0.0, 1.0))
        z = V.zscore(F.col(v).cast("double"), F.lit(mean), F.lit(std))
        return V.finite_or_zero(z) if name in filled else z

    return chosen.withColumns({v: scaled(v) for v in source.variables})


def temporal_input(
    name: str,
    source: Source,
    stats: DataFrame,
    key: str = "sample_idx",
    length: int = temporal.WEEKS,
    filled: Sequence[str] = FILLED,
) -> DataFrame:
    """(key, steps) with ``length`` steps of (week_idx, valid, data) in position order."""
    rows = _prepared(name, source, stats, [key, "pos", "valid"], filled)
    steps = rows.select(
        key,
        "pos",
        TM.week_index(F.col("pos")).alias("week_idx"),
        "valid",
        F.array(*source.variables).alias("data"),
    )
    return ranking.bounded_lists(
        steps, [key], [F.col("pos")], ["week_idx", "valid", "data"], length, "steps"
    )


def static_input(
    name: str, source: Source, stats: DataFrame, key: str = "sample_idx", filled: Sequence[str] = FILLED
) -> DataFrame:
    """(key, data) with one value per variable."""
    rows = _prepared(name, source, stats, [key], filled)
    return rows.select(key, F.array(*source.variables).alias("data"))


def model_inputs(
    samples: DataFrame,
    series: dict[str, Source],
    static: dict[str, Source],
    classes: dict[str, DataFrame],
    stats: DataFrame,
    key: str = "sample_idx",
    filled: Sequence[str] = FILLED,
) -> DataFrame:
    """The training record of every sample.

    ``series`` are cleaned 52-step tables, ``static`` numeric tables, both normalised by ``stats``;
    ``classes`` are taken as they are. Every modality is one row per sample before the joins.
    """
    sides = {n: temporal_input(n, s, stats, key, filled=filled) for n, s in series.items()}
    sides |= {n: static_input(n, s, stats, key, filled) for n, s in static.items()}
    return joins.assemble(samples, sides | classes, key)
