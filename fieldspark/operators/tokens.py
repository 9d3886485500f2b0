"""Token tables: positions, boundaries, kept and removed lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as TM
from . import ranking


def token_boundaries(df: DataFrame, sample: str, modality_order: Sequence[str]) -> DataFrame:
    """Start and end of each modality in the token sequence of a sample.

    The running sum goes over at most one row per modality and sample.
    """
    index = F.array_position(F.array(*[F.lit(m) for m in modality_order]), F.col("modality")) - 1
    sizes = df.groupBy(sample, "modality").agg(F.count(F.lit(1)).alias("_t"))
    order = Window.partitionBy(sample).orderBy("modality_idx")
    end = F.sum("_t").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        sizes.withColumn("modality_idx", index.cast("int"))
        .withColumn("end_pos", end)
        .select(
            sample, "modality", "modality_idx", (F.col("end_pos") - F.col("_t")).alias("start_pos"), "end_pos"
        )
    )


def token_table(
    df: DataFrame,
    sample: str,
    ts: str,
    ties: Sequence[str],
    modality_order: Sequence[str],
    temporal: Sequence[str],
    heavy_rows: int | None = ranking.HEAVY_ROWS,
) -> DataFrame:
    """One row per token: contiguous modalities in the given order, time order inside."""
    names = F.array(*[F.lit(m) for m in modality_order])
    indexed = df.withColumn("modality_idx", (F.array_position(names, F.col("modality")) - 1).cast("int"))
    keys = [sample, "modality_idx"]
    if heavy_rows is None or ranking.heavy_groups(indexed, [sample], heavy_rows) is None:
        # both windows use the same exchange and the same sort
        order = [F.col(c) for c in (ts, *ties)]
        whole = Window.partitionBy(sample).orderBy("modality_idx", *order)
        placed = indexed.withColumns(
            {
                "token_pos": (F.row_number().over(whole) - 1).cast("bigint"),
                "_step": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1,
            }
        )
    else:
        ranked = ranking.series_rank(indexed, keys, ts, ties, heavy_rows).drop("_n")
        starts = token_boundaries(df, sample, modality_order).select(*keys, "start_pos")
        placed = (
            ranked.join(starts, keys)
            .withColumn("_step", F.col("_rank") - 1)
            .withColumn("token_pos", F.col("start_pos") + F.col("_step"))
            .drop("_rank", "start_pos")
        )
    is_temporal = F.col("modality").isin(list(temporal))
    return placed.withColumns(
        {
            "is_temporal": is_temporal,
            "week_idx": F.when(is_temporal, TM.week_index(F.col("_step"))).otherwise(F.lit(0)),
        }
    ).drop("_step")


def series_tokens(series: DataFrame, sample: str, variables: Sequence[str], length: int = 52) -> DataFrame:
    """Tokens of fixed-length series, one modality per variable; positions need no ranking."""
    names = F.array(*[F.lit(v) for v in variables])
    rows = series.unpivot([sample, "pos"], list(variables), "modality", "value")
    index = (F.array_position(names, F.col("modality")) - 1).cast("int")
    return rows.select(
        sample,
        "modality",
        index.alias("modality_idx"),
        (index * length + F.col("pos")).cast("bigint").alias("token_pos"),
        TM.week_index(F.col("pos")).alias("week_idx"),
        F.lit(True).alias("is_temporal"),
        "value",
    )


def mask_slots(
    masked: DataFrame, sample: str, heavy_rows: int = ranking.HEAVY_ROWS
) -> DataFrame:
    """Kept tokens first, masked tokens after them, each in token order, as long rows.

    ``slot`` counts from 0 inside the kept and inside the masked list of a sample.
    """
    ranked = ranking.position_in_group(
        masked, [sample, "masked"], "token_pos", heavy_rows=heavy_rows
    )
    return ranked.withColumn("slot", F.col("_rank") - 1).drop("_rank", "_n")


def mask_indices(masked: DataFrame, sample: str, max_tokens: int = 8192) -> DataFrame:
    """``kept`` and ``removed`` position arrays of every sample.

    For sequences a model can take in; a longer one is an error here and belongs to `mask_slots`.
    """
    lists = ranking.bounded_lists(
        masked, [sample], [F.col("token_pos")], ["token_pos", "masked"], max_tokens, "tokens"
    )
    pick = lambda keep: F.transform(
        F.filter("tokens", keep), lambda t: t["token_pos"]
    )
    return lists.select(
        sample,
        pick(lambda t: ~t["masked"]).alias("kept"),
        pick(lambda t: t["masked"]).alias("removed"),
    )


def restore_order(lists: DataFrame, sample: str, kept_values: Column, placeholder: Column) -> DataFrame:
    """Kept values and placeholders back at their token positions, as (sample, token_pos, value)."""
    pairs = F.arrays_zip(F.col("kept").alias("p"), kept_values.alias("v"))
    kept = lists.select(sample, F.explode(pairs).alias("t"))
    removed = lists.select(sample, F.explode("removed").alias("token_pos"))
    return kept.select(
        sample, F.col("t.p").alias("token_pos"), F.col("t.v").alias("value"), F.lit(False).alias("masked")
    ).unionByName(removed.withColumns({"value": placeholder, "masked": F.lit(True)}))


def restore_slots(slots: DataFrame, values: DataFrame, sample: str, placeholder: Column) -> DataFrame:
    """`restore_order` on the long rows of `mask_slots`, for sequences of any length.

    ``values`` has (sample, slot, value) of the kept tokens; (sample, token_pos, value, masked).
    """
    kept = values.select(sample, "slot", "value", F.lit(False).alias("masked"))
    joined = slots.select(sample, "token_pos", "masked", "slot").join(
        kept, [sample, "masked", "slot"], "left"
    )
    value = F.when(F.col("masked"), placeholder).otherwise(F.col("value"))
    return joined.select(sample, "token_pos", value.alias("value"), "masked")
