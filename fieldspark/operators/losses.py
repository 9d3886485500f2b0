"""Scores of prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions import vectors


def mean_pool(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of the vectors of a key as (keys, dim, mean) rows.

    Partial sums per (key, dim) combine before the exchange.
    """
    return (
        df.select(*keys, F.posexplode(vector).alias("dim", "_x"))
        .groupBy(*keys, "dim")
        .agg(F.avg(F.col("_x").cast("double")).alias("mean"))
    )


def masked_mse(
    prediction: DataFrame, target: DataFrame, mask: DataFrame, cell: Sequence[str], token: Sequence[str]
) -> DataFrame:
    """Mean squared error per modality over masked tokens with a present target.

    ``prediction`` and ``target`` hold one value per ``cell``, ``mask`` one flag per ``token``,
    whose columns are part of the cell. A modality without such a cell has no row.
    """
    hidden = mask.where(F.col("masked")).select(*token)
    truth = target.select(*cell, V.nan_to_null(F.col("value")).alias("_t")).where(
        F.col("_t").isNotNull()
    )
    pairs = prediction.join(truth, list(cell)).join(hidden, list(token), "left_semi")
    error = F.col("value") - F.col("_t")
    return pairs.groupBy("modality").agg(
        F.avg(error * error).alias("loss"), F.count(F.lit(1)).alias("cells")
    )


def cross_entropy(df: DataFrame, logits: str, label: str) -> DataFrame:
    """Mean cross-entropy of class logits over rows with a label."""
    z = F.col(logits)
    loss = vectors.logsumexp(z) - F.element_at(z, F.col(label) + 1)
    return df.where(F.col(label).isNotNull()).agg(
        F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("rows")
    )


def season_mse(
    df: DataFrame, pred_sos: str, pred_length: str, crop_class: str | None, calendar: str
) -> DataFrame:
    """Mean squared error of season start and length, both in years, over usable targets."""
    sos, length = V.season_target(F.col(crop_class) if crop_class else None, F.col(calendar))
    rows = df.withColumns({"_sos": sos, "_len": length}).where(F.col("_len").isNotNull())
    gap = lambda p, t: F.pow((F.col(p) - F.col(t)) / F.lit(365.0), 2)
    both = (gap(pred_sos, "_sos") + gap(pred_length, "_len")) / F.lit(2.0)
    return rows.agg(F.avg(both).alias("loss"), F.count(F.lit(1)).alias("rows"))


def combine_losses(losses: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One total of (type, name, loss) rows: the plain mean, or a weighted sum.

    A weight is looked up under ``type:name``, then under the type, else 1. A full-key weight
    of exactly 1 also gives way to the weight of the type.
    """
    if weights is None:
        return losses.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("total"))
    pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
    table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
    own = F.coalesce(
        F.try_element_at(table, F.concat_ws(":", "type", "name")), F.lit(1.0)
    )
    group = F.coalesce(F.try_element_at(table, F.col("type")), F.lit(1.0))
    weight = F.when(own == 1.0, group).otherwise(own)
    return losses.agg(F.coalesce(F.sum(weight * F.col("loss")), F.lit(0.0)).alias("total"))
