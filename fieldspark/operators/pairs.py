"""Pairwise terms within a batch, computed block by block without listing pairs.

The rows of a batch are cut into tiles of bounded size. Each pair of tiles is one Spark group
whose similarity block is a small matrix product, and only per-row or per-block sums leave it.
An ordinary batch is a single tile; a batch of any size becomes many tile pairs that run in
parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking

TILE_ROWS = 2048


def _tile_pairs(df: DataFrame, batch: str, row: str, tile_rows: int) -> tuple[DataFrame, bool]:
    """Every row once per tile pair of its batch it belongs to: ``_t`` own, ``_p <= _q`` pair.

    The flag tells that all batches are single tiles, so that partial sums are final.
    """
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > tile_rows).select(
        batch, F.ceil(F.col("_n") / F.lit(tile_rows)).cast("int").alias("_tiles")
    )
    if large.isEmpty():
        zero = F.lit(0)
        return df.withColumns({"_t": zero, "_p": zero, "_q": zero}), True
    known = df.join(ranking.small_table(large), batch, "left").withColumn(
        "_tiles", F.coalesce("_tiles", F.lit(1))
    )
    own = F.pmod(F.xxhash64(row), F.col("_tiles")).cast("int")
    tiles = (
        known.withColumn("_t", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .withColumns({"_p": F.least("_t", "_other"), "_q": F.greatest("_t", "_other")})
        .drop("_tiles", "_other")
    )
    return tiles, False


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, one coordinate at a time: no cancellation for near-equal rows."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        total += (a[:, k][:, None] - b[:, k][None, :]) ** 2
    return np.sqrt(total)


def _sides(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The two tiles of a pair, in a fixed row order, and whether they are the same tile."""
    p, q = group["_p"].iloc[0], group["_q"].iloc[0]
    return group[group["_t"] == p], group[group["_t"] == q], p == q


def _per_row(
    tiles: DataFrame,
    batch: str,
    row: str,
    terms: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], dict[str, np.ndarray]],
    fields: dict[str, str],
) -> DataFrame:
    """Run ``terms(a, b, other)`` for both directions of every tile pair.

    ``other`` marks the cells that are a real pair; the result has one value per row of ``a``.
    """
    row_type = tiles.schema[row].dataType.simpleString()
    batch_type = tiles.schema[batch].dataType.simpleString()
    schema = f"{batch} {batch_type}, {row} {row_type}, " + ", ".join(
        f"{n} {t}" for n, t in fields.items()
    )

    def block(group: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(group)
        out = []
        for left, right in [(a, b)] if same else [(a, b), (b, a)]:
            if len(left) == 0 or len(right) == 0:
                continue
            other = ~np.eye(len(left), dtype=bool) if same else np.ones((len(left), len(right)), bool)
            out.append(
                pd.DataFrame(
                    {batch: left[batch].to_numpy(), row: left[row].to_numpy(), **terms(left, right, other)}
                )
            )
        columns = [batch, row, *fields]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return tiles.groupBy(batch, "_p", "_q").applyInPandas(block, schema)


def pair_summary(
    df: DataFrame, batch: str, row: str, vector: str, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Per row over its batch partners: their number, mean and greatest cosine, distance sums.

    ``upper_pairs`` and ``upper_distance`` cover only partners with a greater row id, so their
    totals are those of the upper triangle. A row alone in its batch has no partners.
    """
    tiles, single = _tile_pairs(
        df.select(batch, row, F.col(vector).alias("_z")), batch, row, tile_rows
    )

    def terms(a: pd.DataFrame, b: pd.DataFrame, other: np.ndarray) -> dict[str, np.ndarray]:
        za, zb = _matrix(a["_z"]), _matrix(b["_z"])
        sim = _unit(za) @ _unit(zb).T
        dist = _distance(za, zb)
        upper = other & (a[row].to_numpy()[:, None] < b[row].to_numpy()[None, :])
        return {
            "partners": other.sum(axis=1),
            "sim_sum": np.where(other, sim, 0).sum(axis=1),
            "sim_max": np.where(other, sim, -np.inf).max(axis=1),
            "dist_sum": np.where(other, dist, 0).sum(axis=1),
            "dist_min": np.where(other, dist, np.inf).min(axis=1),
            "upper_pairs": upper.sum(axis=1),
            "upper_distance": np.where(upper, dist, 0).sum(axis=1),
        }

    parts = _per_row(
        tiles,
        batch,
        row,
        terms,
        {
            "partners": "bigint",
            "sim_sum": "double",
            "sim_max": "double",
            "dist_sum": "double",
            "dist_min": "double",
            "upper_pairs": "bigint",
            "upper_distance": "double",
        },
    )
    merged = parts
    if not single:
        total = ["partners", "sim_sum", "dist_sum", "upper_pairs", "upper_distance"]
        merged = parts.groupBy(batch, row).agg(
            *[F.sum(c).alias(c) for c in total],
            F.max("sim_max").alias("sim_max"),
            F.min("dist_min").alias("dist_min"),
        )
    paired = F.col("partners") > 0
    return merged.select(
        batch,
        row,
        "partners",
        F.try_divide("sim_sum", "partners").alias("mean_cosine"),
        F.when(paired, F.col("sim_max")).alias("max_cosine"),
        F.col("dist_sum").alias("distance_sum"),
        F.when(paired, F.col("dist_min")).alias("min_distance"),
        "upper_pairs",
        "upper_distance",
    )


def contrastive_loss(
    df: DataFrame,
    batch: str,
    row: str,
    vector: str,
    label: str,
    temperature: float = 0.07,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Supervised contrastive loss per batch.

    Partners with the same label above zero are positives. A row's loss is the mean over its
    positives of -log(p + 1e-8), p being the softmax share of the cosine over the temperature;
    a batch's loss is the mean over rows with a positive. A batch without any has no row.
    Rows without a label take no part. Where a batch has several tiles, the softmax sums need a
    pass of their own.
    """
    valid = df.where(F.col(label).isNotNull()).select(
        batch, row, F.col(vector).alias("_z"), F.col(label).cast("int").alias("_y")
    )
    tiles, single = _tile_pairs(valid, batch, row, tile_rows)

    def weight(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        return np.exp(_unit(_matrix(a["_z"])) @ _unit(_matrix(b["_z"])).T / temperature)

    def score(
        a: pd.DataFrame, b: pd.DataFrame, other: np.ndarray, w: np.ndarray, den: np.ndarray
    ) -> dict[str, np.ndarray]:
        ya, yb = a["_y"].to_numpy()[:, None], b["_y"].to_numpy()[None, :]
        positive = other & (ya == yb) & (ya > 0)
        p = w / np.maximum(den, 1e-8)[:, None]
        return {
            "_loss": np.where(positive, -np.log(p + 1e-8), 0).sum(axis=1),
            "_pos": positive.sum(axis=1),
        }

    def at_once(a: pd.DataFrame, b: pd.DataFrame, other: np.ndarray) -> dict[str, np.ndarray]:
        w = weight(a, b)
        return score(a, b, other, w, np.where(other, w, 0).sum(axis=1))

    def totals(a: pd.DataFrame, b: pd.DataFrame, other: np.ndarray) -> dict[str, np.ndarray]:
        return {"_part": np.where(other, weight(a, b), 0).sum(axis=1)}

    def given(a: pd.DataFrame, b: pd.DataFrame, other: np.ndarray) -> dict[str, np.ndarray]:
        return score(a, b, other, weight(a, b), a["_den"].to_numpy())

    fields = {"_loss": "double", "_pos": "bigint"}
    if single:
        rows = _per_row(tiles, batch, row, at_once, fields)
    else:
        sums = _per_row(tiles, batch, row, totals, {"_part": "double"})
        share = sums.groupBy(batch, row).agg(F.sum("_part").alias("_den"))
        scored, _ = _tile_pairs(valid.join(share, [batch, row]), batch, row, tile_rows)
        parts = _per_row(scored, batch, row, given, fields)
        rows = parts.groupBy(batch, row).agg(*[F.sum(f).alias(f) for f in fields])
    return (
        rows.where(F.col("_pos") > 0)
        .groupBy(batch)
        .agg(F.avg(F.col("_loss") / F.col("_pos")).alias("loss"), F.count(F.lit(1)).alias("rows"))
    )


def eam_loss(
    df: DataFrame,
    batch: str,
    row: str,
    vector: str,
    reference: str,
    label: str,
    tau: float = 1.0,
    margin: float = 1.0,
    weight: float = 1.0,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Environment-aligned distance loss per batch: align, shatter and their weighted sum.

    Over unordered pairs of unit vectors: the squared gap between distance and scaled reference
    distance for equal labels above zero, and the hinge of the distance for different labels.
    A term without pairs is 0. Unlabelled rows form no pair.
    """
    tiles, _ = _tile_pairs(
        df.select(
            batch,
            row,
            F.col(vector).alias("_z"),
            F.col(reference).alias("_s"),
            F.col(label).cast("int").alias("_y"),
        ),
        batch,
        row,
        tile_rows,
    )
    batch_type = df.schema[batch].dataType.simpleString()
    fields = ["_align", "_n_align", "_shatter", "_n_shatter"]
    schema = f"{batch} {batch_type}, _align double, _n_align bigint, _shatter double, _n_shatter bigint"

    def block(group: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(group)
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame(columns=[batch, *fields])
        dz = _distance(_unit(_matrix(a["_z"])), _unit(_matrix(b["_z"])))
        ds = _distance(_unit(_matrix(a["_s"])), _unit(_matrix(b["_s"])))
        ya = a["_y"].to_numpy(dtype=float)[:, None]
        yb = b["_y"].to_numpy(dtype=float)[None, :]
        pair = ~np.isnan(ya) & ~np.isnan(yb)
        if same:
            pair &= np.triu(np.ones(dz.shape, bool), 1)
        align = pair & (ya == yb) & (ya > 0)
        shatter = pair & (ya != yb)
        return pd.DataFrame(
            {
                batch: [group[batch].iloc[0]],
                "_align": [((dz - tau * ds)[align] ** 2).sum()],
                "_n_align": [int(align.sum())],
                "_shatter": [np.maximum(margin - dz[shatter], 0).sum()],
                "_n_shatter": [int(shatter.sum())],
            }
        )

    parts = tiles.groupBy(batch, "_p", "_q").applyInPandas(block, schema)
    mean = lambda s, n: F.coalesce(F.try_divide(F.sum(s), F.sum(n)), F.lit(0.0))
    return (
        parts.groupBy(batch)
        .agg(mean("_align", "_n_align").alias("align"), mean("_shatter", "_n_shatter").alias("shatter"))
        .withColumn("loss", F.col("align") + F.lit(weight) * F.col("shatter"))
    )


def collapse_metrics(
    df: DataFrame, batch: str, row: str, vector: str, dim: int, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Per batch: mean sample std over dimensions, mean norm, mean greatest partner cosine.

    Batches of fewer than two rows are left out.
    """
    z = F.col(vector).cast("array<double>")
    squares = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + x * x)
    spread = df.groupBy(batch).agg(
        F.array(*[F.stddev_samp(z[i]) for i in range(dim)]).alias("_std"),
        F.avg(F.sqrt(squares)).alias("repr_norm"),
        F.count(F.lit(1)).alias("_n"),
    )
    std = F.aggregate("_std", F.lit(0.0), lambda acc, x: acc + x) / F.lit(dim)
    top = pair_summary(df, batch, row, vector, tile_rows).groupBy(batch).agg(
        F.avg("max_cosine").alias("max_offdiag_cosine")
    )
    return (
        spread.where(F.col("_n") >= 2)
        .select(batch, std.alias("repr_std"), "repr_norm")
        .join(top, batch)
    )
