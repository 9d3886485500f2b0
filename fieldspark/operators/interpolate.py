"""Interpolation of ordered series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking


def _nearest(function: str, column: str, part: Sequence[str], order: str) -> Column:
    """Nearest non-NULL value strictly before (``lag``) or after (``lead``) a row."""
    by = ", ".join(f"`{c}`" for c in part)
    return F.expr(
        f"{function}(`{column}`, 1) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY `{order}`)"
    )


def _neighbours(
    df: DataFrame, part: Sequence[str], keys: Sequence[str], pos: str, names: Sequence[str]
) -> DataFrame:
    """Add ``<n>_prev`` and ``<n>_next``: nearest non-NULL ``n`` strictly before and after.

    ``part`` is ``keys``, or ``keys`` plus ``_seg`` when long series are cut into segments;
    then the values of the nearest other segments are carried in by a join on the segment.
    All windows share one sort.
    """
    sides = {"prev": ("lag", "last", "in"), "next": ("lead", "first", "out")}
    out = df.withColumns(
        {f"{n}_{s}": _nearest(fn, n, part, pos) for n in names for s, (fn, _, _) in sides.items()}
    )
    if list(part) == list(keys):
        return out
    ends = df.groupBy(*part).agg(
        *[F.min(n).alias(f"{n}_first") for n in names], *[F.max(n).alias(f"{n}_last") for n in names]
    )
    carried = ends.select(
        *part,
        *[
            _nearest(fn, f"{n}_{end}", keys, "_seg").alias(f"{n}_{carry}")
            for n in names
            for fn, end, carry in sides.values()
        ],
    )
    joined = ranking.join_groups(out, carried, list(part), "left")
    return joined.withColumns(
        {
            f"{n}_{s}": F.coalesce(f"{n}_{s}", f"{n}_{carry}")
            for n in names
            for s, (_, _, carry) in sides.items()
        }
    ).drop(*[f"{n}_{carry}" for n in names for _, _, carry in sides.values()])


def interpolate_linear(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    variables: Sequence[str],
    segment: int | None = None,
    min_points: int = 1,
) -> DataFrame:
    """Fill NULLs on the line through the nearest known points, extrapolating at both ends.

    Every known point carries the line to its successor (to its predecessor at the end of the
    series). An unknown step takes the line of the known point before it, else after it. One
    known point gives a constant, or nothing when ``min_points`` is 2. ``segment`` bounds the
    number of positions one task handles at a time.
    """
    keys = list(keys)
    part = keys if segment is None else [*keys, "_seg"]
    work = df if segment is None else df.withColumn("_seg", F.floor(F.col(pos) / F.lit(segment)))
    points = [f"_pt_{v}" for v in variables]
    # the position comes first in the structs, so min and max find the outermost point
    work = work.withColumns(
        {
            p: F.when(
                F.col(v).isNotNull(),
                F.struct(F.col(pos).cast("double").alias("p"), F.col(v).cast("double").alias("v")),
            )
            for p, v in zip(points, variables)
        }
    )
    work = _neighbours(work, part, keys, pos, points)
    lines = [f"_ln_{v}" for v in variables]
    work = work.withColumns(
        {
            ln: F.when(
                F.col(p).isNotNull(),
                F.struct(
                    F.col(p)["p"].alias("p"), F.col(p)["v"].alias("v"), _slope(p).alias("slope")
                ),
            )
            for ln, p in zip(lines, points)
        }
    ).drop(*points, *[f"{p}_prev" for p in points], *[f"{p}_next" for p in points])
    work = _neighbours(work, part, keys, pos, lines)
    filled = {}
    for v, ln in zip(variables, lines):
        line = F.coalesce(F.col(f"{ln}_prev"), F.col(f"{ln}_next"))
        slope = F.coalesce(line["slope"], F.lit(0.0) if min_points == 1 else F.lit(None))
        guess = line["v"] + (F.col(pos) - line["p"]) * slope
        filled[v] = F.coalesce(F.col(v).cast("double"), guess)
    return work.withColumns(filled).select(*df.columns)


def _slope(point: str) -> Column:
    here, nxt, prev = F.col(point), F.col(f"{point}_next"), F.col(f"{point}_prev")
    return F.coalesce(
        (nxt["v"] - here["v"]) / (nxt["p"] - here["p"]),
        (here["v"] - prev["v"]) / (here["p"] - prev["p"]),
    )


def interpolate_nodata(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    variables: Sequence[str],
    nodata: float = 0.0,
    segment: int | None = 65_536,
    heavy_rows: int | None = ranking.HEAVY_ROWS,
) -> DataFrame:
    """Replace no-data values by interpolation over the compacted valid positions of a key.

    Steps without any value are not positions. A variable with fewer than two known points is
    left as it is. Series are cut into segments only where some series is too long for one task.
    """
    present = df.where(F.coalesce(*[F.col(v) for v in variables]).isNotNull())
    if ranking.heavy_groups(present, keys, heavy_rows) is None:
        heavy_rows = segment = None
    ranked = ranking.series_rank(present, keys, ts, ties, heavy_rows).drop("_n")
    placed = ranked.withColumnRenamed("_rank", "pos").withColumns(
        {f"_raw_{v}": F.col(v) for v in variables}
    )
    known = placed.withColumns(
        {v: F.nullif(F.col(v).cast("double"), F.lit(float(nodata))) for v in variables}
    )
    done = interpolate_linear(known, keys, "pos", variables, segment, min_points=2)
    return done.withColumns(
        {v: F.coalesce(F.col(v), F.col(f"_raw_{v}").cast("double")) for v in variables}
    ).drop(*[f"_raw_{v}" for v in variables])


def _bends(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of many splines at once, a row each with its first ``n`` knots.

    The third derivative has no jump at the second and the last but one knot. With that the first and the
    last unknown drop out, and a banded elimination runs over the knots, for all rows together.
    """
    m, width = x.shape
    inner = np.arange(width)[None, :]
    h = np.where(inner[:, :-1] < n[:, None] - 1, np.diff(x), 1.0)
    slope = np.diff(y) / h
    first, last, rows = 1, n - 2, np.arange(m)
    upper, share = np.zeros((m, width)), np.zeros((m, width))
    for k in range(first, width - 1):
        before, after = h[:, k - 1], h[:, k]
        a, b, c = before.copy(), 2 * (before + after), after.copy()
        if k == first:
            b += before * (before + after) / after
            c -= before**2 / after
            a[:] = 0
        end = k == last
        b = np.where(end, b + after * (before + after) / before, b)
        a = np.where(end, a - after**2 / before, a)
        pivot = b - a * upper[:, k - 1]
        upper[:, k] = np.where(end, 0.0, c / pivot)
        share[:, k] = (6 * (slope[:, k] - slope[:, k - 1]) - a * share[:, k - 1]) / pivot
    bend = np.zeros((m, width))
    for k in range(width - 2, 0, -1):
        bend[:, k] = np.where(k <= last, share[:, k] - upper[:, k] * bend[:, k + 1] * (k < last), 0.0)
    outer = lambda one, two, near, far: ((near + far) * bend[rows, one] - near * bend[rows, two]) / far
    bend[:, 0] = outer(np.ones(m, int), np.full(m, 2), h[:, 0], h[:, 1])
    bend[rows, n - 1] = outer(n - 2, n - 3, h[rows, n - 2], h[rows, n - 3])
    return bend


def _cubic_fill(positions: pd.Series, values: pd.Series) -> pd.Series:
    """Every series of a batch filled at once; series are rows, padded to the longest."""
    lengths = np.array([len(p) for p in positions], dtype=int)
    width = max(int(lengths.max(initial=0)), 4)
    at, y = np.full((len(lengths), width), np.inf), np.full((len(lengths), width), np.nan)
    place = np.arange(width)[None, :] < lengths[:, None]
    if place.any():
        at[place] = np.concatenate([np.asarray(p, float) for p in positions])
        y[place] = np.concatenate([np.asarray(v, float) for v in values])
    known = ~np.isnan(y)
    n = known.sum(axis=1)
    # knots to the left of each row, in their order; behind them one after the other
    order = np.argsort(~known, axis=1, kind="stable")
    behind = np.arange(width)[None, :] >= n[:, None]
    knots = np.where(behind, 0.0, np.take_along_axis(at, order, axis=1))
    knots = np.where(behind, knots.max(axis=1, initial=0)[:, None] + 1 + np.arange(width), knots)
    heights = np.where(behind, 0.0, np.take_along_axis(y, order, axis=1))
    i = np.clip((known.cumsum(axis=1)) - 1, 0, np.maximum(n - 2, 0)[:, None])
    take = lambda table, k: np.take_along_axis(table, k, axis=1)
    x0, x1, y0, y1 = take(knots, i), take(knots, i + 1), take(heights, i), take(heights, i + 1)
    guess = np.where((n >= 2)[:, None], y0 + (at - x0) * (y1 - y0) / (x1 - x0), take(heights, np.zeros_like(i)))
    curved = n >= 4
    if curved.any():
        bend = np.zeros_like(heights)
        bend[curved] = _bends(knots[curved], heights[curved], n[curved])
        h, left, rest, c0, c1 = x1 - x0, at - x0, x1 - at, take(bend, i), take(bend, i + 1)
        curve = (c0 * rest**3 + c1 * left**3) / (6 * h) + (y0 / h - c0 * h / 6) * rest + (y1 / h - c1 * h / 6) * left
        guess = np.where(curved[:, None], curve, guess)
    guess = np.where(known, y, np.where((n > 0)[:, None], guess, np.nan))
    return pd.Series([row[:k] for row, k in zip(guess, lengths)])


def interpolate_cubic(
    df: DataFrame, keys: Sequence[str], pos: str, variables: Sequence[str], length: int = 52
) -> DataFrame:
    """Cubic fill of fixed-length series: spline from four known points on, else linear.

    A spline needs its whole series, so the ``length`` steps of a key are packed into arrays that
    a vectorised function fills. Longer series and repeated positions are an error.
    """
    keys = list(keys)
    fields = [c for c in df.columns if c not in keys]
    packed = ranking.bounded_lists(df, keys, [F.col(pos)], fields, length, "steps")
    at = F.transform("steps", lambda s: s[pos].cast("double"))
    repeated = F.raise_error(F.lit("repeated positions in a series"))
    at = F.when(F.size(F.array_distinct(at)) < F.size(at), repeated).otherwise(at)
    fill = F.pandas_udf(_cubic_fill, "array<double>")
    series = lambda v: F.transform("steps", lambda s: s[v].cast("double"))
    filled = packed.withColumn("_at", at).withColumns(
        {f"_f_{v}": fill("_at", series(v)) for v in variables}
    )
    arrays = ["steps", *[f"_f_{v}" for v in variables]]
    rows = filled.select(*keys, F.explode(F.arrays_zip(*arrays)).alias("r"))
    value = lambda c: (
        F.nullif(F.col("r")[f"_f_{c}"], F.lit(float("nan"))) if c in variables else F.col("r")["steps"][c]
    )
    return rows.select(*keys, *[value(c).alias(c) for c in fields]).select(*df.columns)
