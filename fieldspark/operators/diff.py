"""Comparison of two keyed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def normalise_keys(df: DataFrame, key: str) -> DataFrame:
    """Strip wrapper prefixes; of keys that collide the longest spelling stays."""
    spelled = df.withColumn("_k", V.strip_prefixes(F.col(key)))
    rest = [c for c in df.columns if c != key]
    best = spelled.groupBy("_k").agg(
        F.max_by(F.struct(*rest), F.struct(F.length(key), F.col(key))).alias("_r")
    )
    return best.select(F.col("_k").alias(key), "_r.*")


def snapshot_diff(
    a: DataFrame, b: DataFrame, key: str, value: str, dtype: str | None = None
) -> DataFrame:
    """One row per key that differs.

    Kinds: only_a, only_b, shape_mismatch, type_mismatch and value_mismatch; the last with the
    greatest absolute difference. ``value`` holds ARRAY<DOUBLE>, ``dtype`` an optional type name.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        d = F.col(dtype) if dtype else F.lit("double")
        return df.select(
            key, F.col(value).alias(f"v_{s}"), d.alias(f"t_{s}"), F.lit(True).alias(f"in_{s}")
        )

    both = side(a, "a").join(side(b, "b"), key, "full_outer")
    gap = F.array_max(F.zip_with("v_a", "v_b", lambda x, y: F.abs(x - y)))
    kind = (
        F.when(F.col("in_b").isNull(), "only_a")
        .when(F.col("in_a").isNull(), "only_b")
        .when(F.size("v_a") != F.size("v_b"), "shape_mismatch")
        .when(F.col("t_a") != F.col("t_b"), "type_mismatch")
        .when(~F.col("v_a").eqNullSafe(F.col("v_b")), "value_mismatch")
    )
    return (
        both.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            key,
            "kind",
            F.when(F.col("kind") == "value_mismatch", gap).alias("max_abs_diff"),
        )
    )


def preview(diff: DataFrame, key: str, n: int = 25) -> DataFrame:
    """The first ``n`` differences by key."""
    return diff.orderBy(key).limit(n)
