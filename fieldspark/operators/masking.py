"""Reproducible token masks with exact counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import ranking

# Weeks that stay visible under each pattern.
PATTERNS = {
    "monthly": [0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48],
    "first_half": list(range(26, 52)),
    "second_half": list(range(0, 26)),
}
STRATEGIES = ("random", "modality", "timesteps", "pattern")


def mask_random(
    tokens: DataFrame,
    sample: str,
    ratio: float = 0.75,
    seed: int = 42,
    heavy_rows: int | None = ranking.HEAVY_ROWS,
) -> DataFrame:
    """Mask exactly int(N·ratio) tokens of every sample."""
    hashed = tokens.withColumn("_h", V.seeded_hash(seed, F.col(sample), F.col("token_pos")))
    ranked = ranking.hash_rank(hashed, [sample], "_h", ["token_pos"], heavy_rows)
    target = F.floor(F.col("_n") * F.lit(ratio))
    return ranked.withColumn("masked", F.col("_rank") <= target).drop("_h", "_rank", "_n")


def masked_modalities(
    batch: Column, modalities: Sequence[str], ratio: float = 0.45, seed: int = 42
) -> Column:
    """The modalities masked in a batch, as an array.

    The modality list is fixed, so the choice is a plain expression of the batch number.
    """
    m = min(max(1, int(len(modalities) * ratio)), len(modalities) - 1)
    drawn = F.array_sort(
        F.array(
            *[
                F.struct(V.seeded_hash(seed, batch, F.lit(name)).alias("h"), F.lit(name).alias("m"))
                for name in modalities
            ]
        )
    )
    return F.transform(F.slice(drawn, 1, m), lambda s: s["m"]) if m else F.array().cast("array<string>")


def mask_modality(
    tokens: DataFrame, batch: str, modalities: Sequence[str], ratio: float = 0.45, seed: int = 42
) -> DataFrame:
    """Mask whole modalities, the same ones for every sample of a batch; one always stays."""
    chosen = masked_modalities(F.col(batch), modalities, ratio, seed)
    return tokens.withColumn("masked", F.array_contains(chosen, F.col("modality")))


def mask_timesteps(
    tokens: DataFrame,
    sample: str,
    ratio: float = 0.75,
    seed: int = 42,
    heavy_rows: int | None = ranking.HEAVY_ROWS,
) -> DataFrame:
    """Mask clamp(int(T·ratio), 1, T-1) steps of every modality; a single step stays."""
    hashed = tokens.withColumn("_h", V.seeded_hash(seed, F.col(sample), F.col("token_pos")))
    ranked = ranking.hash_rank(hashed, [sample, "modality"], "_h", ["token_pos"], heavy_rows)
    k = F.greatest(F.least(F.floor(F.col("_n") * F.lit(ratio)), F.col("_n") - 1), F.lit(1))
    masked = (F.col("_n") > 1) & (F.col("_rank") <= k)
    return ranked.withColumn("masked", masked).drop("_h", "_rank", "_n")


def mask_pattern(
    tokens: DataFrame, batch: str, patterns: Sequence[str] = ("monthly",), seed: int = 42
) -> DataFrame:
    """Mask the temporal tokens outside the weeks of the pattern drawn for the batch."""
    draw = V.hash_uniform(V.seeded_hash(seed, F.col(batch), F.lit("pattern")))
    pick = F.floor(draw * F.lit(len(patterns))).cast("int")
    name = F.element_at(F.array(*[F.lit(p) for p in patterns]), pick + 1)
    shown = F.lit(False)
    for p in dict.fromkeys(patterns):
        shown = shown | ((F.col("pattern") == p) & F.col("week_idx").isin(PATTERNS[p]))
    return tokens.withColumn("pattern", name).withColumn("masked", F.col("is_temporal") & ~shown)


def enforce_ratio(
    masked: DataFrame,
    sample: str,
    ratio: float = 0.75,
    seed: int = 42,
    heavy_rows: int | None = ranking.HEAVY_ROWS,
) -> DataFrame:
    """Top up or trim at random to exactly int(N·ratio) masked tokens per sample.

    Masked tokens rank before the others, so one ranking covers both directions.
    """
    digest = V.seeded_hash(seed, F.lit("ratio"), F.col(sample), F.col("token_pos"))
    # a leading 0 or 1 keeps "masked first" inside the digest order
    tagged = F.concat(F.when(F.col("masked"), F.lit("0")).otherwise(F.lit("1")), digest)
    ranked = ranking.hash_rank(
        masked.withColumn("_h", tagged), [sample], "_h", ["token_pos"], heavy_rows
    )
    target = F.floor(F.col("_n") * F.lit(ratio))
    return ranked.withColumn("masked", F.col("_rank") <= target).drop("_h", "_rank", "_n")


def choose_strategy(
    batch: Column,
    weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
    seed: int = 42,
    available: Sequence[str] = STRATEGIES,
) -> Column:
    """Strategy of a batch by normalised weights; one whose inputs are missing means random."""
    total = sum(weights)
    draw = V.hash_uniform(V.seeded_hash(seed, batch, F.lit("strategy")))
    edges, running = [], 0.0
    for w in weights:
        running += w / total
        edges.append(running)
    choice = F.lit("random")
    for name, edge in reversed(list(zip(STRATEGIES, edges))):
        effective = name if name in available else "random"
        choice = F.when(draw < F.lit(edge), F.lit(effective)).otherwise(choice)
    return choice


def structured_mask(
    tokens: DataFrame,
    sample: str,
    batch: str,
    modalities: Sequence[str],
    ratio: float = 0.75,
    modality_ratio: float = 0.45,
    timestep_ratio: float = 0.75,
    patterns: Sequence[str] = ("monthly",),
    weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
    seed: int = 42,
    heavy_rows: int | None = ranking.HEAVY_ROWS,
) -> DataFrame:
    """The strategy drawn for each batch, then the exact overall ratio.

    The random strategy needs no pass of its own: an empty mask topped up at random is one.
    Sample sizes are checked once for all rankings, which then share one exchange.
    """
    if heavy_rows is not None and ranking.heavy_groups(tokens, [sample], heavy_rows) is None:
        heavy_rows = None
    chosen = tokens.withColumn("strategy", choose_strategy(F.col(batch), weights, seed))
    steps = mask_timesteps(chosen, sample, timestep_ratio, seed, heavy_rows)
    steps = steps.withColumnRenamed("masked", "_steps")
    weeks = mask_pattern(steps, batch, patterns, seed).withColumnRenamed("masked", "_weeks")
    whole = mask_modality(weeks, batch, modalities, modality_ratio, seed)
    masked = (
        F.when(F.col("strategy") == "modality", F.col("masked"))
        .when(F.col("strategy") == "timesteps", F.col("_steps"))
        .when(F.col("strategy") == "pattern", F.col("_weeks"))
        .otherwise(F.lit(False))
    )
    merged = whole.withColumn("masked", masked).drop("_steps", "_weeks", "pattern")
    return enforce_ratio(merged, sample, ratio, seed, heavy_rows)
