"""Value cleaning, classification and name handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SOIL_DEPTHS


def nan_to_null(col: Column) -> Column:
    return F.nullif(col.cast("double"), F.lit(float("nan")))


def null_if_nodata(col: Column, nodata: float) -> Column:
    return F.nullif(nan_to_null(col), F.lit(float(nodata)))


def finite_or_zero(col: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(F.isnan(col) | (F.abs(col) == inf), F.lit(0.0)).otherwise(
        F.coalesce(col, F.lit(0.0))
    )


def clamp(col: Column, low: int, high: int, keep_null: bool = False) -> Column:
    """Bound ``col``; a missing code counts as ``low`` unless ``keep_null``."""
    bounded = F.greatest(F.least(col, F.lit(high)), F.lit(low))
    # greatest/least skip NULLs, so a NULL would silently become ``high`` without the guard
    return F.when(col.isNotNull(), bounded).otherwise(F.lit(None) if keep_null else F.lit(low))


def priority_class(*signals: Column) -> Column:
    """1-based index of the first signal above zero, 0 when there is none."""
    result = F.lit(0)
    for index, signal in reversed(list(enumerate(signals, start=1))):
        result = F.when(F.coalesce(signal, F.lit(0)) > 0, index).otherwise(result)
    return result


def slug(name: Column) -> Column:
    """Lower-case file-name form: blanks to ``_``, ``&`` to ``and``, no commas, quotes or dots."""
    spaced = F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))
    return F.translate(spaced, ",'.", "")


def strip_prefixes(key: Column) -> Column:
    return F.regexp_replace(key, r"^(model\.|module\.|_orig_mod\.)+", "")


def split_variable(name: Column, depths: Sequence[str] = SOIL_DEPTHS) -> tuple[Column, Column]:
    """``clay_0-5cm`` -> (``clay``, 0); an unknown depth gives index -1."""
    labels = F.array(*[F.lit(d) for d in depths])
    base = F.split_part(name, F.lit("_"), F.lit(1))
    index = F.array_position(labels, F.split_part(name, F.lit("_"), F.lit(2))) - 1
    return base, index.cast("int")


def band_name(variable: Column, depth: Column) -> Column:
    return F.concat_ws("_", variable, depth, F.lit("mean"))


def season_length(sos: Column, eos: Column, days: int = 365) -> Column:
    """Days from start to end of season, across the turn of the year when ``eos < sos``."""
    return F.when(eos >= sos, eos - sos).otherwise(F.lit(days) - sos + eos)


def season_target(crop_class: Column | None, calendar: Column) -> tuple[Column, Column]:
    """(start, length) from six calendar values, NULL where there is no usable pair.

    Classes 1, 2, 3 use the first, second and third pair. Without a class the first pair is
    used and all six values have to be present.
    """
    value = lambda i: F.element_at(calendar, i)
    if crop_class is None:
        complete = ~F.exists(calendar, lambda x: x.isNull())
        sos, eos = F.when(complete, value(1)), F.when(complete, value(2))
    else:
        sos = eos = F.lit(None).cast("double")
        for c in (1, 2, 3):
            sos = F.when(crop_class == c, value(2 * c - 1)).otherwise(sos)
            eos = F.when(crop_class == c, value(2 * c)).otherwise(eos)
        both = sos.isNotNull() & eos.isNotNull()
        sos, eos = F.when(both, sos), F.when(both, eos)
    return sos, F.when(eos.isNotNull(), season_length(sos, eos))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(x - mean, std)


def seeded_hash(seed: int, *parts: Column) -> Column:
    """Reproducible random order: md5 of the seed and the identifying columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_uniform(digest: Column) -> Column:
    """Uniform number in [0, 1) from the first eight hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
