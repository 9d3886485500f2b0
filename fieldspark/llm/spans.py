"""Positions of regular-expression matches, with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .storage import let

SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def running_starts(lengths: Column) -> Column:
    """For each place of an array the sum of all earlier values, in blocks of the root of its size."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths)))).cast("int")

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def starts(v: Column) -> Column:
        lens, k = v["lens"], v["k"]
        blocks = F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(lens) / k).cast("int")),
            lambda b: total(F.slice(lens, b * k + 1, k)),
        )
        return let(
            blocks,
            lambda sums: F.transform(
                lens,
                lambda _, i: total(F.slice(sums, 1, (i / k).cast("int")))
                + total(F.slice(lens, (i / k).cast("int") * k + 1, i % k)),
            ),
        )

    return let(F.struct(lengths.alias("lens"), size.alias("k")), starts)


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost non-overlapping matches with start and end in code points and the text around.

    ``guard`` is a cheap test that is true for every text with a match; others get an empty array.
    """

    def build(v: Column) -> Column:
        gaps, found = v["gaps"], v["found"]
        lengths = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("bigint"))
        return let(
            running_starts(lengths),
            lambda starts: F.transform(
                found,
                lambda m, i: let(
                    F.get(starts, i) + F.length(F.get(gaps, i)),
                    lambda s: F.struct(
                        s.alias("start"),
                        (s + F.length(m)).alias("end"),
                        m.alias("value"),
                        F.get(gaps, i).alias("before"),
                        F.get(gaps, i + 1).alias("after"),
                    ),
                ),
            ),
        )

    both = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
    )
    return F.when(guard, let(both, build)).otherwise(F.array().cast(SPAN))


def labelled(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def of_kind(spans: Column, kind: str, rank: int, keep) -> Column:
    """The spans that pass ``keep(value)``, as (start, rank, end, kind, value)."""
    return F.transform(
        F.filter(spans, lambda s: keep(s["value"])),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            s["value"].alias("value"),
        ),
    )


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
