"""Properties that hold for any input."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldspark.operators import filters, interpolate, masking, sampling, temporal

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))

observations = st.lists(
    st.tuples(
        st.integers(0, 3),
        st.datetimes(dt.datetime(2020, 12, 20), dt.datetime(2023, 1, 20)),
        st.one_of(st.none(), st.just(float("nan")), st.floats(-1e6, 1e6)),
    ),
    min_size=1,
    max_size=60,
)


def frame(spark, rows):
    return spark.createDataFrame(
        [(k, ts, v, i) for i, (k, ts, v) in enumerate(rows)], "k int, ts timestamp_ntz, v double, i int"
    )


@FEW
@given(rows=observations)
def test_series_are_complete_and_stable(spark, rows):
    df = frame(spark, rows)
    clean = temporal.clean_series(df, ["k"], "ts", ["v"]).collect()
    by_key = {}
    for r in clean:
        by_key.setdefault(r["k"], []).append(r)
    assert set(by_key) == {k for k, _, _ in rows}
    for series in by_key.values():
        assert sorted(r["pos"] for r in series) == list(range(52))
        ends = [r["week_end"] for r in sorted(series, key=lambda r: r["pos"]) if r["week_end"]]
        assert all((b - a).days == 7 for a, b in zip(ends, ends[1:]))
        assert all(r["valid"] == (r["v"] is not None) for r in series)

    weekly = temporal.weekly_resample(df, ["k"], "ts", ["v"])
    again = temporal.weekly_resample(weekly, ["k"], "week_end", ["v"])
    key = lambda r: (r["k"], r["week_end"])
    first = {key(r): r["v"] for r in weekly.collect()}
    assert {key(r): r["v"] for r in again.collect()} == first


@FEW
@given(rows=observations)
def test_weekly_mean_matches_pandas(spark, rows):
    import pandas as pd

    df = frame(spark, rows)
    got = {
        (r["k"], r["week_end"]): r["v"]
        for r in temporal.weekly_resample(df, ["k"], "ts", ["v"]).collect()
        if r["v"] is not None
    }
    table = pd.DataFrame(rows, columns=["k", "ts", "v"]).astype({"v": float})
    expected = {}
    for k, part in table.groupby("k"):
        weeks = part.set_index("ts")["v"].resample("W").mean().dropna()
        expected |= {(k, t.date()): v for t, v in weeks.items()}
    assert got.keys() == expected.keys()
    assert all(got[w] == pytest.approx(expected[w], abs=1e-6) for w in got)


@FEW
@given(rows=observations)
def test_pack_then_unpack(spark, rows):
    df = frame(spark, rows)
    packed = filters.pack(df, ["k"], "ts", ["i"], ["v"], 60)
    assert all(len(r["steps"]) == 60 for r in packed.collect())
    back = filters.unpack(packed, ["k"], ["v"])
    valid = filters.trim_valid(back).collect()
    trimmed = packed.select("k", F.size(filters.trim_valid_packed(F.col("steps"))).alias("n")).collect()
    plain = lambda v: None if v is None or v != v else v
    given_ = sorted(((k, str(ts.date()), plain(v)) for k, ts, v in rows), key=str)
    assert sorted(((r["k"], r["timestamp"], r["v"]) for r in valid), key=str) == given_
    assert sum(r["n"] for r in trimmed) == len(rows)


@FEW
@given(
    slope=st.floats(-100, 100),
    start=st.floats(-100, 100),
    known=st.sets(st.integers(0, 51), min_size=2, max_size=52),
)
def test_interpolation_reproduces_a_line(spark, slope, start, known):
    rows = [(1, p, start + slope * p if p in known else None) for p in range(52)]
    df = spark.createDataFrame(rows, "k int, pos int, v double")
    for fill in (interpolate.interpolate_linear, interpolate.interpolate_cubic):
        got = np.array([r["v"] for r in fill(df, ["k"], "pos", ["v"]).orderBy("pos").collect()])
        assert got == pytest.approx(start + slope * np.arange(52), abs=1e-4)


@FEW
@given(sizes=st.lists(st.integers(1, 30), min_size=1, max_size=5), ratio=st.sampled_from([0.0, 0.3, 0.75, 1.0]))
def test_mask_counts_are_exact(spark, sizes, ratio):
    rows = [(s, "m", p, p % 52, True) for s, n in enumerate(sizes) for p in range(n)]
    df = spark.createDataFrame(
        rows, "sample_idx int, modality string, token_pos int, week_idx int, is_temporal boolean"
    )
    for masked in (
        masking.mask_random(df, "sample_idx", ratio),
        masking.enforce_ratio(masking.mask_timesteps(df, "sample_idx"), "sample_idx", ratio),
    ):
        counts = masked.groupBy("sample_idx").agg(F.count_if("masked").alias("m")).collect()
        assert {r["sample_idx"]: r["m"] for r in counts} == {s: int(n * ratio) for s, n in enumerate(sizes)}


@FEW
@given(n=st.integers(1, 400), chunk=st.integers(1, 20), block=st.integers(1, 8), readers=st.integers(1, 5))
def test_block_shuffle_is_a_permutation(spark, n, chunk, block, readers):
    df = spark.range(n).withColumnRenamed("id", "sample_idx")
    got = sampling.assign_readers(sampling.block_shuffle(df, chunk, block), readers).collect()
    chunks = {r["chunk_id"]: (r["chunk_rank"], r["block_id"], r["reader"]) for r in got}
    assert len(got) == n
    assert sorted(rank for rank, _, _ in chunks.values()) == list(range(-(-n // chunk)))
    per_reader = -(-len(chunks) // readers)
    assert all(reader == rank // per_reader for rank, _, reader in chunks.values())
    for c in chunks:
        if c + 1 in chunks and chunks[c][1] == chunks[c + 1][1]:
            assert chunks[c + 1][0] == chunks[c][0] + 1
