"""Hand-computed edge cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fieldspark.functions import geo, time as TM, values as V, vectors
from fieldspark.operators import (
    diff,
    filters,
    interpolate,
    joins,
    losses,
    masking,
    pairs,
    sampling,
    spatial,
    stats,
    temporal,
    tokens,
)


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "ts, end, key",
    [
        ("2020-12-27 10:00:00", "2020-12-27", "2020-W52"),
        ("2020-12-28 00:00:00", "2021-01-03", "2021-W53"),
        ("2021-01-03 23:59:59", "2021-01-03", "2021-W53"),
        ("2021-01-04 00:00:00", "2021-01-10", "2021-W01"),
        ("2021-12-26 00:00:00", "2021-12-26", "2021-W51"),
        ("2022-01-02 00:00:00", "2022-01-02", "2022-W52"),
        ("2022-12-31 00:00:00", "2023-01-01", "2023-W52"),
        ("2023-01-01 05:00:00", "2023-01-01", "2023-W52"),
        ("2024-12-30 00:00:00", "2025-01-05", "2025-W01"),
    ],
)
def test_week_key(spark, ts, end, key):
    sunday = TM.week_end(F.lit(ts).cast("timestamp_ntz"))
    row = spark.range(1).select(sunday.cast("string").alias("e"), TM.week_key(sunday).alias("k"))
    assert tuple(row.first()) == (end, key)


def test_week_aggregates_skip_missing(spark):
    rows = [(1, dt.datetime(2021, 1, 5), v) for v in (1.0, float("nan"), 3.0, None)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double")
    got = {
        a: temporal.weekly_resample(df, ["k"], "ts", ["v"], a).first()["v"]
        for a in ("mean", "median", "max", "anything")
    }
    assert got == {"mean": 2.0, "median": 2.0, "max": 3.0, "anything": 2.0}


def test_median_of_even_count(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double")
    assert temporal.median_by(df, ["k"], ["v"]).first()["v"] == 2.5
    assert temporal.median_by(df, ["k"], ["v"], heavy_rows=2).first()["v"] == 2.5


def test_stats_of_nothing(spark):
    df = spark.createDataFrame([("a", 5.0, False), ("a", None, True)], "g string, v double, ok boolean")
    row = stats.masked_stats(df, "v", ["g"], F.col("ok")).first()
    assert tuple(row) == ("a", 0.0, 1.0, 0.0, 0.0, 0)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 10.0, float("nan"), None)], "v double")
    got = stats.histogram(df, "v", 5).orderBy("bin")
    assert [r["n"] for r in got.collect()] == [2, 1, 0, 0, 1]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sum(r["n"] for r in stats.histogram(flat, "v", 4).collect()) == 2


def test_week_encoding(spark):
    df = spark.createDataFrame([("2021-W13",), ("NA",), ("2021-04-01",), ("bad",), (None,)], "k string")
    sin, cos = TM.cyclic_week(F.col("k"))
    got = values(df.select(sin.alias("s"), cos.alias("c")), "s", "c")
    assert [round(s, 9) for s, _ in got] == [1.0, 0.0, 1.0, 0.0, 0.0]
    assert [round(c, 9) for _, c in got] == [0.0, 0.0, 0.0, 0.0, 0.0]


def grid(spark, points, length=52):
    known = dict(points)
    return spark.createDataFrame(
        [(1, p, known.get(p)) for p in range(length)], "k int, pos int, v double"
    )


def test_interpolation_and_extrapolation(spark):
    df = grid(spark, [(3, 1.0), (4, 2.0), (10, 0.5), (30, 7.0)])
    got = dict(values(interpolate.interpolate_linear(df, ["k"], "pos", ["v"]), "pos", "v"))
    assert got[0] == pytest.approx(-2.0)
    assert got[7] == pytest.approx(1.25)
    assert got[51] == pytest.approx(13.825)
    cut = interpolate.interpolate_linear(df, ["k"], "pos", ["v"], segment=5)
    assert dict(values(cut, "pos", "v")) == pytest.approx(got)


def test_interpolation_of_one_and_no_point(spark):
    single = interpolate.interpolate_linear(grid(spark, [(5, 9.0)]), ["k"], "pos", ["v"])
    assert {v for (v,) in values(single, "v")} == {9.0}
    none = interpolate.interpolate_linear(grid(spark, []), ["k"], "pos", ["v"])
    assert {v for (v,) in values(none, "v")} == {None}
    kept = interpolate.interpolate_linear(grid(spark, [(5, 9.0)]), ["k"], "pos", ["v"], min_points=2)
    assert {v for (v,) in values(kept, "v")} == {9.0, None}


def test_cubic_reproduces_a_cubic(spark):
    curve = lambda p: 0.01 * p**3 - 0.3 * p**2 + p - 4
    df = grid(spark, [(p, float(curve(p))) for p in (2, 9, 17, 30, 44, 50)])
    got = values(interpolate.interpolate_cubic(df, ["k"], "pos", ["v"]), "pos", "v")
    assert len(got) == 52
    for p, v in got:
        assert v == pytest.approx(curve(p), abs=1e-6)


def dense_spline(x, y, at):
    """Not-a-knot spline from one linear system for the coefficients of all pieces."""
    n = len(x) - 1
    rows, right = [], []

    def equation(parts, value):
        row = np.zeros(4 * n)
        for piece, terms in parts:
            row[4 * piece : 4 * piece + 4] += terms
        rows.append(row)
        right.append(value)

    for i in range(n):
        h = x[i + 1] - x[i]
        equation([(i, [1, 0, 0, 0])], y[i])
        equation([(i, [1, h, h**2, h**3])], y[i + 1])
        if i < n - 1:
            equation([(i, [0, 1, 2 * h, 3 * h**2]), (i + 1, [0, -1, 0, 0])], 0)
            equation([(i, [0, 0, 2, 6 * h]), (i + 1, [0, 0, -2, 0])], 0)
    equation([(0, [0, 0, 0, 1]), (1, [0, 0, 0, -1])], 0)
    equation([(n - 2, [0, 0, 0, 1]), (n - 1, [0, 0, 0, -1])], 0)
    c = np.linalg.solve(np.array(rows), np.array(right)).reshape(n, 4)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    d = at - x[i]
    return c[i, 0] + c[i, 1] * d + c[i, 2] * d**2 + c[i, 3] * d**3


def test_cubic_against_a_dense_solve(spark):
    rng = np.random.default_rng(11)
    for size in (4, 5, 12, 30):
        x = np.sort(rng.choice(52, size, replace=False)).astype(float)
        y = rng.normal(size=size)
        df = grid(spark, [(int(p), float(v)) for p, v in zip(x, y)])
        got = dict(values(interpolate.interpolate_cubic(df, ["k"], "pos", ["v"]), "pos", "v"))
        expected = dense_spline(x, y, np.arange(52.0))
        assert [got[p] for p in range(52)] == pytest.approx(expected, rel=1e-6, abs=1e-6)


def test_cubic_falls_back_to_linear(spark):
    for points in ([(3, 1.0), (4, 2.0), (10, 0.5)], [(3, 1.0), (9, 2.0)], [(5, 9.0)], []):
        df = grid(spark, points)
        cubic = dict(values(interpolate.interpolate_cubic(df, ["k"], "pos", ["v"]), "pos", "v"))
        linear = dict(values(interpolate.interpolate_linear(df, ["k"], "pos", ["v"]), "pos", "v"))
        assert {p: v is None for p, v in cubic.items()} == {p: v is None for p, v in linear.items()}
        for p, v in cubic.items():
            if v is not None:
                assert v == pytest.approx(linear[p])


def test_cubic_rejects_long_or_repeated_series(spark):
    with pytest.raises(Exception, match="more than 52 rows"):
        interpolate.interpolate_cubic(grid(spark, [], 53), ["k"], "pos", ["v"]).collect()
    twice = grid(spark, [(1, 1.0)], 3).unionByName(grid(spark, [], 2))
    with pytest.raises(Exception, match="repeated positions"):
        interpolate.interpolate_cubic(twice, ["k"], "pos", ["v"]).collect()


def test_season_length(spark):
    assert one(spark, V.season_length(F.lit(100), F.lit(200))) == 100
    assert one(spark, V.season_length(F.lit(300), F.lit(50))) == 115


def test_clamp(spark):
    got = [one(spark, V.clamp(F.lit(c), 0, 3)) for c in (-1, 0, 3, 9)]
    assert got == [0, 0, 3, 3]
    missing = F.lit(None).cast("int")
    assert one(spark, V.clamp(missing, 0, 3)) == 0
    assert one(spark, V.clamp(missing, 0, 3, keep_null=True)) is None


def test_priority_class(spark):
    cases = [(0, 100, 100), (None, 0, 100), (0, 0, 0), (5, 1, 1)]
    got = [
        one(spark, V.priority_class(*[F.lit(x).cast("int") for x in case])) for case in cases
    ]
    assert got == [2, 3, 0, 1]


def test_slug(spark):
    names = ["Cote d'Ivoire", "St Pierre & Miquelon", "Gambia, The"]
    assert [one(spark, V.slug(F.lit(n))) for n in names] == [
        "cote_divoire",
        "st_pierre_and_miquelon",
        "gambia_the",
    ]


def test_key_prefixes(spark):
    assert one(spark, V.strip_prefixes(F.lit("model._orig_mod.module.enc.model.w"))) == "enc.model.w"


def test_id_prefix(spark):
    empty = F.lit(None).cast("struct<grid_id:int,country:string,continent:string,classification:int,tempCropArea:double,cellArea:double>")
    df = spark.createDataFrame([("12_7",), ("x",), ("12",)], "id string").withColumn("properties", empty)
    got = values(filters.with_metadata_defaults(df), "grid_id", "country", "continent")
    assert got == [(12, "Unknown", "Europe"), (0, "Unknown", "Europe"), (0, "Unknown", "Europe")]


def index(spark, n):
    return spark.range(n).withColumnRenamed("id", "sample_idx")


def test_batch_slices(spark):
    got = sampling.slice_batches(index(spark, 10), 4).groupBy("batch_id").count().orderBy("batch_id")
    assert [r["count"] for r in got.collect()] == [2, 2, 2, 4]


@pytest.mark.parametrize("split", [sampling.split_contiguous, sampling.split_random])
def test_split_sizes(spark, split):
    for n, sizes in ((15, (12, 1, 2)), (10, (8, 1, 1)), (1, (0, 0, 1)), (1000, (800, 100, 100))):
        got = dict(values(split(index(spark, n)).groupBy("split").count(), "split", "count"))
        assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == sizes
    with pytest.raises(ValueError):
        split(index(spark, 10), 0.8, 0.3, 0.1)
    with pytest.raises(ValueError):
        split(index(spark, 10), 1.0, 0.0, 0.0)


def token_rows(spark, sizes):
    rows, start = [], 0
    for m, (name, t) in enumerate(sizes.items()):
        rows += [(7, 0, name, m, start + i, i, True) for i in range(t)]
        start += t
    return spark.createDataFrame(
        rows,
        "sample_idx bigint, batch_id bigint, modality string, modality_idx int, token_pos bigint, "
        "week_idx int, is_temporal boolean",
    )


def test_mask_counts(spark):
    df = masking.mask_random(token_rows(spark, {"a": 10}), "sample_idx")
    assert df.where("masked").count() == 7
    for sizes, expected in (({"a": 1}, 0), ({"a": 2}, 1), ({"a": 52}, 39)):
        got = masking.mask_timesteps(token_rows(spark, sizes), "sample_idx")
        assert got.where("masked").count() == expected


def test_modality_mask_counts(spark):
    for m, expected in ((7, 3), (1, 0), (2, 1)):
        names = [f"m{i}" for i in range(m)]
        df = token_rows(spark, {n: 3 for n in names})
        got = masking.mask_modality(df, "batch_id", names).where("masked")
        assert got.select("modality").distinct().count() == expected


def test_patterns(spark):
    df = token_rows(spark, {"a": 52})
    shown = {
        p: sorted(r["week_idx"] for r in masking.mask_pattern(df, "batch_id", [p]).where("not masked").collect())
        for p in masking.PATTERNS
    }
    assert shown["monthly"] == list(range(0, 52, 4))
    assert shown["first_half"] == list(range(26, 52))
    assert shown["second_half"] == list(range(26))


def test_enforce_ratio_extremes(spark):
    df = token_rows(spark, {"a": 8}).withColumn("masked", F.lit(True))
    assert masking.enforce_ratio(df, "sample_idx", 0.75).where("masked").count() == 6
    assert masking.enforce_ratio(df, "sample_idx", 0.05).where("masked").count() == 0
    none = df.withColumn("masked", F.lit(False))
    assert masking.enforce_ratio(none, "sample_idx", 1.0).where("masked").count() == 8


def test_export_chunk():
    assert sampling.export_chunk(128, 256) == 1088
    assert sampling.export_chunk(5000, 256) == 5000
    assert sampling.export_chunk(1, 1) == 5


def test_grid_cell(spark):
    df = spark.createDataFrame([(10.66, 50.28)], "lon double, lat double")
    assert values(spatial.assign_cell(df), "cell_x", "cell_y") == [(237, 1298)]


def test_mercator_inverse(spark):
    x, y = geo.to_mercator(F.lit(12.5), F.lit(-41.25))
    lon, lat = geo.from_mercator(x, y)
    assert one(spark, lon) == pytest.approx(12.5)
    assert one(spark, lat) == pytest.approx(-41.25)


def vectors_with(spark, labels):
    rows = [(0, i, [1.0 * i, 1.0, 0.5 * i * i], y) for i, y in enumerate(labels)]
    return spark.createDataFrame(rows, "b int, i int, z array<double>, y int").withColumn(
        "s", F.reverse("z")
    )


def test_contrastive_without_positives(spark):
    df = vectors_with(spark, [0, 0, 1, 2])
    assert pairs.contrastive_loss(df, "b", "i", "z", "y").collect() == []
    assert pairs.contrastive_loss(df, "b", "i", "z", "y", tile_rows=1).collect() == []


def test_missing_labels_take_no_part(spark):
    df = vectors_with(spark, [1, 1, None, 2])
    kept = df.where("y IS NOT NULL")
    for f in (
        lambda d: pairs.contrastive_loss(d, "b", "i", "z", "y"),
        lambda d: pairs.eam_loss(d, "b", "i", "z", "s", "y"),
    ):
        assert [tuple(r) for r in f(df).collect()] == [tuple(r) for r in f(kept).collect()]


def test_eam_of_empty_parts(spark):
    row = pairs.eam_loss(vectors_with(spark, [0, 0]), "b", "i", "z", "s", "y").first()
    assert tuple(row) == (0, 0.0, 0.0, 0.0)


def test_loss_weights(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0), ("c", "z", 1.0)], "type string, name string, loss double")
    total = lambda w: losses.combine_losses(df, w).first()["total"]
    assert total({"a:x": 2.0, "b": 3.0}) == 6.0
    assert total({"a:x": 1.0, "a": 5.0}) == 7.0
    assert total({}) == 3.0
    assert losses.combine_losses(df).first()["total"] == 1.0
    assert losses.combine_losses(df.limit(0)).first()["total"] == 0.0


def test_diff_with_itself(spark):
    df = spark.createDataFrame([("k1", [1.0, 2.0]), ("k2", [3.0])], "key string, v array<double>")
    assert diff.snapshot_diff(df, df, "key", "v").collect() == []


def test_point_in_polygon_boundaries(spark):
    square = spark.createDataFrame(
        [(5, [Row(x=0.0, y=0.0), Row(x=10.0, y=0.0), Row(x=10.0, y=10.0), Row(x=0.0, y=10.0)])],
        "zone_id bigint, ring array<struct<x:double,y:double>>",
    )
    points = spark.createDataFrame(
        [(1, 0.0, 5.0), (2, 10.0, 5.0), (3, 5.0, 0.0), (4, 5.0, 10.0), (5, 3.0, 3.0), (6, 99.0, 0.0), (7, None, 1.0)],
        "id int, lon double, lat double",
    )
    got = dict(values(spatial.zone_of_point(points, square, "id"), "id", "zone_id"))
    assert got == {1: 5, 2: -1, 3: 5, 4: -1, 5: 5, 6: -1, 7: -1}


def test_cover_grid_of_a_large_square(spark):
    ring = [Row(x=100.0, y=100.0), Row(x=29900.0, y=100.0), Row(x=29900.0, y=29900.0), Row(x=100.0, y=29900.0)]
    region = spark.createDataFrame([(1, ring)], "id int, ring array<struct<x:double,y:double>>")
    cells = {(r["cell_x"], r["cell_y"]) for r in spatial.cover_grid(region).collect()}
    assert cells == {(x, y) for x in range(6) for y in range(6)}


def test_slope_of_a_plane(spark):
    dem = spark.range(100).select(
        (F.col("id") % 10).alias("gx"), F.floor(F.col("id") / 10).alias("gy")
    ).withColumn("z", F.col("gx") * 3.0 + F.col("gy") * 4.0)
    rows = spatial.slope(dem, 10.0).collect()
    inner = [r["slope"] for r in rows if 0 < r["gx"] < 9 and 0 < r["gy"] < 9]
    assert len(rows) == 100 and len(inner) == 64
    assert inner == pytest.approx([math.degrees(math.atan(0.5))] * 64)
    assert all(r["slope"] is None for r in rows if r["gx"] in (0, 9) or r["gy"] in (0, 9))


def test_scatter_dense_rejects_repeats(spark):
    df = spark.createDataFrame([(0, [1.0]), (2, [2.0])], "sample_idx bigint, embedding array<float>")
    got = values(joins.scatter_dense(df, 1).orderBy("sample_idx"), "embedding")
    assert got == [([1.0],), ([0.0],), ([2.0],)]
    with pytest.raises(Exception, match="repeated index 2"):
        joins.scatter_dense(df.unionByName(df.where("sample_idx = 2")), 1).collect()


def test_attach_embeddings_needs_all_rows(spark):
    samples = index(spark, 3)
    e = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "sample_idx bigint, embedding array<float>")
    with pytest.raises(Exception, match="no embedding for sample 2"):
        joins.attach_embeddings(samples, e).collect()


def test_unknown_variables_fail(spark):
    with pytest.raises(ValueError, match="unknown variables"):
        filters.select_variables(index(spark, 1), ["nope"])
    with pytest.raises(ValueError, match="unknown variables"):
        filters.select_packed(F.col("x"), ["a"], ["b"])


def test_null_audit_can_fail(spark):
    df = spark.createDataFrame([(1, 0, True, None, 2.0)], "s int, pos int, valid boolean, a double, b double")
    assert stats.null_audit(df, "s", ["a", "b"]).where("scope = 'total'").first()["nulls"] == 1
    with pytest.raises(Exception, match="1 missing values"):
        stats.null_audit(df, "s", ["a", "b"], fail=True).collect()


def test_null_audit_of_hard_series(spark):
    rows = [(i if i else None, i % 3, True, None, 1.0) for i in range(13)] + [(99, None, True, 1.0, 1.0), (98, 0, False, None, None)]
    df = spark.createDataFrame(rows, "s int, pos int, valid boolean, a double, b double")
    got = {(r["scope"], r["key"]): (r["nulls"], r["cells"]) for r in stats.null_audit(df, "s", ["a", "b"], 3).collect()}
    assert got == {
        ("total", "all"): (13, 28),
        ("variable", "a"): (13, 14),
        ("variable", "b"): (0, 14),
        ("week", "0"): (5, 10),
        ("week", "1"): (4, 8),
        ("week", "2"): (4, 8),
        ("samples", "with_nulls"): (13, 14),
        ("sample", None): (1, 2),
        ("sample", "1"): (1, 2),
        ("sample", "2"): (1, 2),
    }
    scopes = stats.null_audit(df, "s", ["a", "b"], 0).where("scope = 'sample'")
    assert scopes.isEmpty()
    nothing = stats.null_audit(df.limit(0), "s", ["a", "b"]).collect()
    assert sorted((r["scope"], r["nulls"], r["cells"]) for r in nothing) == [
        ("samples", 0, 0), ("total", 0, 0), ("variable", 0, 0), ("variable", 0, 0)
    ]


def test_histograms_of_hard_columns(spark):
    rows = [(1.0, None, 5.0), (float("nan"), None, 5.0), (3.0, None, None), (2.0, None, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["variable"], r["bin"]): (r["n"], r["total"], r["bin_start"]) for r in stats.histograms(df, ["a", "b", "c"], 2).collect()}
    assert got == {
        ("a", 0): (1, 3, 1.0), ("a", 1): (2, 3, 2.0), ("b", 0): (0, 0, None), ("b", 1): (0, 0, None),
        ("c", 0): (3, 3, 5.0), ("c", 1): (0, 3, 5.0),
    }
    assert {r["n"] for r in stats.histograms(df.limit(0), ["a", "b"], 2).collect()} == {0}


def test_pack_rejects_long_series(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2021, 1, 1 + i), i, 1.0) for i in range(4)], "k int, ts timestamp_ntz, t int, v double"
    )
    assert filters.pack(df, ["k"], "ts", ["t"], ["v"], 4).count() == 1
    with pytest.raises(Exception, match="more than 3 rows"):
        filters.pack(df, ["k"], "ts", ["t"], ["v"], 3).collect()


def test_empty_samples_get_invalid_series(spark):
    obs = spark.createDataFrame([(1, dt.datetime(2021, 1, 5), 2.0)], "k int, ts timestamp_ntz, v double")
    samples = spark.createDataFrame([(1,), (2,)], "k int")
    got = temporal.clean_series(obs, ["k"], "ts", ["v"], samples=samples)
    assert got.count() == 104
    assert got.where("valid").count() == 1
    assert {r["week_key"] for r in got.where("k = 2").collect()} == {"NA"}


def test_calendar_grid_prefers_the_later_sunday(spark):
    rows = [(1, dt.datetime(2023, 1, 1), 1.0), (1, dt.datetime(2023, 12, 31), 2.0)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double")
    got = temporal.calendar_grid(df, ["k"], "ts", ["v"]).where("valid").collect()
    assert [(r["week_key"], r["v"]) for r in got] == [("2023-W52", 2.0)]


def test_vectors(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.l2_normalize(zero)) == [0.0, 0.0]
    big = F.array(F.lit(1000.0), F.lit(1000.0))
    assert one(spark, vectors.logsumexp(big)) == pytest.approx(1000 + math.log(2))
    assert one(spark, vectors.hinge(F.lit(1.5))) == 0.0


def test_token_order_is_restored(spark):
    masked = masking.mask_random(token_rows(spark, {"a": 5, "b": 6}), "sample_idx")
    lists = tokens.mask_indices(masked, "sample_idx")
    got = tokens.restore_order(lists, "sample_idx", F.col("kept"), F.lit(-1).cast("bigint"))
    rows = sorted(values(got, "token_pos", "value", "masked"))
    assert [r[0] for r in rows] == list(range(11))
    assert all(v == (-1 if m else p) for p, v, m in rows)


def test_block_shuffle_of_a_split_starts_at_its_first_index(spark):
    from fieldspark.operators import sampling

    for low, high in ((100, 200), (105, 145), (0, 95)):
        df = spark.range(low, high).withColumnRenamed("id", "sample_idx")
        rows = sampling.assign_readers(sampling.block_shuffle(df, 10, 4), 5).collect()
        sizes, readers = {}, {}
        for r in rows:
            sizes[r["chunk_rank"]] = sizes.get(r["chunk_rank"], 0) + 1
            readers[r["reader"]] = readers.get(r["reader"], 0) + 1
        assert sorted(sizes) == list(range(-(-(high - low) // 10)))
        assert sorted(sizes.values())[1:] == [10] * (len(sizes) - 1)
        if high - low == 100:
            assert readers == {i: 20 for i in range(5)}


def test_sampled_pixels_are_whole(spark):
    from fieldspark.operators import spatial

    point = spatial.assign_cell(spark.sql("select 1 as id, 10.0D as lon, 50.0D as lat"), 1000.0).first()
    rows = [(point["cell_x"], point["cell_y"], 1, 9), (point["cell_x"], point["cell_y"], 5, 2)]
    raster = spark.createDataFrame(rows, "px bigint, py bigint, a int, b int")
    points = spark.sql("select 1 as id, 10.0D as lon, 50.0D as lat")
    got = spatial.sample_pixels(points, raster, 1000.0, ["a", "b"]).first()
    assert (got["a"], got["b"]) == (5, 2)


def test_repeated_dictionary_keys_and_missing_embeddings(spark):
    from fieldspark.operators import joins

    dim = spark.createDataFrame([("x", "B"), ("x", "A")], "country string, continent string")
    got = joins.lookup_continent(spark.createDataFrame([("x",)], "country string"), dim).collect()
    assert [r["continent"] for r in got] == ["A"]
    samples = spark.range(2).withColumnRenamed("id", "sample_idx")
    vectors = spark.createDataFrame([(0, [1.0])], "sample_idx bigint, embedding array<double>")
    for plan in (lambda d: d.count(), lambda d: d.select("sample_idx").collect()):
        try:
            plan(joins.attach_embeddings(samples, vectors))
        except Exception as error:
            assert "no embedding for sample 1" in str(error)
        else:
            raise AssertionError("a missing embedding went unnoticed")
