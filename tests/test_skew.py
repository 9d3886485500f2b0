"""Groups too large for one task take other paths that have to give the same rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldspark.operators import interpolate, masking, pairs, ranking, sampling, temporal, tokens
from fieldspark.plans import bindings as B


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def same(a, b):
    assert rows(a) == rows(b)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 100 + 2).alias("k"),
        F.col("id").alias("token_pos"),
        F.md5(F.col("id").cast("string")).alias("h"),
        F.timestamp_seconds(F.col("id") * 1000).cast("timestamp_ntz").alias("ts"),
        (F.col("id") * 7919 % 1000 / 10.0).alias("v"),
    )


def test_heavy_groups_are_found(skewed):
    heavy = ranking.heavy_groups(skewed, ["k"], 100)
    assert [tuple(r) for r in heavy.collect()] == [(1, 1000)]
    assert ranking.heavy_groups(skewed, ["k"], 5000) is None


def test_ranks_agree(skewed):
    same(
        ranking.hash_rank(skewed, ["k"], "h", ["token_pos"]),
        ranking.hash_rank(skewed, ["k"], "h", ["token_pos"], heavy_rows=100),
    )
    same(
        ranking.series_rank(skewed, ["k"], "ts", ["token_pos"]),
        ranking.series_rank(skewed, ["k"], "ts", ["token_pos"], heavy_rows=100),
    )
    same(
        ranking.position_in_group(skewed, ["k"], "token_pos"),
        ranking.position_in_group(skewed, ["k"], "token_pos", span=64, heavy_rows=100),
    )


def test_null_keys_keep_their_ranks(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [(1, i) for i in range(9)], "k int, p int")
    got = ranking.position_in_group(df, ["k"], "p", span=2, heavy_rows=3)
    assert sorted(r["_rank"] for r in got.where("k IS NULL").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["_rank"] for r in got.where("k = 1").collect()) == list(range(1, 10))


def test_heavy_group_spreads_over_windows(skewed):
    """No window partition of the split ranking holds the heavy key as a whole."""
    plan = ranking.hash_rank(skewed, ["k"], "h", ["token_pos"], heavy_rows=100)
    text = plan._jdf.queryExecution().executedPlan().toString()
    main = [line for line in text.splitlines() if "Window [row_number()" in line]
    assert main and all("_b#" in line for line in main)


def test_global_rank(skewed):
    got = ranking.global_hash_rank(skewed, "h", ["token_pos"]).orderBy("h").collect()
    assert [r["_rank"] for r in got] == list(range(3000))


def test_masks_agree(spark, skewed):
    toks = skewed.withColumnsRenamed({"k": "sample_idx"}).withColumns(
        {
            "batch_id": F.floor(F.col("sample_idx") / 10),
            "modality": F.when(F.col("token_pos") % 2 == 0, "a").otherwise("b"),
            "week_idx": F.pmod("token_pos", F.lit(52)),
            "is_temporal": F.lit(True),
        }
    )
    for heavy in (100, 10):
        same(masking.mask_random(toks, "sample_idx"), masking.mask_random(toks, "sample_idx", heavy_rows=heavy))
        steps = masking.mask_timesteps(toks, "sample_idx")
        same(steps, masking.mask_timesteps(toks, "sample_idx", heavy_rows=heavy))
        same(masking.enforce_ratio(steps, "sample_idx"), masking.enforce_ratio(steps, "sample_idx", heavy_rows=heavy))
        args = ("sample_idx", "batch_id", ["a", "b"])
        same(masking.structured_mask(toks, *args), masking.structured_mask(toks, *args, heavy_rows=heavy))
        same(tokens.mask_slots(steps, "sample_idx"), tokens.mask_slots(steps, "sample_idx", heavy_rows=heavy))
    counts = masking.mask_random(toks, "sample_idx", heavy_rows=10).groupBy("sample_idx").agg(
        F.count_if("masked").alias("m"), F.count("*").alias("n")
    )
    assert all(r["m"] == math.floor(r["n"] * 0.75) for r in counts.collect())


def test_token_tables_agree(spark, small_dir):
    orders = B.table(spark, small_dir, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("sample_idx"),
        F.col("o_orderpriority").alias("modality"),
        F.col("o_orderdate").alias("ts"),
        "o_orderkey",
    )
    args = (orders, "sample_idx", "ts", ["o_orderkey"], B.PRIORITIES, B.TEMPORAL)
    same(tokens.token_table(*args), tokens.token_table(*args, heavy_rows=20))


def test_medians_agree(spark, skewed):
    df = skewed.withColumn("w", F.when(F.rand(1) < 0.1, None).otherwise(F.col("v") * 2)).withColumn(
        "none", F.when(F.col("k") != 1, F.col("v"))
    ).cache()
    plain = temporal.median_by(df, ["k"], ["v", "w", "none"])
    same(plain, temporal.median_by(df, ["k"], ["v", "w", "none"], heavy_rows=50))
    constant = df.withColumn("v", F.lit(4.0))
    same(temporal.median_by(constant, ["k"], ["v"]), temporal.median_by(constant, ["k"], ["v"], 50))


def test_nodata_interpolation_agrees(skewed):
    df = skewed.withColumn("v", F.when(F.col("token_pos") % 4 < 3, 0.0).otherwise(F.col("v") + 1))
    args = (df, ["k"], "ts", ["token_pos"], ["v"])
    plain = {(r["k"], r["pos"]): r["v"] for r in interpolate.interpolate_nodata(*args).collect()}
    cut = interpolate.interpolate_nodata(*args, segment=16, heavy_rows=50).collect()
    assert len(cut) == len(plain) == 3000
    for r in cut:
        assert r["v"] == pytest.approx(plain[r["k"], r["pos"]])


def test_nodata_interpolation_against_numpy(spark):
    rng = np.random.default_rng(5)
    y = np.where(rng.random(200) < 0.7, 0.0, rng.random(200))
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "k int, i int, v double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("i") * 86400).cast("timestamp_ntz"))
    got = interpolate.interpolate_nodata(df, ["k"], "ts", ["i"], ["v"], segment=7)
    ours = np.array([r["v"] for r in got.orderBy("pos").collect()])
    at, known = np.arange(200.0), y != 0
    x, v = at[known], y[known]
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    expected = np.where(known, y, v[i] + (at - x[i]) * (v[i + 1] - v[i]) / (x[i + 1] - x[i]))
    assert ours == pytest.approx(expected)


@pytest.mark.parametrize("tile_rows", [7, 20])
def test_pair_terms_agree(spark, small_dir, tile_rows):
    e = B.embeddings(spark, small_dir).withColumn(
        "batch_id", F.when(F.col("sample_idx") % 3 == 0, 0).otherwise(F.col("batch_id"))
    )
    e = e.where("sample_idx < 200")
    calls = [
        lambda t: pairs.pair_summary(e, "batch_id", "sample_idx", "z", t),
        lambda t: pairs.contrastive_loss(e, "batch_id", "sample_idx", "z", "label", tile_rows=t),
        lambda t: pairs.eam_loss(e, "batch_id", "sample_idx", "z", "s", "label", tile_rows=t),
        lambda t: pairs.collapse_metrics(e, "batch_id", "sample_idx", "z", 64, t),
    ]
    for call in calls:
        whole, tiled = rows(call(2048)), rows(call(tile_rows))
        assert len(whole) == len(tiled) > 0
        for a, b in zip(whole, tiled):
            assert a == pytest.approx(b)


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    z, s, y = rng.normal(size=(30, 5)), rng.normal(size=(30, 5)), rng.integers(0, 4, 30)
    df = spark.createDataFrame(
        [(1, i, z[i].tolist(), s[i].tolist(), int(y[i])) for i in range(30)],
        "b int, i int, z array<double>, s array<double>, y int",
    )
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = unit(z) @ unit(z).T
    losses, rows_ = 0.0, 0
    for i in range(30):
        positive = [j for j in range(30) if j != i and y[i] == y[j] > 0]
        if not positive:
            continue
        den = sum(math.exp(sim[i, j] / 0.07) for j in range(30) if j != i)
        losses += np.mean([-math.log(math.exp(sim[i, j] / 0.07) / den + 1e-8) for j in positive])
        rows_ += 1
    got = pairs.contrastive_loss(df, "b", "i", "z", "y", tile_rows=8).first()
    assert (got["loss"], got["rows"]) == (pytest.approx(losses / rows_), rows_)

    dist = lambda m: np.linalg.norm(unit(m)[:, None] - unit(m)[None], axis=2)
    dz, ds = dist(z), dist(s)
    align = [(dz[i, j] - 2 * ds[i, j]) ** 2 for i in range(30) for j in range(i + 1, 30) if y[i] == y[j] > 0]
    shatter = [max(0.5 - dz[i, j], 0) for i in range(30) for j in range(i + 1, 30) if y[i] != y[j]]
    eam = pairs.eam_loss(df, "b", "i", "z", "s", "y", tau=2.0, margin=0.5, weight=3.0, tile_rows=8).first()
    assert eam["align"] == pytest.approx(np.mean(align))
    assert eam["shatter"] == pytest.approx(np.mean(shatter))
    assert eam["loss"] == pytest.approx(np.mean(align) + 3 * np.mean(shatter))


def test_small_table_leaves_large_ones_alone(spark):
    df = spark.range(100)
    assert ranking.small_table(df, 10) is df
    assert ranking.small_table(df, 100).count() == 100


def test_bounded_lists_do_not_grow(spark):
    df = spark.range(100000).select((F.col("id") % 2).alias("k"), F.col("id").alias("p"))
    long = ranking.bounded_lists(df, ["k"], [F.col("p")], ["p"], 8192)
    assert "WindowGroupLimit" in long._jdf.queryExecution().executedPlan().toString()
    plan = ranking.bounded_lists(df, ["k"], [F.col("p")], ["p"], 5)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="more than 5 rows"):
        plan.collect()


def test_stratified_sample_limits_before_the_exchange(skewed):
    df = sampling.stratified_sample(skewed, "k", ["token_pos"], 5)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2
    counts = df.groupBy("k").count().collect()
    assert all(r["count"] <= 5 for r in counts)


def test_relayout_splits_a_hot_sample(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("sample_idx"), F.col("id").alias("ts")
    )
    laid = sampling.relayout(df, order=["ts"], partitions=6)
    parts = laid.where("sample_idx = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 3001


def test_modality_files_split_a_hot_month(spark, tmp_path):
    from fieldspark.sources import observations

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(60000).select(
            F.col("id").alias("sample_idx"),
            F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 500)).cast("timestamp_ntz").alias("ts"),
            F.rand(1).alias("v"),
        )
        observations.write_modality(df, str(tmp_path), "m")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "m" / "month=1970-01").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "m")).count() == 60000


def test_heavy_median_of_null_key_outlier_and_zeros(spark):
    """A NULL key is a group, and neither one huge value nor many equal ones change the median."""
    rows = [(None, 0.0)] * 60 + [(None, float(i)) for i in range(41)] + [(None, 1e12)]
    rows += [(1, float(i)) for i in range(80)] + [(1, None)] * 5 + [(2, 3.0), (2, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    expected = {(r["k"], r["v"]) for r in df.groupBy("k").agg(F.median("v").alias("v")).collect()}
    got = temporal.median_by(df, ["k"], ["v"], heavy_rows=50).collect()
    assert len(got) == 3 and {(r["k"], r["v"]) for r in got} == expected


@pytest.mark.parametrize("n", [1, 7, 30, 31, 500, 1000, 5000])
def test_strata_above_the_group_limit(spark, skewed, n):
    df = skewed.withColumn("k", F.when(F.col("k") != 5, F.col("k"))).withColumn("_rank", F.lit(1))
    same(
        sampling.stratified_sample(df.drop("_rank"), "k", ["token_pos"], n),
        sampling.stratified_sample(df.drop("_rank"), "k", ["token_pos"], n, group_limit=0),
    )


def test_strata_keep_repeated_rows_and_few_prefixes(spark, skewed):
    df = skewed.select("k", (F.col("token_pos") % 5).alias("token_pos"))
    same(
        sampling.stratified_sample(df, "k", ["token_pos"], 400),
        sampling.stratified_sample(df, "k", ["token_pos"], 400, group_limit=0),
    )
    assert sampling.stratified_sample(df.limit(0), "k", ["token_pos"], 400, group_limit=0).isEmpty()


def test_pack_lists_series_of_up_to_64_steps(spark, tmp_path):
    rows = [(k, k * 1000 + i, dt.datetime(2021, 1, 1) + dt.timedelta(days=i), float(i)) for k, n in ((1, 3), (2, 40), (3, 65)) for i in range(n)]
    kind = "o_custkey bigint, o_orderkey bigint, o_orderdate timestamp_ntz, o_totalprice double"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/orders.parquet")
    found = entry.queries()["p08_pack_unpack"](spark, str(tmp_path)).collect()
    listed = lambda k: sorted((r["pos"], r["price"]) for r in found if r["sample_idx"] == k and r["valid"])
    assert [len([r for r in found if r["sample_idx"] == k]) for k in (1, 2, 3)] == [64, 64, 1]
    assert listed(1) == [(i, float(i)) for i in range(3)] and listed(2) == [(i, float(i)) for i in range(40)]
    assert [r["error"] for r in found if r["error"]] == ["65 rows, at most 64 fit"]
