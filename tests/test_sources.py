"""Readers, writers, the extractor registry and the shared scratch folder."""

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from fieldspark import schema
from fieldspark.operators import sampling, spatial
from fieldspark.session import scratch_dir
from fieldspark.sources import dataset, embeddings, extract, failures, features, observations, stats_json


def test_feature_collections(spark, tmp_path):
    feature = lambda i, lon: {
        "type": "Feature",
        "id": i,
        "geometry": {"type": "Point", "coordinates": [lon, 2.0]},
        "properties": {"grid_id": 4} if i == "a" else {},
    }
    doc = {"type": "FeatureCollection", "features": [feature("a", 1.0), feature("b", 1.5)]}
    path = tmp_path / "points.geojson"
    path.write_text(json.dumps(doc, indent=2))
    got = features.read_features(spark, str(path), collection=True).orderBy("id").collect()
    assert [(r["id"], r["lon"], r["lat"], r["properties"]["grid_id"]) for r in got] == [
        ("a", 1.0, 2.0, 4),
        ("b", 1.5, 2.0, None),
    ]


def test_holes_and_parts(spark, tmp_path):
    box = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shapes = [
        ("1", "Polygon", [box(0, 10), box(4, 6)]),
        ("2", "MultiPolygon", [[box(20, 22)], [box(30, 40), box(34, 36)]]),
        ("3", "Point", [50, 50]),
    ]
    lines = [
        json.dumps({"type": "Feature", "id": i, "geometry": {"type": t, "coordinates": c}, "properties": {}})
        for i, t, c in shapes
    ]
    path = tmp_path / "zones.json"
    path.write_text("\n".join(lines))
    rows = features.read_polygons(spark, str(path))
    sizes = {r["id"]: r["parts"] and [[len(x) for x in p] for p in r["parts"]] for r in rows.collect()}
    assert sizes == {"1": [[4, 4]], "2": [[4], [4, 4]], "3": None}
    assert {r["id"]: r["ring"] and len(r["ring"]) for r in rows.collect()} == {"1": 4, "2": 4, "3": None}
    zones = rows.where("parts IS NOT NULL").select(F.col("id").cast("bigint").alias("zone_id"), "parts")
    points = spark.createDataFrame(
        [(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 21.0, 21.0), (4, 31.0, 31.0), (5, 35.0, 35.0), (6, 25.0, 25.0)],
        "k int, lon double, lat double",
    )
    found = lambda z: {r["k"]: r["zone_id"] for r in spatial.zone_of_point(points, z, "k").collect()}
    assert found(zones) == {1: 1, 2: -1, 3: 2, 4: 2, 5: -1, 6: -1}
    cells = {(r["zone_id"], r["cell_x"], r["cell_y"]) for r in spatial.cover_grid(zones, 1.0).collect()}
    # a cell that lies in a hole without touching its edge is not covered
    inside = {(z, x, y) for z, x, y in cells if (x, y) in ((2, 2), (4, 4), (21, 21), (25, 25), (34, 34))}
    assert {(z, x) for z, x, _ in inside} == {(1, 2), (1, 4), (2, 21), (2, 34)}
    wide = {(r["cell_x"], r["cell_y"]) for r in spatial.cover_grid(zones, 0.5).collect()}
    assert (9, 9) not in wide and (69, 69) not in wide and (7, 7) in wide
    again = str(tmp_path / "again")
    features.write_polygons(rows.where("parts IS NOT NULL").select("id", "parts"), again, ["id"])
    back = features.read_polygons(spark, again).select(F.col("id").cast("bigint").alias("zone_id"), "parts")
    assert sorted(back.collect()) == sorted(zones.collect())


def test_modality_scan_prunes_months_and_columns(spark, tmp_path):
    days = [(i, dt.datetime(2021, 1, 1) + dt.timedelta(days=i), 1.0 * i, 2.0) for i in range(400)]
    df = spark.createDataFrame(days, "sample_idx bigint, ts timestamp_ntz, a double, b double")
    observations.write_modality(df, str(tmp_path), "m")
    rows = observations.read_modality(spark, str(tmp_path), "m", "2021-03-10", "2021-05-01", ["a"])
    assert rows.count() == 52
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in text
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    assert re.search(r"ReadSchema: struct<sample_idx:bigint,ts:timestamp_ntz,a:double>", text)
    with pytest.raises(ValueError):
        observations.read_modality(spark, str(tmp_path), "m", "2021-01-01", "2022-01-01", ["x"])


def test_embedding_columns_are_numeric_ordered():
    assert embeddings.embedding_columns(["emb_10", "emb_2", "id", "emb_x"]) == ["emb_2", "emb_10"]
    with pytest.raises(ValueError):
        embeddings.embedding_columns(["id"])


def test_embeddings_without_index_follow_the_file_order(spark, tmp_path):
    n = 0
    for f, size in (("part-a.csv", 700), ("part-b.csv", 1), ("part-c.csv", 2500)):
        lines = ["emb_1,emb_0"] + [f"{i}.5,{i}" for i in range(n, n + size)]
        (tmp_path / f).write_text("\n".join(lines) + "\n")
        n += size
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = embeddings.read_embeddings(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == n
    assert all(r["embedding"] == [float(r["sample_idx"]), r["sample_idx"] + 0.5] for r in got)


def test_embeddings_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "part-a.csv").write_text("emb_0,emb_1\n1,2\n")
    (tmp_path / "part-b.csv").write_text("emb_1,emb_0\n1,2\n")
    with pytest.raises(Exception, match="header"):
        embeddings.read_embeddings(spark, str(tmp_path)).collect()


def test_merge_without_any_batch(spark, tmp_path):
    with pytest.warns(UserWarning), pytest.raises(FileNotFoundError):
        dataset.read_batches(spark, [str(tmp_path / "none")])


def test_absent_batches_warn(spark, tmp_path):
    for n, size in ((0, 3), (2, 4)):
        spark.range(size).withColumnRenamed("id", "sample_idx").write.parquet(str(tmp_path / f"b{n}"))
    with pytest.warns(UserWarning, match="b1"):
        batches = dataset.read_batches(spark, [str(tmp_path / f"b{n}") for n in range(3)])
    merged = dataset.merge_batches(batches)
    assert sorted(r["sample_idx"] for r in merged.collect()) == list(range(7))
    assert sorted(r["sample_idx"] for r in merged.where("batch = 2").collect()) == [3, 4, 5, 6]


def test_datasets_merge_with_shared_offsets(spark, tmp_path):
    for n, size in ((0, 3), (2, 2)):
        meta = spark.range(size).select(F.col("id").alias("sample_idx"), F.lit(n).alias("src"))
        weekly = meta.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(51))))
        dataset.write_dataset({"metadata": meta, "weekly": weekly}, str(tmp_path / f"b{n}"), "2024-01-01")
    with pytest.warns(UserWarning):
        merged = dataset.merge_datasets(spark, [str(tmp_path / f"b{n}") for n in range(3)], ["weekly"])
    assert sorted(r["sample_idx"] for r in merged["metadata"].collect()) == [0, 1, 2, 3, 4]
    counts = merged["weekly"].groupBy("sample_idx", "src").count().collect()
    assert sorted((r["sample_idx"], r["src"], r["count"]) for r in counts) == [
        (0, 0, 52), (1, 0, 52), (2, 0, 52), (3, 2, 52), (4, 2, 52)
    ]


def test_relayout_orders_files(spark, tmp_path):
    df = spark.range(5000).withColumnRenamed("id", "sample_idx").orderBy(F.rand(3))
    dataset.write_relayout(df, str(tmp_path / "out"), partitions=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    spans = back.groupBy(F.input_file_name().alias("f")).agg(
        F.min("sample_idx").alias("a"), F.max("sample_idx").alias("b")
    )
    spans = sorted((r["a"], r["b"]) for r in spans.collect())
    assert len(spans) > 1 and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    assert any("lz4" in f for f in os.listdir(tmp_path / "out"))


def test_layout_numbers(spark):
    got = sampling.with_layout(spark.range(2000).withColumnRenamed("id", "sample_idx"))
    row = got.where("sample_idx = 1300").first()
    assert (row["chunk_id"], row["shard_id"]) == (10, 1)


def test_names_skip_empty_lists(spark):
    df = spark.createDataFrame(
        [(0, "m", []), (1, "m", ["x", "y"]), (2, "m", ["z"]), (0, "n", [])],
        "batch int, modality string, names array<string>",
    )
    got = {r["modality"]: r["names"] for r in dataset.first_nonempty_names(df).collect()}
    assert got == {"m": ["x", "y"], "n": None}


def test_failures(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (1, "b", "e2"), (1, "b", "e1"), (2, "a", "x"), (2, "b", "y"), (3, "a", None), (3, "a", "late")],
        "p int, m string, e string",
    )
    got = {r["p"]: (r["kind"], r["reason"]) for r in failures.split_failures(df, "p", "m", "e").collect()}
    assert got == {
        1: ("partial", "Some modalities missing: b: e1"),
        2: ("full", "No modality delivered: a: x; b: y"),
    }
    assert tuple(failures.failure_summary(df, "p", "m", "e").first()) == (3, 1, 1)
    saves = spark.createDataFrame([(1, "too long"), (1, "disk"), (3, None)], "p int, e string")
    got = {r["p"]: (r["kind"], r["reason"]) for r in failures.split_failures(df, "p", "m", "e", saves).collect()}
    assert got == {
        1: ("save", "Record not stored: disk"),
        2: ("full", "No modality delivered: a: x; b: y"),
        3: ("save", "Record not stored: unknown"),
    }
    assert tuple(failures.failure_summary(df, "p", "m", "e", saves).first()) == (3, 3, 0)


def test_stats_json(spark, tmp_path):
    rows = [("s", "m", f"v{i}", 0.1 * i, 1.0, -1.0, 1e300, i) for i in range(5)] + [("t", "m", "v", 1.0, 1.0, 0.0, 2.0, 9)]
    df = spark.createDataFrame(rows, schema.NORM_STATS)
    stats_json.write_stats(df, str(tmp_path / "s"))
    assert sorted(map(tuple, stats_json.read_stats(spark, str(tmp_path / "s")).collect())) == sorted(rows)


def test_modality_catalogue(spark):
    table = {r["name"]: r for r in schema.modality_table(spark).collect()}
    assert len(table) == 10
    assert (table["sentinel2"]["max_time"], len(table["sentinel2"]["variables"])) == (100, 15)
    assert table["sentinel2"]["nodata"] == 0.0 and table["agera5"]["nodata"] is None


def test_extractors(spark):
    @extract.point_extractor("test_fragile")
    def fragile(point):
        if point.sample_idx == 3:
            raise RuntimeError("broken point")
        yield dt.datetime(2021, 1, 1), "a", 1
        if point.sample_idx == 4:
            yield None, "b", 2.5

    points = spark.range(6, numPartitions=2).select(F.col("id").alias("sample_idx"))
    got = extract.run_extractors(points, ["test_fragile"])
    bad = got.where("error IS NOT NULL").collect()
    assert [(r["sample_idx"], r["error"]) for r in bad] == [(3, "RuntimeError: broken point")]
    good = extract.observations(got).collect()
    assert len(good) == 6
    assert [(r["variable"], r["value"], r["ts"]) for r in good if r["sample_idx"] == 4] == [
        ("a", 1.0, dt.datetime(2021, 1, 1)),
        ("b", 2.5, None),
    ]
    assert "test_fragile" in extract.registered()
    with pytest.raises(KeyError):
        extract.run_extractors(points, ["nobody"])


def test_scratch_folder_comes_from_the_session(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a.startswith(base) and a != b
