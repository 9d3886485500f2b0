"""Streaming results equal batch results."""

import datetime as dt


from fieldspark.operators import temporal
from fieldspark.plans import bindings as B
from fieldspark.streaming import ingest, weekly

SCHEMA = "sample_idx bigint, modality string, ts timestamp_ntz, variable string, value double, error string"


def batch(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, base):
    query = ingest.stream_ingest(
        spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", spark.createDataFrame([], SCHEMA).schema
    )
    query.awaitTermination()


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    at = lambda d: dt.datetime(2021, 1, d)
    first = [(1, "m", at(1), "v", 1.0, None), (2, "m", at(2), "v", 2.0, None), (3, "m", at(2), "v", None, "bad")]
    batch(spark, f"{tmp_path}/in", first)
    run(spark, tmp_path)
    batch(spark, f"{tmp_path}/in", [first[1], (4, "m", at(3), "v", 4.0, None)])
    run(spark, tmp_path)
    run(spark, tmp_path)
    clean = ingest.read_ingested(spark, str(tmp_path / "out"))
    assert sorted((r["sample_idx"], r["value"]) for r in clean.collect()) == [(1, 1.0), (2, 2.0), (4, 4.0)]
    dead = ingest.read_dead_letters(spark, str(tmp_path / "out")).collect()
    assert [(r["sample_idx"], r["error"]) for r in dead] == [(3, "bad")]


def test_whole_year_deliveries_lose_nothing(spark, tmp_path):
    months = [dt.datetime(2021, m, 1) for m in range(1, 13)]
    point = lambda i, at: (i, "m", at, "v", float(i), None)
    failed = (5, "m", months[0], "v", None, "timeout")
    timeless = [(6, "m", None, None, None, e) for e in ("first", "second")]
    deliveries = [
        [point(i, at) for i in range(5) for at in months] + [failed, *timeless],
        [point(i, at) for i in range(5, 10) for at in months],
        [point(i, at) for i in range(10) for at in months[:6]] + [failed, timeless[0]],
    ]
    for rows in deliveries:
        batch(spark, f"{tmp_path}/in", rows)
    ingest.stream_ingest(
        spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp",
        spark.createDataFrame([], SCHEMA).schema, files_per_batch=1,
    ).awaitTermination()
    clean = ingest.read_ingested(spark, str(tmp_path / "out")).collect()
    assert sorted((r["sample_idx"], r["ts"]) for r in clean) == [(i, at) for i in range(10) for at in months]
    dead = ingest.read_dead_letters(spark, str(tmp_path / "out")).collect()
    assert sorted(r["error"] for r in dead) == ["first", "second", "timeout"]


def test_repeated_micro_batch_replaces_its_output(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m", dt.datetime(2021, 1, 1), "v", 1.0, None)], SCHEMA)
    for _ in range(2):
        ingest.write_micro_batch(rows, 0, str(tmp_path))
    assert ingest.read_ingested(spark, str(tmp_path)).count() == 1


def weekly_table(spark, small_dir, base, mode, agg):
    schema = B.table(spark, small_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(small_dir)
    weeks = weekly.stream_weekly(source, ["user_id", "event_type"], "ts", ["value"], agg)
    weeks.writeStream.outputMode(mode).foreachBatch(
        lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")
    ).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return {
        (r["user_id"], r["event_type"], r["week_end"]): round(r["value"], 9)
        for r in spark.read.parquet(f"{base}/out").collect()
    }


def test_weekly_stream_equals_batch(spark, small_dir, tmp_path):
    events = B.table(spark, small_dir, "events")
    for agg in ("mean", "max"):
        expected = {
            (r["user_id"], r["event_type"], r["week_end"]): round(r["value"], 9)
            for r in temporal.weekly_resample(events, ["user_id", "event_type"], "ts", ["value"], agg).collect()
        }
        assert weekly_table(spark, small_dir, tmp_path / agg, "complete", agg) == expected


def test_append_mode_holds_back_open_weeks(spark, small_dir, tmp_path):
    complete = weekly_table(spark, small_dir, tmp_path / "c", "complete", "mean")
    append = weekly_table(spark, small_dir, tmp_path / "a", "append", "mean")
    assert 0 < len(append) < len(complete)
    assert append.items() <= complete.items()
    newest = max(k[2] for k in complete)
    assert max(k[2] for k in append) < newest - dt.timedelta(days=7)


def test_medians_are_refused(spark, small_dir):
    stream = spark.readStream.schema(B.table(spark, small_dir, "events").schema).parquet(small_dir)
    try:
        weekly.stream_weekly(stream, ["user_id"], "ts", ["value"], "median")
    except ValueError as error:
        assert "batch" in str(error)
    else:
        raise AssertionError("a median stream was accepted")


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "k int, ts timestamp_ntz, v double"
    path = f"{tmp_path}/in"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def go():
        source = spark.readStream.schema(schema).parquet(path)
        weeks = weekly.stream_weekly(source, ["k"], "ts", ["v"], "mean")
        weeks.writeStream.outputMode("append").foreachBatch(
            lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")
        ).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    write([(1, dt.datetime(2021, 1, 5), 2.0), (1, dt.datetime(2021, 6, 1), 1.0)])
    go()
    write([(1, dt.datetime(2021, 1, 6), 100.0), (1, dt.datetime(2021, 9, 1), 1.0)])
    go()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    january = [r["v"] for r in got if r["week_end"] == dt.date(2021, 1, 10)]
    assert january == [2.0]


def placed(spark, rows):
    return ingest._placed(spark.createDataFrame(rows, SCHEMA).drop("error"), 99)


def test_micro_batch_reads_only_what_it_touches(spark, tmp_path):
    """The stored scan is filtered by partition, and reads no file of another month."""
    at = lambda m: dt.datetime(2021, m, 3)
    rows = [(i, "m", at(m), "v", 1.0, None) for m in range(1, 13) for i in range(40)]
    ingest.write_micro_batch(spark.createDataFrame(rows, SCHEMA), 0, str(tmp_path))
    new = placed(spark, [(5, "m", at(4), "v", 2.0, None), (6, "m", at(5), "v", 2.0, None)])
    near = ingest.stored_near(new, f"{tmp_path}/clean", 99)
    plan = near._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "month" in filters and "bucket" in filters and "batch_id" in filters
    files = {r["f"] for r in near.selectExpr("input_file_name() as f").distinct().collect()}
    assert files and all("month=202104" in f or "month=202105" in f for f in files)
    assert len(files) == 2
    ingest.write_micro_batch(spark.createDataFrame(rows[:3] + [(99, "m", at(1), "v", 9.0, None)], SCHEMA), 1, str(tmp_path))
    assert ingest.read_ingested(spark, str(tmp_path)).count() == 12 * 40 + 1


def test_store_without_rows_can_be_read(spark, tmp_path):
    ingest.write_micro_batch(spark.createDataFrame([], SCHEMA), 0, str(tmp_path))
    assert ingest.read_ingested(spark, str(tmp_path)).columns == ["sample_idx", "modality", "ts", "variable", "value"]
    assert ingest.read_dead_letters(spark, str(tmp_path)).count() == 0


def test_weeks_merge_in_any_order(spark, small_dir, tmp_path):
    events = B.table(spark, small_dir, "events").withColumnRenamed("value", "v")
    keys = ["user_id", "event_type"]
    out = str(tmp_path)
    parts = [events.where(f"pmod(hash(ts, user_id), 3) = {i}") for i in range(3)]
    for batch, part in enumerate(parts[:2]):
        weekly.write_week_parts(part, batch, out, keys, "ts", ["v"])
    weekly.compact_weeks(spark, out, keys, ["v"])
    weekly.compact_weeks(spark, out, keys, ["v"])
    for _ in range(2):  # a repeated micro-batch counts once
        weekly.write_week_parts(parts[2], 2, out, keys, "ts", ["v"])
    for agg in ("mean", "max"):
        rows = lambda df: {(r["user_id"], r["event_type"], r["week_end"]): round(r["v"], 9) for r in df.collect()}
        expected = rows(temporal.weekly_resample(events, keys, "ts", ["v"], agg))
        assert rows(weekly.read_weeks(spark, out, keys, ["v"], agg)) == expected
    weekly.compact_weeks(spark, out, keys, ["v"])
    assert rows(weekly.read_weeks(spark, out, keys, ["v"], "max")) == expected
    try:
        weekly.read_weeks(spark, out, keys, ["v"], "median")
    except ValueError as error:
        assert "batch" in str(error)
    else:
        raise AssertionError("a median of stored weeks was accepted")


def test_stored_weeks_without_values(spark, tmp_path):
    """A week of missing readings only is a week with a null, as in the batch job."""
    rows = [(1, dt.datetime(2021, 1, 5), None), (1, dt.datetime(2021, 1, 6), float("nan")), (2, dt.datetime(2021, 1, 5), 3.0)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double")
    weekly.write_week_parts(df, 0, str(tmp_path), ["k"], "ts", ["v"])
    got = {r["k"]: r["v"] for r in weekly.read_weeks(spark, str(tmp_path), ["k"], ["v"]).collect()}
    assert got == {1: None, 2: 3.0}
