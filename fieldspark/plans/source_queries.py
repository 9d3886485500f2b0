"""Sources and sinks: written below the shared scratch folder and read back."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..operators import ranking
from ..session import scratch_dir
from ..sources import dataset, embeddings, extract, failures, features, observations, stats_json
from . import bindings as B
from .registry import query
from .stats_queries import _AGG, _COORDS, _ENCODED, STATS, _unpivot, all_stats


@query(
    "s01_read_features",
    "id:s lon:f lat:f grid_id:i country:s classification:i",
    """SELECT stratum || '_' || sample_idx AS id, lon, lat, stratum AS grid_id, segment AS country,
              CASE WHEN stratum > 12 THEN stratum ELSE -1 END AS classification FROM pts""",
    B.POINTS,
)
def read_features(spark, d):
    """Points written as line-delimited features and read back."""
    path = scratch_dir(spark, "features")
    points = B.points(spark, d).select(
        F.concat_ws("_", "stratum", "sample_idx").alias("id"),
        "lon",
        "lat",
        F.col("stratum").alias("grid_id"),
        F.col("segment").alias("country"),
        F.when(F.col("stratum") > 12, F.col("stratum")).alias("classification"),
    )
    features.write_features(points, path, ["grid_id", "country", "classification"])
    rows = features.read_features(spark, path)
    return rows.select(
        "id",
        "lon",
        "lat",
        "properties.grid_id",
        "properties.country",
        F.coalesce("properties.classification", F.lit(-1)).alias("classification"),
    )


@query(
    "s02_write_polygons",
    "zone_id:s i:i x:f y:f",
    "SELECT zone_id, i, x, y FROM vertex",
    B.ZONE_EDGES,
)
def write_polygons(spark, d):
    """Zones written as polygon features and read back, one row per vertex."""
    path = scratch_dir(spark, "polygons")
    zones = B.zones(spark, d).select(F.col("zone_id").alias("id"), "ring")
    features.write_polygons(zones, path, ["id"])
    rows = features.read_polygons(spark, path)
    return rows.select(F.col("id").alias("zone_id"), F.posexplode("ring").alias("i", "v")).select(
        "zone_id", "i", "v.x", "v.y"
    )


@query(
    "s03_read_modality",
    "sample_idx:i ts:d price:f quantity:f",
    """SELECT sample_idx, ts, price, quantity FROM ser
       WHERE ts >= TIMESTAMP '1996-02-10' AND ts < TIMESTAMP '1997-01-01'""",
    B.SERIES,
)
def read_modality(spark, d):
    """A modality table partitioned by month; a date range of two variables."""
    path = scratch_dir(spark, "modality")
    observations.write_modality(B.series(spark, d), path, "ser")
    return observations.read_modality(
        spark, path, "ser", "1996-02-10", "1997-01-01", ["price", "quantity"]
    )


@query(
    "s04_read_embeddings",
    "sample_idx:i dim:i value:f",
    """SELECT vec_id AS sample_idx, unnest(range(64)) AS dim, unnest(embedding) AS value
       FROM embeddings""",
)
def read_embeddings(spark, d):
    """CSV columns emb_0..emb_63 in numeric order."""
    path = scratch_dir(spark, "embeddings")
    e = B.table(spark, d, "embeddings").withColumnRenamed("vec_id", "sample_idx")
    embeddings.write_embeddings(e, path, B.DIM)
    rows = embeddings.read_embeddings(spark, path)
    return rows.select("sample_idx", F.posexplode("embedding").alias("dim", "value"))


@query(
    "s06_write_dataset",
    "name:s n:i",
    """SELECT 'metadata' AS name, count(*) AS n FROM pts
       UNION ALL SELECT 'weekly', count(*) FROM clean
       UNION ALL SELECT 'total_samples', count(*) FROM pts
       UNION ALL SELECT 'merged_from_batches', 4
       UNION ALL SELECT 'chunk_size', 128 UNION ALL SELECT 'shard_size', 1024""",
    B.POINTS + B.CLEAN_SPARSE,
)
def write_dataset(spark, d):
    """Metadata and weekly tables written with their info row; counts after reading back."""
    path = scratch_dir(spark, "dataset")
    tables = {"metadata": B.points(spark, d), "weekly": B.clean_sparse(spark, d)}
    dataset.write_dataset(tables, path, created="2024-01-01", merged_from=4)
    stored = dataset.read_dataset(spark, path, list(tables))
    names = ["total_samples", "merged_from_batches", "chunk_size", "shard_size"]
    info = stored["dataset_info"].unpivot([], names, "name", "n")
    count = lambda n: stored[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("metadata").unionByName(count("weekly")).unionByName(info)


@query(
    "s07_merge_batches",
    "sample_idx:i batch:i o_orderkey:i price:f",
    """SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS sample_idx,
              CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS batch, o_orderkey,
              CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_totalprice END AS price
       FROM orders""",
)
def merge_batches(spark, d):
    """Five batch outputs, each with its own index, between two absent ones; one lacks a column."""
    base = scratch_dir(spark, "batches")
    ranked = B.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), "o_orderpriority"
    )
    from ..operators.ranking import position_in_group

    local = position_in_group(ranked, ["o_orderpriority"], "o_orderkey").withColumn(
        "sample_idx", F.col("_rank") - 1
    )
    for number, priority in enumerate(B.PRIORITIES, start=1):
        columns = ["sample_idx", "o_orderkey"] + ([] if number == 3 else ["price"])
        rows = local.where(F.col("o_orderpriority") == priority).select(*columns)
        rows.write.mode("overwrite").parquet(f"{base}/batch_{number:03d}")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        batches = dataset.read_batches(spark, [f"{base}/batch_{n:03d}" for n in range(7)])
    return dataset.merge_batches(batches)


@query(
    "s08_first_nonempty_names",
    "modality:s names:s",
    """SELECT modality, arg_min(names, batch) AS names FROM (
         SELECT month(o_orderdate) + 12 * year(o_orderdate) AS batch, o_orderpriority AS modality,
                string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS names
         FROM orders WHERE o_totalprice > 490000 GROUP BY 1, 2) GROUP BY 1""",
)
def first_nonempty_names(spark, d):
    """Monthly batches; the names of a modality stay empty until a large order occurs."""
    large = F.when(F.col("o_totalprice") > 490000, F.col("o_orderstatus"))
    batches = (
        B.table(spark, d, "orders")
        .groupBy(
            (F.month("o_orderdate") + 12 * F.year("o_orderdate")).alias("batch"),
            F.col("o_orderpriority").alias("modality"),
        )
        .agg(F.array_sort(F.collect_set(large)).alias("names"))
    )
    return dataset.first_nonempty_names(batches).withColumn("names", F.concat_ws(",", "names"))


@query(
    "s09_relayout",
    "shard_id:i chunk_id:i n:i first:i last:i",
    """SELECT o_orderkey // 1024 AS shard_id, o_orderkey // 128 AS chunk_id, count(*) AS n,
              min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1, 2""",
)
def relayout(spark, d):
    """Orders rewritten in index order with chunk and shard numbers."""
    path = scratch_dir(spark, "relayout")
    orders = B.table(spark, d, "orders").withColumnRenamed("o_orderkey", "sample_idx")
    dataset.write_relayout(orders, path)
    return (
        spark.read.parquet(path)
        .groupBy("shard_id", "chunk_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("sample_idx").alias("first"),
            F.max("sample_idx").alias("last"),
        )
    )


_RESULTS = """
res AS (
  SELECT user_id AS point, strftime(ts, '%Y-%m-%d') AS modality,
         CASE WHEN event_type IN ('error', 'view', 'click') OR user_id < 20
              THEN 'event ' || event_id END AS error
  FROM events
),
per AS (
  SELECT point, modality, bool_or(error IS NULL) AS ok, min(error) AS error FROM res GROUP BY 1, 2
),"""


def results(spark, d):
    """Events as extraction results: days as modalities, some event types as failures."""
    e = B.table(spark, d, "events")
    failed = F.col("event_type").isin("error", "view", "click") | (F.col("user_id") < 20)
    return e.select(
        F.col("user_id").alias("point"),
        F.date_format("ts", "yyyy-MM-dd").alias("modality"),
        F.when(failed, F.concat(F.lit("event "), F.col("event_id"))).alias("error"),
    )


@query(
    "s10_split_failures",
    "point:i kind:s reason:s",
    """SELECT per.point, CASE WHEN max(n) > 16 THEN 'save' WHEN bool_or(ok) THEN 'partial' ELSE 'full' END AS kind,
              CASE WHEN max(n) > 16 THEN 'Record not stored: ' || max(n) || ' rows, at most 16 fit'
              ELSE CASE WHEN bool_or(ok) THEN 'Some modalities missing: ' ELSE 'No modality delivered: ' END ||
              string_agg(modality || ': ' || error, '; ' ORDER BY modality || ': ' || error)
                FILTER (WHERE NOT ok) END AS reason
       FROM per JOIN (SELECT point, count(*) AS n FROM res GROUP BY 1) s ON per.point = s.point
       GROUP BY 1 HAVING max(n) > 16 OR count(*) FILTER (WHERE NOT ok) > 0""",
    _RESULTS,
)
def split_failures(spark, d):
    """Dead letters written per kind and read back; a record holds 16 rows, longer ones cannot be stored."""
    path = scratch_dir(spark, "failures")
    rows = results(spark, d)
    saves = ranking.split_long(rows, ["point"], 16)[1]
    split = failures.split_failures(rows, "point", "modality", "error", saves)
    failures.write_failures(split, path)
    return spark.read.schema("point bigint, reason string, kind string").json(path)


@query(
    "s11_failure_summary",
    "total:i failed:i partial:i",
    """SELECT count(*) AS total, count(*) FILTER (WHERE NOT any_ok) AS failed,
              count(*) FILTER (WHERE any_ok AND NOT all_ok) AS partial
       FROM (SELECT point, bool_or(ok) AS any_ok, bool_and(ok) AS all_ok FROM per GROUP BY 1)""",
    _RESULTS,
)
def failure_summary(spark, d):
    return failures.failure_summary(results(spark, d), "point", "modality", "error")


@query(
    "s12_stats_json",
    "section:s modality:s variable:s " + STATS,
    f"""SELECT section, modality, variable, {_AGG} FROM ({_ENCODED}
        UNION ALL SELECT 'temporal_modalities', 'ser', * FROM ({_unpivot('clean', B.VARS, 'valid')})
        UNION ALL SELECT 'static_modalities', 'elevation', 'elevation', c_acctbal FROM customer)
        GROUP BY 1, 2, 3""",
    B.CLEAN_SERIES + B.POINTS + _COORDS,
)
def stats_round_trip(spark, d):
    """Statistics of all sections as nested JSON and back."""
    path = scratch_dir(spark, "stats")
    stats_json.write_stats(all_stats(spark, d), path)
    return stats_json.read_stats(spark, path)


@query(
    "s13_distinct_names",
    "name:s",
    "SELECT DISTINCT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def distinct_names(spark, d):
    """Names of the countries with points, written as lines and read back."""
    path = scratch_dir(spark, "names")
    c = B.table(spark, d, "customer").join(
        B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    dataset.write_names(c, "n_name", path)
    return spark.read.text(path).withColumnRenamed("value", "name")


@query(
    "u01_union_batches",
    "o_orderkey:i price:f status:s",
    """SELECT o_orderkey, o_totalprice AS price, NULL AS status FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'""",
)
def union_batches(spark, d):
    """Two batches with different columns."""
    o = B.table(spark, d, "orders")
    still_open = o.where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_totalprice").alias("price"))
    closed = o.where("o_orderstatus <> 'O'").select(F.col("o_orderstatus").alias("status"), "o_orderkey")
    return dataset.union_batches([still_open, closed])


@extract.point_extractor("outside")
def _outside(point):
    """Stands for outside code that handles one point; it fails in the west."""
    if point.lon < -90:
        raise ValueError("no data")
    return [(None, "lat_abs", abs(point.lat))]


@query(
    "x01_run_extractors",
    "sample_idx:i modality:s variable:s value:f error:s",
    """SELECT sample_idx, 'elevation' AS modality, 'elevation' AS variable,
              c_acctbal AS value, NULL AS error FROM pts JOIN customer ON c_custkey = sample_idx
       UNION ALL
       SELECT sample_idx, 'outside', CASE WHEN lon < -90 THEN NULL ELSE 'lat_abs' END,
              CASE WHEN lon < -90 THEN NULL ELSE abs(lat) END,
              CASE WHEN lon < -90 THEN 'ValueError: no data' END FROM pts""",
    B.POINTS,
)
def run_extractors(spark, d):
    """An extractor over all points and one per point whose failures become rows."""
    balance = B.table(spark, d, "customer").select(
        F.col("c_custkey").alias("sample_idx"), F.col("c_acctbal").alias("value")
    )

    @extract.extractor("elevation")
    def elevation(points):
        joined = points.join(balance, "sample_idx")
        return joined.select(
            "sample_idx",
            F.lit(None).cast("timestamp_ntz").alias("ts"),
            F.lit("elevation").alias("variable"),
            "value",
        )

    return extract.run_extractors(B.points(spark, d), ["elevation", "outside"])
