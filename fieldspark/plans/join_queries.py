"""Assembly, embeddings, snapshots and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import diff, joins, spatial, stats
from . import bindings as B
from .registry import query


@query(
    "j02_assign_cell",
    "sample_idx:i cell_x:i cell_y:i",
    """SELECT sample_idx, floor(radians(lon) * 6378137 / 5000) AS cell_x,
              floor(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 / 5000) AS cell_y FROM pts""",
    B.POINTS,
)
def assign_cell(spark, d):
    return spatial.assign_cell(B.points(spark, d))


_PIXEL = (
    "floor(radians(lon) * 6378137 / 2000000) AS px, "
    "floor(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 / 2000000) AS py"
)


@query(
    "j03_sample_pixels",
    "s_suppkey:i px:i py:i year:i value:f",
    f"""SELECT s_suppkey, p.px, p.py, year, value
        FROM (SELECT zone_id AS s_suppkey, {_PIXEL} FROM zone) p
        JOIN (SELECT px, py, year(o_orderdate) AS year, max(o_totalprice) AS value
              FROM (SELECT sample_idx, {_PIXEL} FROM pts) JOIN orders ON o_custkey = sample_idx
              GROUP BY 1, 2, 3) r ON p.px = r.px AND p.py = r.py""",
    B.POINTS + B.ZONE_EDGES,
)
def sample_pixels(spark, d):
    """Suppliers read yearly images made from customer orders, with 2 000 km pixels."""
    size = 2_000_000.0
    pts = spatial.assign_cell(B.points(spark, d), size)
    raster = (
        pts.join(B.table(spark, d, "orders"), F.col("o_custkey") == F.col("sample_idx"))
        .select(
            F.col("cell_x").alias("px"),
            F.col("cell_y").alias("py"),
            F.year("o_orderdate").alias("year"),
            F.col("o_totalprice").alias("value"),
        )
    )
    places = B.table(spark, d, "supplier").select("s_suppkey", *B.lonlat("s_suppkey"))
    return spatial.sample_pixels(places, raster, size, ["value"], ["year"])


@query(
    "j04_zone_of_point",
    "sample_idx:i zone_id:i",
    """SELECT sample_idx, coalesce(min(zone_id), -1) AS zone_id
       FROM pts LEFT JOIN (
         SELECT sample_idx AS inside, zone_id FROM pts, edge
         WHERE (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax
         GROUP BY 1, 2 HAVING count(*) % 2 = 1) ON sample_idx = inside
       GROUP BY 1""",
    B.POINTS + B.ZONE_EDGES,
)
def zone_of_point(spark, d):
    return spatial.zone_of_point(B.points(spark, d), B.zones(spark, d), "sample_idx")


_CELLS = """
boxes AS (
  SELECT region_id, floor(min(ax) / 5000) AS cx0, floor(max(ax) / 5000) AS cx1,
         floor(min(ay) / 5000) AS cy0, floor(max(ay) / 5000) AS cy1
  FROM edge GROUP BY 1
),
columns_ AS (SELECT *, unnest(generate_series(CAST(cx0 AS BIGINT), CAST(cx1 AS BIGINT))) AS cell_x FROM boxes),
cells AS (SELECT region_id, cell_x,
                 unnest(generate_series(CAST(cy0 AS BIGINT), CAST(cy1 AS BIGINT))) AS cell_y FROM columns_),
tests AS (
  SELECT c.*, ax, ay, bx, by_, cell_x * 5000.0::DOUBLE AS x0, cell_y * 5000.0::DOUBLE AS y0,
         (cell_x + 1) * 5000.0::DOUBLE AS x1, (cell_y + 1) * 5000.0::DOUBLE AS y1
  FROM cells c JOIN edge e ON c.region_id = e.region_id
),
slabs AS (
  SELECT *, CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN x0 AND x1 THEN -1 ELSE 2 END
                 ELSE least((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)) END AS ex,
         CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 2 ELSE -1 END
              ELSE greatest((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)) END AS lx,
         CASE WHEN by_ = ay THEN CASE WHEN ay BETWEEN y0 AND y1 THEN -1 ELSE 2 END
              ELSE least((y0 - ay) / (by_ - ay), (y1 - ay) / (by_ - ay)) END AS ey,
         CASE WHEN by_ = ay THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 2 ELSE -1 END
              ELSE greatest((y0 - ay) / (by_ - ay), (y1 - ay) / (by_ - ay)) END AS ly
  FROM tests
),
covered AS (
  SELECT region_id, cell_x, cell_y FROM slabs GROUP BY 1, 2, 3
  HAVING bool_or(greatest(ex, ey, 0) <= least(lx, ly, 1))
      OR sum(CASE WHEN (ay > y0) <> (by_ > y0)
                   AND x0 < (bx - ax) * (y0 - ay) / (by_ - ay) + ax THEN 1 ELSE 0 END) % 2 = 1
),"""


@query(
    "j13_cover_grid",
    "region_id:i nation:i cell_x:i cell_y:i",
    "SELECT c.*, nation FROM covered c JOIN reg r ON c.region_id = r.region_id",
    B.REGION_EDGES + _CELLS,
)
def cover_grid(spark, d):
    return spatial.cover_grid(B.regions(spark, d))


@query(
    "a02_cell_crop_area",
    "l_partkey:i crop_area:f total_area:f has_crop:i",
    """SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS crop_area,
              sum(l_quantity) AS total_area, 1 AS has_crop FROM lineitem GROUP BY 1
       HAVING sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) > 150""",
)
def cell_crop_area(spark, d):
    lines = B.table(spark, d, "lineitem")
    return spatial.cell_crop_area(
        lines, ["l_partkey"], F.col("l_returnflag") == "R", "l_quantity", 150.0
    )


@query(
    "a12_mosaic",
    "l_partkey:i l_suppkey:i value:f",
    """SELECT l_partkey, l_suppkey, nullif(l_discount, 0) AS value FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey
                 ORDER BY l_discount = 0, l_orderkey * 10 + l_linenumber DESC, l_discount DESC) = 1""",
)
def mosaic(spark, d):
    tiles = B.table(spark, d, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("priority"),
        V.null_if_nodata(F.col("l_discount"), 0).alias("value"),
    )
    return spatial.mosaic(tiles, ["l_partkey", "l_suppkey"], "value", "priority")


_DEM = """
dem AS (
  SELECT l_suppkey AS gx, l_partkey // 20 AS gy, avg(l_extendedprice) / 100 AS z
  FROM lineitem WHERE l_tax > 0.02 GROUP BY 1, 2
),"""


@query(
    "w09_terrain_slope",
    "gx:i gy:i z:g slope:g",
    """SELECT c.gx, c.gy, c.z,
              degrees(atan(sqrt(pow((e.z - w.z) / 60, 2) + pow((n.z - s.z) / 60, 2)))) AS slope
       FROM dem c LEFT JOIN dem e ON e.gx = c.gx + 1 AND e.gy = c.gy
       LEFT JOIN dem w ON w.gx = c.gx - 1 AND w.gy = c.gy
       LEFT JOIN dem n ON n.gx = c.gx AND n.gy = c.gy + 1
       LEFT JOIN dem s ON s.gx = c.gx AND s.gy = c.gy - 1""",
    _DEM,
)
def terrain_slope(spark, d):
    """An elevation grid with gaps, made of average prices; 30 m cells."""
    dem = (
        B.table(spark, d, "lineitem")
        .where(F.col("l_tax") > 0.02)
        .groupBy(F.col("l_suppkey").alias("gx"), F.floor(F.col("l_partkey") / 20).alias("gy"))
        .agg((F.avg("l_extendedprice") / 100).alias("z"))
    )
    return spatial.slope(dem, 30.0)


@query(
    "j05_assemble",
    "sample_idx:i stratum:i orders_n:i orders_total:f clean_weeks:i late_total:f",
    """SELECT p.sample_idx, stratum, coalesce(o.n, 0) AS orders_n, o.total AS orders_total,
              coalesce(w.weeks, 0) AS clean_weeks, l.total AS late_total
       FROM pts p
       LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o
         ON o.o_custkey = p.sample_idx
       LEFT JOIN (SELECT sample_idx, count(*) FILTER (WHERE valid) AS weeks FROM clean GROUP BY 1) w
         ON w.sample_idx = p.sample_idx
       LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders
                  WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1) l
         ON l.o_custkey = p.sample_idx""",
    B.POINTS + B.CLEAN_SPARSE,
)
def assemble(spark, d):
    """Points with three modalities, each reduced to one row per point first."""
    orders = B.table(spark, d, "orders").withColumnRenamed("o_custkey", "sample_idx")
    per_point = orders.groupBy("sample_idx")
    sides = {
        "orders": per_point.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")),
        "weeks": B.clean_sparse(spark, d)
        .groupBy("sample_idx")
        .agg(F.count_if(F.col("valid")).alias("n")),
        "late": orders.where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
        .groupBy("sample_idx")
        .agg(F.sum("o_totalprice").alias("total")),
    }
    record = joins.assemble(B.points(spark, d).select("sample_idx", "stratum"), sides)
    return record.select(
        "sample_idx",
        "stratum",
        F.coalesce("orders.n", F.lit(0)).alias("orders_n"),
        F.col("orders.total").alias("orders_total"),
        F.coalesce("weeks.n", F.lit(0)).alias("clean_weeks"),
        F.col("late.total").alias("late_total"),
    )


@query(
    "j06_normalise",
    "sample_idx:i variable:s event_id:i value:f",
    """SELECT sample_idx, o.variable, event_id, (value - coalesce(m, 0)) / coalesce(s, 1) AS value
       FROM obs o LEFT JOIN (SELECT variable, avg(value) AS m, stddev_pop(value) AS s FROM obs
                             WHERE variable <> 'error' GROUP BY 1) t ON o.variable = t.variable""",
    B.EVENTS,
)
def normalise(spark, d):
    """Long observations; one variable has no statistics."""
    obs = B.events(spark, d)
    table = stats.masked_stats(obs.where(F.col("variable") != "error"), "value", ["variable"])
    return joins.normalise_long(obs, table, ["variable"])


@query(
    "j07_attach_embeddings",
    "sample_idx:i label:i first:f last:f",
    "SELECT sample_idx, label, z[1] AS first, z[64] AS last FROM emb",
    B.EMBEDDINGS,
)
def attach_embeddings(spark, d):
    e = B.embeddings(spark, d)
    vectors = e.select("sample_idx", F.col("z").alias("embedding"))
    joined = joins.attach_embeddings(e.select("sample_idx", "label"), vectors)
    return joined.withColumns(
        {"first": F.element_at("embedding", 1), "last": F.element_at("embedding", -1)}
    )


_SNAPSHOTS = """
b AS (
  SELECT vec_id, label, CASE
           WHEN label = 1 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 1.5)
           WHEN label = 2 THEN CAST(embedding AS DOUBLE[])[1:32]
           ELSE CAST(embedding AS DOUBLE[]) END AS v
  FROM embeddings WHERE label <> 5
),
a AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label <> 4),
diffs AS (
  SELECT 'layer.' || coalesce(a.vec_id, b.vec_id) AS key,
         CASE WHEN b.vec_id IS NULL THEN 'only_a' WHEN a.vec_id IS NULL THEN 'only_b'
              WHEN len(a.v) <> len(b.v) THEN 'shape_mismatch'
              WHEN a.label = 3 THEN 'type_mismatch'
              WHEN a.v <> b.v THEN 'value_mismatch' END AS kind,
         CASE WHEN a.label = 1 THEN list_max(list_transform(a.v, lambda x: abs(x) * 0.5)) END
           AS max_abs_diff
  FROM a FULL OUTER JOIN b ON a.vec_id = b.vec_id
),"""


def snapshots(spark, d):
    """Two versions of the vectors: dropped, cut, retyped and rescaled by label."""
    e = B.table(spark, d, "embeddings")
    v = F.col("embedding").cast("array<double>")
    y = F.col("label")
    key = lambda head: F.concat(F.lit(head + "layer."), "vec_id").alias("key")
    a = e.where(y != 4).select(key("model."), v.alias("v"), F.lit("f4").alias("t"))
    changed = (
        F.when(y == 1, F.transform(v, lambda x: x * 1.5)).when(y == 2, F.slice(v, 1, 32)).otherwise(v)
    )
    b = e.where(y != 5).select(
        key("module._orig_mod."), changed.alias("v"), F.when(y == 3, "f8").otherwise("f4").alias("t")
    )
    return diff.normalise_keys(a, "key"), diff.normalise_keys(b, "key")


DIFF = "key:s kind:s max_abs_diff:f"


@query("j08_snapshot_diff", DIFF, "SELECT * FROM diffs WHERE kind IS NOT NULL", _SNAPSHOTS)
def snapshot_diff(spark, d):
    return diff.snapshot_diff(*snapshots(spark, d), "key", "v", "t")


@query(
    "t04_diff_preview",
    DIFF,
    "SELECT * FROM diffs WHERE kind IS NOT NULL ORDER BY key LIMIT 25",
    _SNAPSHOTS,
)
def diff_preview(spark, d):
    return diff.preview(diff.snapshot_diff(*snapshots(spark, d), "key", "v", "t"), "key")


_LATE = "SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'"


def _early(spark, d):
    orders = B.table(spark, d, "orders").withColumnRenamed("o_custkey", "sample_idx")
    return orders.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))


@query(
    "j12_missing_samples",
    "sample_idx:i stratum:i",
    f"SELECT * FROM pts WHERE sample_idx NOT IN ({_LATE})",
    B.POINTS,
)
def missing_samples(spark, d):
    return joins.missing_samples(B.points(spark, d), _early(spark, d), "sample_idx")


@query(
    "j12_present_samples",
    "sample_idx:i stratum:i",
    f"SELECT * FROM pts WHERE sample_idx IN ({_LATE})",
    B.POINTS,
)
def present_samples(spark, d):
    return joins.present_samples(B.points(spark, d), _early(spark, d), "sample_idx")


@query(
    "t03_inspect_sample",
    "source:s n:i",
    """SELECT 'points' AS source, count(*) AS n FROM pts WHERE sample_idx = 7
       UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey = 7
       UNION ALL SELECT 'weekly', count(*) FROM clean WHERE sample_idx = 7""",
    B.POINTS + B.CLEAN_SPARSE,
)
def inspect_sample(spark, d):
    """Everything about one sample, counted per table."""
    tables = {
        "points": B.points(spark, d),
        "orders": B.table(spark, d, "orders").withColumnRenamed("o_custkey", "sample_idx"),
        "weekly": B.clean_sparse(spark, d),
    }
    return joins.inspect_sample(tables, 7).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s05_scatter_dense",
    "sample_idx:i dim:i value:f",
    """SELECT g.sample_idx, g.dim, coalesce(e.embedding[g.dim + 1], 0) AS value
       FROM (SELECT sample_idx, unnest(range(64)) AS dim FROM (
               SELECT unnest(range((SELECT max(vec_id) + 1 FROM embeddings WHERE label > 2)))
                 AS sample_idx)) g
       LEFT JOIN (SELECT * FROM embeddings WHERE label > 2) e ON e.vec_id = g.sample_idx""",
)
def scatter_dense(spark, d):
    """Vectors of some labels only, spread over a dense index with zero vectors between."""
    e = B.table(spark, d, "embeddings").where(F.col("label") > 2)
    dense = joins.scatter_dense(e.withColumnRenamed("vec_id", "sample_idx"), B.DIM)
    return dense.select("sample_idx", F.posexplode("embedding").alias("dim", "value"))
