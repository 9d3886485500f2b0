"""The driver tables as observation data, once as DataFrames and once as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masking, temporal, tokens

VARS = ["quantity", "price", "discount", "tax"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TEMPORAL = PRIORITIES[:4]
DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as four-variable series of suppliers."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sample_idx"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


SERIES = """
ser AS (
  SELECT l_suppkey AS sample_idx, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem
),"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sparse one-variable series of customers."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sample_idx"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
        "o_orderkey",
    )


SPARSE = """
ser AS (
  SELECT o_custkey AS sample_idx, o_orderdate AS ts, o_totalprice AS price, o_orderkey FROM orders
),"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long observations of users."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_idx"),
        "ts",
        F.col("event_type").alias("variable"),
        "value",
        "event_id",
    )


EVENTS = """
obs AS (
  SELECT user_id AS sample_idx, ts, event_type AS variable, value, event_id FROM events
),"""


def lonlat(key: str) -> tuple:
    k = F.col(key)
    lon = (k * 7919 % 36000) / F.lit(100.0) - F.lit(180.0)
    lat = (k * 104729 % 17000) / F.lit(100.0) - F.lit(85.0)
    return lon.alias("lon"), lat.alias("lat")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sample points."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sample_idx"),
        F.col("c_nationkey").alias("stratum"),
        F.col("c_mktsegment").alias("segment"),
        *lonlat("c_custkey"),
    )


def _lonlat_sql(key: str) -> str:
    return (
        f"CAST({key} * 7919 % 36000 AS DOUBLE) / 100.0::DOUBLE - 180.0::DOUBLE AS lon, "
        f"CAST({key} * 104729 % 17000 AS DOUBLE) / 100.0::DOUBLE - 85.0::DOUBLE AS lat"
    )


POINTS = f"""
pts AS (
  SELECT c_custkey AS sample_idx, c_nationkey AS stratum, c_mktsegment AS segment,
         {_lonlat_sql("c_custkey")}
  FROM customer
),"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as zones: triangles for odd nations, rectangles for even ones, in degrees."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("zone_id"),
        F.col("s_nationkey").alias("nation"),
        *lonlat("s_suppkey"),
    )
    half = F.lit(5.0) + F.col("nation")
    at = lambda dx, dy: F.struct(
        (F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y")
    )
    triangle = F.array(at(-half, -half), at(half, -half), at(F.lit(0.0), half))
    rectangle = F.array(at(-half, -half), at(half, -half), at(half, half), at(-half, half))
    return s.select("zone_id", F.when(F.col("nation") % 2 == 1, triangle).otherwise(rectangle).alias("ring"))


ZONE_EDGES = f"""
zone AS (SELECT s_suppkey AS zone_id, s_nationkey AS nation, {_lonlat_sql("s_suppkey")},
         5.0::DOUBLE + s_nationkey AS h FROM supplier),
vertex AS (
  SELECT zone_id, nation % 2 = 1 AS tri, v.i,
         lon + CASE WHEN v.i = 0 OR (v.i = 3) THEN -h WHEN v.i = 1 THEN h
                    WHEN nation % 2 = 1 THEN 0.0::DOUBLE ELSE h END AS x,
         lat + CASE WHEN v.i < 2 THEN -h ELSE h END AS y
  FROM zone, (SELECT unnest(range(4)) AS i) AS v
  WHERE v.i < 3 OR nation % 2 = 0
),
edge AS (
  SELECT zone_id, x AS ax, y AS ay,
         coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx,
         coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_
  FROM vertex WINDOW w AS (PARTITION BY zone_id ORDER BY i)
),"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as small Web-Mercator triangles and rectangles of some kilometres."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("region_id"),
        F.col("s_nationkey").alias("nation"),
        (F.col("s_suppkey") * 7919 % 36000 * F.lit(1000.0) - F.lit(18000000.0)).alias("x0"),
        (F.col("s_suppkey") * 104729 % 17000 * F.lit(1000.0) - F.lit(8500000.0)).alias("y0"),
    )
    size = F.lit(7000.0) + F.col("nation") * F.lit(900.0)
    at = lambda dx, dy: F.struct(
        (F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y")
    )
    zero = F.lit(0.0)
    triangle = F.array(at(zero, zero), at(size, zero), at(size / 2, size))
    rectangle = F.array(at(zero, zero), at(size, zero), at(size, size), at(zero, size))
    ring = F.when(F.col("nation") % 2 == 1, triangle).otherwise(rectangle)
    return s.select("region_id", "nation", ring.alias("ring"))


REGION_EDGES = """
reg AS (SELECT s_suppkey AS region_id, s_nationkey AS nation,
        (s_suppkey * 7919 % 36000) * 1000.0::DOUBLE - 18000000.0::DOUBLE AS x0,
        (s_suppkey * 104729 % 17000) * 1000.0::DOUBLE - 8500000.0::DOUBLE AS y0,
        7000.0::DOUBLE + s_nationkey * 900.0::DOUBLE AS size FROM supplier),
vertex AS (
  SELECT region_id, v.i,
         x0 + CASE WHEN v.i IN (0, 3) THEN 0.0::DOUBLE WHEN v.i = 1 THEN size
                   WHEN nation % 2 = 1 THEN size / 2 ELSE size END AS x,
         y0 + CASE WHEN v.i < 2 THEN 0.0::DOUBLE ELSE size END AS y
  FROM reg, (SELECT unnest(range(4)) AS i) AS v
  WHERE v.i < 3 OR nation % 2 = 0
),
edge AS (
  SELECT region_id, x AS ax, y AS ay,
         coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx,
         coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_
  FROM vertex WINDOW w AS (PARTITION BY region_id ORDER BY i)
),"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a four-class label, batches of 50 and a reference vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_idx"),
        F.floor(F.col("vec_id") / 50).alias("batch_id"),
        (F.col("label") % 4).alias("label"),
        F.col("embedding").cast("array<double>").alias("z"),
        F.reverse("embedding").cast("array<double>").alias("s"),
    )


EMBEDDINGS = """
emb AS (
  SELECT vec_id AS sample_idx, vec_id // 50 AS batch_id, label % 4 AS label,
         CAST(embedding AS DOUBLE[]) AS z, CAST(list_reverse(embedding) AS DOUBLE[]) AS s
  FROM embeddings
),"""

# every ordered pair of a batch with cosine and distances; for the SQL side only
PAIRS = (
    EMBEDDINGS
    + """
unit AS (
  SELECT *, list_transform(z, lambda x: x / greatest(sqrt(list_dot_product(z, z)), 1e-12)) AS uz,
            list_transform(s, lambda x: x / greatest(sqrt(list_dot_product(s, s)), 1e-12)) AS us
  FROM emb
),
pairs AS (
  SELECT a.batch_id, a.sample_idx AS i, b.sample_idx AS j, a.label AS yi, b.label AS yj,
         list_dot_product(a.uz, b.uz) AS sim, list_distance(a.z, b.z) AS dist,
         list_distance(a.uz, b.uz) AS dz, list_distance(a.us, b.us) AS ds
  FROM unit a JOIN unit b ON a.batch_id = b.batch_id AND a.sample_idx <> b.sample_idx
),"""
)


def order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tokens: customer sequences with one modality per priority."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sample_idx"),
        F.floor(F.col("o_custkey") / 50).alias("batch_id"),
        F.col("o_orderpriority").alias("modality"),
        F.col("o_orderdate").alias("ts"),
        "o_orderkey",
    )
    return tokens.token_table(orders, "sample_idx", "ts", ["o_orderkey"], PRIORITIES, TEMPORAL)


ORDER_TOKENS = """
tok AS (
  SELECT o_custkey AS sample_idx, o_custkey // 50 AS batch_id, o_orderpriority AS modality,
         o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS modality_idx,
         row_number() OVER (PARTITION BY o_custkey
                            ORDER BY o_orderpriority, o_orderdate, o_orderkey) - 1 AS token_pos,
         o_orderpriority <> '5-LOW' AS is_temporal,
         CASE WHEN o_orderpriority <> '5-LOW' THEN (row_number() OVER (
                PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1) % 52
              ELSE 0 END AS week_idx
  FROM orders
),"""


def clean_ctes(variables: Sequence[str], nodata: bool = False) -> str:
    """CTEs from ``ser`` to ``clean``, the 52-week series."""
    names = ", ".join(variables)
    raw = ", ".join(f"nullif({v}, 0) AS {v}" if nodata else v for v in variables)
    means = ", ".join(f"avg({v}) AS {v}" for v in variables)
    return f"""
nod AS (SELECT sample_idx, ts, {raw} FROM ser),
weekly AS (
  SELECT sample_idx, CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS week_end, {means}
  FROM nod GROUP BY 1, 2
),
spans AS (SELECT sample_idx, min(week_end) AS a, max(week_end) AS b FROM weekly GROUP BY 1),
grid AS (
  SELECT sample_idx, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
                                                 INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM spans
),
filled AS (
  SELECT g.sample_idx, g.week_end, {names}
  FROM grid g LEFT JOIN weekly w ON g.sample_idx = w.sample_idx AND g.week_end = w.week_end
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY week_end) - 1 AS pos FROM filled
),
slots AS (SELECT sample_idx, unnest(range(52)) AS pos FROM spans),
clean AS (
  SELECT s.sample_idx, s.pos, r.week_end,
         CASE WHEN r.week_end IS NULL THEN 'NA'
              ELSE year(r.week_end) || '-W' || lpad(CAST(weekofyear(r.week_end) AS VARCHAR), 2, '0')
         END AS week_key,
         coalesce({names}) IS NOT NULL AS valid, {names},
         CASE WHEN r.week_end IS NULL THEN 0
              ELSE sin(2 * pi() * weekofyear(r.week_end) / 52) END AS week_sin,
         CASE WHEN r.week_end IS NULL THEN 0
              ELSE cos(2 * pi() * weekofyear(r.week_end) / 52) END AS week_cos
  FROM slots s LEFT JOIN ranked r ON s.sample_idx = r.sample_idx AND s.pos = r.pos
),"""


CLEAN_SERIES = SERIES + clean_ctes(VARS, nodata=True)
CLEAN_SPARSE = SPARSE + clean_ctes(["price"])


def clean_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.clean_series(series(spark, sf_dir), ["sample_idx"], "ts", VARS, nodata=0.0)


def clean_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.clean_series(sparse(spark, sf_dir), ["sample_idx"], "ts", ["price"])


def cells_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tokens of their order, masked at random."""
    lines, price = table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")
    keyed = lines.select(
        F.col("l_orderkey").alias("sample_idx"),
        F.concat_ws(
            ":", "l_linenumber", "l_partkey", "l_suppkey", F.round(price * 100).cast("bigint")
        ).alias("token_pos"),
        F.col("l_returnflag").alias("modality"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
    )
    return masking.mask_random(keyed, "sample_idx")


CELLS_MASKED = """
cells AS (
  SELECT l_orderkey AS sample_idx, l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' ||
           CAST(round(l_extendedprice * 100) AS BIGINT) AS token_pos,
         l_returnflag AS modality, l_extendedprice AS price, l_quantity AS quantity
  FROM lineitem
),
masked AS (
  SELECT *, row_number() OVER (PARTITION BY sample_idx
              ORDER BY md5('42|' || sample_idx || '|' || token_pos), token_pos)
            <= floor(count(*) OVER (PARTITION BY sample_idx) * 0.75::DOUBLE) AS masked
  FROM cells
),"""


def digest(seed: int, *parts: str) -> str:
    """SQL of `functions.values.seeded_hash`."""
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5('{seed}|' || {joined})"


def uniform(text: str) -> str:
    """SQL of `functions.values.hash_uniform`."""
    return f"CAST(CAST('0x' || substr({text}, 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE"


