"""Weekly series, gap filling, interpolation and ordered records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, interpolate, ranking, temporal, tokens
from . import bindings as B
from .registry import query

KEY = ["sample_idx"]
SERIES_SPEC = "sample_idx:i week_end:d quantity:f price:f discount:f tax:f"
CLEAN_SPEC = (
    "sample_idx:i pos:i week_end:d week_key:s valid:b quantity:f price:f discount:f tax:f "
    "week_sin:f week_cos:f"
)


def _weekly_sql(fn: str) -> str:
    values = ", ".join(f"{fn}({v}) AS {v}" for v in B.VARS)
    return (
        "SELECT sample_idx, CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS week_end, "
        f"{values} FROM ser GROUP BY 1, 2"
    )


@query("clean_weekly_series", CLEAN_SPEC, "SELECT * FROM clean", B.CLEAN_SERIES)
def clean_weekly_series(spark, d):
    """Observations to cleaned, encoded 52-week series."""
    return B.clean_series(spark, d)


NORM_SPEC = (
    "sample_idx:i pos:i week_key:s valid:b quantity:f price:f discount:f tax:f week_sin:f week_cos:f"
)
_NORM = ", ".join(
    f"({v} - (SELECT avg({v}) FROM clean WHERE valid)) / "
    f"nullif((SELECT stddev_pop({v}) FROM clean WHERE valid), 0) AS {v}"
    for v in B.VARS
)


@query(
    "normalised_weekly_series",
    NORM_SPEC,
    f"SELECT sample_idx, pos, week_key, valid, week_sin, week_cos, {_NORM} FROM clean",
    B.CLEAN_SERIES,
)
def normalised_weekly_series(spark, d):
    """The cleaned series, normalised by the statistics of its valid weeks."""
    from ..operators import joins

    clean = B.clean_series(spark, d)
    return joins.normalise_wide(clean, joins.wide_stats(clean, B.VARS, "valid"), B.VARS)


@query("a01_weekly_mean", SERIES_SPEC, _weekly_sql("avg"), B.SERIES)
def weekly_mean(spark, d):
    return temporal.weekly_resample(B.series(spark, d), KEY, "ts", B.VARS)


@query("a01_weekly_median", SERIES_SPEC, _weekly_sql("median"), B.SERIES)
def weekly_median(spark, d):
    return temporal.weekly_resample(B.series(spark, d), KEY, "ts", B.VARS, "median")


@query("a01_weekly_max", SERIES_SPEC, _weekly_sql("max"), B.SERIES)
def weekly_max(spark, d):
    return temporal.weekly_resample(B.series(spark, d), KEY, "ts", B.VARS, "max")


@query(
    "a01_weekly_observations",
    "sample_idx:i variable:s week_end:d week_key:s value:f",
    """SELECT *, year(week_end) || '-W' || lpad(CAST(weekofyear(week_end) AS VARCHAR), 2, '0')
              AS week_key
       FROM (SELECT sample_idx, variable,
                    CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS week_end,
                    avg(value) AS value
             FROM obs GROUP BY 1, 2, 3)""",
    B.EVENTS,
)
def weekly_observations(spark, d):
    from ..functions import time as TM

    weekly = temporal.weekly_resample(
        B.events(spark, d), ["sample_idx", "variable"], "ts", ["value"]
    )
    return weekly.withColumn("week_key", TM.week_key(F.col("week_end")))


@query(
    "j09_fill_weeks",
    "sample_idx:i week_end:d price:f",
    "SELECT sample_idx, week_end, price FROM filled",
    B.CLEAN_SPARSE,
)
def fill_weeks(spark, d):
    weekly = temporal.weekly_resample(B.sparse(spark, d), KEY, "ts", ["price"])
    return temporal.fill_weeks(weekly, KEY, ["price"])


@query(
    "w03_clip_pad",
    "sample_idx:i pos:i week_key:s valid:b price:f",
    """SELECT s.sample_idx, s.pos, coalesce(year(w.week_end) || '-W' ||
              lpad(CAST(weekofyear(w.week_end) AS VARCHAR), 2, '0'), 'NA') AS week_key,
              price IS NOT NULL AS valid, price
       FROM (SELECT c_custkey AS sample_idx, unnest(range(52)) AS pos FROM customer) s
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY week_end) - 1 AS pos
                  FROM weekly) w ON s.sample_idx = w.sample_idx AND s.pos = w.pos""",
    B.CLEAN_SPARSE,
)
def clip_pad(spark, d):
    """Weeks without gap filling, so that short series are padded; all customers appear."""
    weekly = temporal.weekly_resample(B.sparse(spark, d), KEY, "ts", ["price"])
    return temporal.clip_pad(weekly, KEY, ["price"], samples=B.points(spark, d))


# known points, the line each one carries, and the line every row takes
_LINES = """
known AS (
  SELECT sample_idx, pos, {v} AS v, row_number() OVER (PARTITION BY sample_idx ORDER BY pos) AS k
  FROM {src} WHERE {cond}
),
seg AS (
  SELECT *, lead(pos) OVER w AS pos2, lead(v) OVER w AS v2 FROM known
  WINDOW w AS (PARTITION BY sample_idx ORDER BY k)
),
line AS (
  SELECT sample_idx, k, pos AS p, v,
         coalesce((v2 - v) / (pos2 - pos),
                  lag((v2 - v) / (pos2 - pos)) OVER (PARTITION BY sample_idx ORDER BY k)) AS slope
  FROM seg
),
placed AS (
  SELECT *, greatest(1, sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER (
              PARTITION BY sample_idx ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS k
  FROM {src}
),"""


@query(
    "w05_interpolate_linear",
    "sample_idx:i pos:i valid:b price:g",
    """SELECT p.sample_idx, p.pos, p.valid,
              coalesce(p.price, l.v + (p.pos - l.p) * coalesce(l.slope, 0)) AS price
       FROM placed p LEFT JOIN line l ON p.sample_idx = l.sample_idx AND p.k = l.k""",
    B.CLEAN_SPARSE + _LINES.format(v="price", src="clean", cond="price IS NOT NULL"),
)
def interpolate_linear(spark, d):
    return interpolate.interpolate_linear(B.clean_sparse(spark, d), KEY, "pos", ["price"])


@query(
    "w06_interpolate_nodata",
    "sample_idx:i pos:i l_orderkey:i l_linenumber:i l_partkey:i discount:g",
    """SELECT p.sample_idx, p.pos, p.l_orderkey, p.l_linenumber, p.l_partkey,
              coalesce(nullif(p.discount, 0), l.v + (p.pos - l.p) * l.slope, p.discount) AS discount
       FROM placed p LEFT JOIN line l ON p.sample_idx = l.sample_idx AND p.k = l.k""",
    B.SERIES
    + """
src AS (
  SELECT *, row_number() OVER (PARTITION BY sample_idx
              ORDER BY ts, l_orderkey, l_linenumber, l_partkey) AS pos
  FROM ser WHERE discount IS NOT NULL
),"""
    + _LINES.format(v="discount", src="src", cond="discount <> 0"),
)
def interpolate_nodata(spark, d):
    return interpolate.interpolate_nodata(
        B.series(spark, d), KEY, "ts", ["l_orderkey", "l_linenumber", "l_partkey"], ["discount"]
    )


# The banded elimination of a spline, one knot after the other: down, then up again.
_SPLINE = """
knot AS (
  SELECT sample_idx, pos::DOUBLE AS x, price AS y, row_number() OVER s - 1 AS k,
         count(*) OVER (PARTITION BY sample_idx) AS n
  FROM clean WHERE price IS NOT NULL WINDOW s AS (PARTITION BY sample_idx ORDER BY pos)
),
step AS (
  SELECT *, lead(x) OVER s - x AS h, x - lag(x) OVER s AS g, lead(x) OVER s AS x1, lead(y) OVER s AS y1,
         (lead(y) OVER s - y) / (lead(x) OVER s - x) - (y - lag(y) OVER s) / (x - lag(x) OVER s) AS turn
  FROM knot WINDOW s AS (PARTITION BY sample_idx ORDER BY k)
),
band AS (
  SELECT sample_idx, k, n, g, h, 6 * turn AS r,
         CASE WHEN k = 1 THEN 0 ELSE g END - CASE WHEN k = n - 2 THEN h * h / g ELSE 0 END AS a,
         2 * (g + h) + CASE WHEN k = 1 THEN g * (g + h) / h ELSE 0 END
                     + CASE WHEN k = n - 2 THEN h * (g + h) / g ELSE 0 END AS b,
         CASE WHEN k = n - 2 THEN 0 ELSE h - CASE WHEN k = 1 THEN g * g / h ELSE 0 END END AS c
  FROM step WHERE n >= 4 AND k BETWEEN 1 AND n - 2
),
down AS (
  SELECT sample_idx, k, n, c / b AS u, r / b AS s FROM band WHERE k = 1
  UNION ALL
  SELECT t.sample_idx, t.k, t.n, t.c / (t.b - t.a * d.u), (t.r - t.a * d.s) / (t.b - t.a * d.u)
  FROM down d JOIN band t ON t.sample_idx = d.sample_idx AND t.k = d.k + 1
),
up AS (
  SELECT sample_idx, k, s AS bend FROM down WHERE k = n - 2
  UNION ALL
  SELECT d.sample_idx, d.k, d.s - d.u * p.bend
  FROM up p JOIN down d ON d.sample_idx = p.sample_idx AND d.k = p.k - 1
),
bends AS (
  SELECT sample_idx, k, bend FROM up
  UNION ALL
  SELECT t.sample_idx, 0, ((g + h) * p.bend - g * q.bend) / h
  FROM band t JOIN up p ON p.sample_idx = t.sample_idx AND p.k = 1
  JOIN up q ON q.sample_idx = t.sample_idx AND q.k = 2 WHERE t.k = 1
  UNION ALL
  SELECT t.sample_idx, n - 1, ((g + h) * p.bend - h * q.bend) / g
  FROM band t JOIN up p ON p.sample_idx = t.sample_idx AND p.k = n - 2
  JOIN up q ON q.sample_idx = t.sample_idx AND q.k = n - 3 WHERE t.k = n - 2
),
placed AS (
  SELECT c.*, least(greatest(count(price) OVER s - 1, 0), greatest(count(price) OVER w - 2, 0)) AS k
  FROM clean c WINDOW s AS (PARTITION BY sample_idx ORDER BY pos), w AS (PARTITION BY sample_idx)
),
curved AS (
  SELECT p.sample_idx, p.pos, p.valid,
         CASE WHEN p.price IS NOT NULL THEN p.price
              WHEN t.n = 1 THEN t.y
              WHEN t.n < 4 THEN t.y + (p.pos - t.x) * (t.y1 - t.y) / t.h
              ELSE (a.bend * (t.x1 - p.pos) ** 3 + b.bend * (p.pos - t.x) ** 3) / (6 * t.h)
                   + (t.y / t.h - a.bend * t.h / 6) * (t.x1 - p.pos)
                   + (t.y1 / t.h - b.bend * t.h / 6) * (p.pos - t.x) END AS price
  FROM placed p LEFT JOIN step t ON t.sample_idx = p.sample_idx AND t.k = p.k
  LEFT JOIN bends a ON a.sample_idx = p.sample_idx AND a.k = p.k
  LEFT JOIN bends b ON b.sample_idx = p.sample_idx AND b.k = p.k + 1
),"""


@query(
    "w07_interpolate_cubic",
    "sample_idx:i pos:i valid:b log_price:f",
    "SELECT sample_idx, pos, valid, sign(price) * ln(1 + abs(price)) AS log_price FROM curved",
    "RECURSIVE " + (B.CLEAN_SPARSE + _SPLINE).strip(),
)
def interpolate_cubic(spark, d):
    """Spline fill of sparse series. Extrapolated values span many magnitudes, so their logarithms, with the
    sign, are compared: to six digits, as far as two ways of elimination can agree."""
    filled = interpolate.interpolate_cubic(B.clean_sparse(spark, d), KEY, "pos", ["price"])
    return filled.withColumn("log_price", F.signum("price") * F.log1p(F.abs("price")))


@query(
    "w08_calendar_grid",
    "sample_idx:i pos:i week_key:s valid:b quantity:f price:f",
    """SELECT g.sample_idx, g.pos, g.y || '-W' || lpad(CAST(g.pos + 1 AS VARCHAR), 2, '0') AS week_key,
              w.sample_idx IS NOT NULL AS valid, quantity, price
       FROM (SELECT sample_idx, y, unnest(range(52)) AS pos FROM first_year) g
       LEFT JOIN (SELECT w.*, weekofyear(week_end) - 1 AS pos FROM weekly w
                  JOIN first_year f ON w.sample_idx = f.sample_idx AND year(w.week_end) = f.y
                  WHERE weekofyear(week_end) <= 52
                  QUALIFY row_number() OVER (PARTITION BY w.sample_idx, weekofyear(week_end)
                                             ORDER BY week_end DESC) = 1) w
       ON g.sample_idx = w.sample_idx AND g.pos = w.pos""",
    B.SERIES
    + B.clean_ctes(["quantity", "price"])
    + "first_year AS (SELECT sample_idx, year(min(ts)) AS y FROM ser GROUP BY 1),",
)
def calendar_grid(spark, d):
    return temporal.calendar_grid(B.series(spark, d), KEY, "ts", ["quantity", "price"])


@query(
    "w10_first_per_year",
    "sample_idx:i year:i ts:d o_orderkey:i price:f",
    """SELECT sample_idx, year(ts) AS year, ts, o_orderkey, price FROM ser
       QUALIFY row_number() OVER (PARTITION BY sample_idx, year(ts) ORDER BY ts, o_orderkey) = 1""",
    B.SPARSE,
)
def first_per_year(spark, d):
    rows = B.sparse(spark, d).withColumn("year", F.year("ts"))
    return temporal.first_per(rows, ["sample_idx", "year"], ["ts", "o_orderkey"], ["price"])


@query(
    "w11_token_boundaries",
    "sample_idx:i modality:s modality_idx:i start_pos:i end_pos:i",
    """SELECT sample_idx, modality, modality_idx, min(token_pos) AS start_pos,
              max(token_pos) + 1 AS end_pos FROM tok GROUP BY 1, 2, 3""",
    B.ORDER_TOKENS,
)
def token_boundaries(spark, d):
    orders = B.table(spark, d, "orders").select(
        F.col("o_custkey").alias("sample_idx"), F.col("o_orderpriority").alias("modality")
    )
    return tokens.token_boundaries(orders, "sample_idx", B.PRIORITIES)


@query(
    "t02_first_k_valid",
    "sample_idx:i ts:d l_orderkey:i l_linenumber:i l_partkey:i tax:f",
    """SELECT * FROM ser WHERE tax <> 0
       QUALIFY row_number() OVER (PARTITION BY sample_idx
                                  ORDER BY ts, l_orderkey, l_linenumber, l_partkey) <= 5""",
    B.SERIES,
)
def first_k_valid(spark, d):
    order = [F.col(c) for c in ("ts", "l_orderkey", "l_linenumber", "l_partkey")]
    return temporal.first_valid(B.series(spark, d), KEY, order, 5, F.col("tax") != 0)


@query(
    "p06_null_if_nodata",
    "sample_idx:i ts:d l_orderkey:i l_linenumber:i l_partkey:i discount:f tax:f",
    """SELECT sample_idx, ts, l_orderkey, l_linenumber, l_partkey,
              nullif(discount, 0) AS discount, nullif(tax, 0) AS tax FROM ser""",
    B.SERIES,
)
def null_if_nodata(spark, d):
    return filters.null_if_nodata(B.series(spark, d), ["discount", "tax"])


@query(
    "p07_trim_valid",
    "sample_idx:i pos:i week_key:s price:f",
    "SELECT * FROM clean WHERE valid",
    B.CLEAN_SPARSE,
)
def trim_valid(spark, d):
    return filters.trim_valid(B.clean_sparse(spark, d))


@query(
    "p08_pack_unpack",
    "sample_idx:i pos:i timestamp:s valid:b price:f error:s",
    """SELECT s.sample_idx, s.pos, coalesce(strftime(o.ts, '%Y-%m-%d'), 'NA') AS timestamp,
              o.ts IS NOT NULL AS valid, o.price, NULL AS error
       FROM (SELECT sample_idx, unnest(range(64)) AS pos FROM ser GROUP BY 1 HAVING count(*) <= 64) s
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY ts, o_orderkey) - 1
                         AS pos FROM ser) o ON s.sample_idx = o.sample_idx AND s.pos = o.pos
       UNION ALL
       SELECT sample_idx, NULL, NULL, NULL, NULL, count(*) || ' rows, at most 64 fit'
       FROM ser GROUP BY 1 HAVING count(*) > 64""",
    B.SPARSE,
)
def pack_unpack(spark, d):
    """Series packed to arrays of 64 steps and listed again, padding included; longer ones as failures."""
    fits, failed = ranking.split_long(B.sparse(spark, d), KEY, 64)
    packed = filters.pack(fits, KEY, "ts", ["o_orderkey"], ["price"], 64)
    return filters.unpack(packed, KEY, ["price"]).unionByName(failed, allowMissingColumns=True)


@query(
    "p16_fill_invalid",
    "sample_idx:i pos:i valid:b price:f",
    """SELECT sample_idx, pos, valid,
              CASE WHEN valid THEN price ELSE (SELECT avg(price) FROM ser) END AS price FROM clean""",
    B.CLEAN_SPARSE,
)
def fill_invalid(spark, d):
    """Invalid weeks take a placeholder, here the mean of all observations."""
    mean = B.sparse(spark, d).agg(F.avg("price")).scalar()
    return filters.fill_invalid(B.clean_sparse(spark, d), {"price": mean})
