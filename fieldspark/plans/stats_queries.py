"""Statistics, quality reports, counts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, stats, temporal
from . import bindings as B
from .registry import query

STATS = "mean:f std:f min:f max:f count:i"
_AGG = (
    "coalesce(avg(value), 0) AS mean, coalesce(stddev_pop(value), 1) AS std, "
    "coalesce(min(value), 0) AS min, coalesce(max(value), 0) AS max, count(value) AS count"
)


def _unpivot(source: str, names: list[str], where: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS variable, CASE WHEN {where} THEN {n} END AS value FROM {source}"
        for n in names
    )


@query(
    "a03_masked_stats",
    "variable:s " + STATS,
    f"SELECT variable, {_AGG} FROM ({_unpivot('clean', B.VARS, 'valid')}) GROUP BY 1",
    B.CLEAN_SERIES,
)
def masked_stats(spark, d):
    """Statistics of the valid weeks of the cleaned series."""
    rows = stats.long_form(B.clean_series(spark, d), "t", "ser", B.VARS, F.col("valid"))
    return stats.masked_stats(rows, "value", ["variable"])


@query(
    "a03_masked_stats_by_sample",
    "sample_idx:i " + STATS,
    f"""SELECT sample_idx, {_AGG}
        FROM (SELECT sample_idx, CASE WHEN valid AND price > 400000 THEN price END AS value FROM clean)
        GROUP BY 1""",
    B.CLEAN_SPARSE,
)
def masked_stats_by_sample(spark, d):
    """Per-customer statistics; customers without a valid value get the defaults."""
    valid = F.col("valid") & (F.col("price") > 400000)
    return stats.masked_stats(B.clean_sparse(spark, d), "price", ["sample_idx"], valid)


DEPTHS = ["0-5cm", "5-15cm", "15-30cm"]


@query(
    "a04_depth_stats",
    "variable:s " + STATS,
    f"""SELECT variable, {_AGG} FROM (
          SELECT 'clay_' || unnest(['0-5cm', '5-15cm', '15-30cm']) AS variable,
                 unnest([p_size::DOUBLE, p_retailprice, NULL]) AS value FROM part
          UNION ALL
          SELECT 'soc_' || unnest(['0-5cm', '5-15cm', '15-30cm']),
                 unnest([p_retailprice * 2, p_size / 2::DOUBLE, p_partkey::DOUBLE]) FROM part)
        GROUP BY 1""",
)
def depth_stats(spark, d):
    part = B.table(spark, d, "part").select(
        F.array(F.col("p_size").cast("double"), "p_retailprice", F.lit(None)).alias("clay"),
        F.array(
            F.col("p_retailprice") * 2, F.col("p_size") / 2, F.col("p_partkey").cast("double")
        ).alias("soc"),
    )
    return stats.depth_stats(part, ["clay", "soc"], DEPTHS)


_COORDS = """
coded AS (
  SELECT sin(2 * pi() * lon / 360) AS lon_sin, cos(2 * pi() * lon / 360) AS lon_cos,
         sin(2 * pi() * lat / 360) AS lat_sin, cos(2 * pi() * lat / 360) AS lat_cos FROM pts
),"""
_COORD_NAMES = ["lon_sin", "lon_cos", "lat_sin", "lat_cos"]
_ENCODED = (
    f"SELECT 'metadata' AS section, 'encoded_coordinates' AS modality, * "
    f"FROM ({_unpivot('coded', _COORD_NAMES)}) UNION ALL "
    f"SELECT 'temporal_modalities', 'ser', * "
    f"FROM ({_unpivot('clean', ['week_sin', 'week_cos'], 'valid')})"
)


@query(
    "a05_encoding_stats",
    "section:s modality:s variable:s " + STATS,
    f"SELECT section, modality, variable, {_AGG} FROM ({_ENCODED}) GROUP BY 1, 2, 3",
    B.CLEAN_SPARSE + B.POINTS + _COORDS,
)
def encoding_stats(spark, d):
    sections = stats.encoding_sections(B.points(spark, d), B.clean_sparse(spark, d), "ser")
    return stats.dataset_stats(sections)


@query(
    "a06_dataset_stats",
    "section:s modality:s variable:s " + STATS,
    f"""SELECT section, modality, variable, {_AGG} FROM ({_ENCODED}
        UNION ALL SELECT 'temporal_modalities', 'ser', * FROM ({_unpivot('clean', B.VARS, 'valid')})
        UNION ALL SELECT 'static_modalities', 'elevation', 'elevation', c_acctbal FROM customer)
        GROUP BY 1, 2, 3""",
    B.CLEAN_SERIES + B.POINTS + _COORDS,
)
def dataset_stats(spark, d):
    """All sections of a dataset in one aggregation."""
    return all_stats(spark, d)


def all_stats(spark, d):
    clean = B.clean_series(spark, d)
    static = B.table(spark, d, "customer").select(F.col("c_acctbal").alias("elevation"))
    return stats.dataset_stats(
        [
            *stats.encoding_sections(B.points(spark, d), clean, "ser", B.VARS),
            stats.long_form(static, "static_modalities", "elevation", ["elevation"]),
        ]
    )


def _histogram_sql(table: str, column: str, bins: int) -> str:
    return f"""
      SELECT b.bin, lo + b.bin * (hi - lo) / {bins} AS bin_start, coalesce(c.n, 0) AS n, total, mean
      FROM (SELECT unnest(range({bins})) AS bin) b
      CROSS JOIN (SELECT min({column}) AS lo, max({column}) AS hi, count({column}) AS total,
                         avg({column}) AS mean FROM {table}) s
      LEFT JOIN (SELECT least(floor(({column} - lo) / (hi - lo) * {bins}), {bins} - 1) AS bin,
                        count(*) AS n
                 FROM {table}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {table})
                 GROUP BY 1) c ON b.bin = c.bin"""


HIST = "bin:i bin_start:f n:i total:i mean:f"


@query("a07_histogram", HIST, _histogram_sql("orders", "o_totalprice", 50))
def histogram(spark, d):
    return stats.histogram(B.table(spark, d, "orders"), "o_totalprice", 50)


@query(
    "a07_histogram_calendar",
    HIST,
    _histogram_sql("(SELECT dayofyear(o_orderdate)::DOUBLE AS doy FROM orders)", "doy", 30),
)
def histogram_calendar(spark, d):
    days = B.table(spark, d, "orders").select(F.dayofyear("o_orderdate").alias("doy"))
    return stats.histogram(days, "doy", 30)


@query(
    "a07_histograms",
    "variable:s bin:i bin_start:f n:i total:i mean:g",
    " UNION ALL ".join(f"SELECT '{v}' AS variable, * FROM ({_histogram_sql('ser', v, 40)})" for v in B.VARS),
    B.SERIES,
)
def histograms(spark, d):
    """All variables of the series in one query."""
    return stats.histograms(B.series(spark, d), B.VARS, 40)


_DIM = """
dim AS (
  SELECT n_name AS country, coalesce(r_name, 'Unknown') AS continent, n_nationkey
  FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) ON n_regionkey = r_regionkey
),
pop AS (SELECT country, continent FROM customer JOIN dim ON c_nationkey = n_nationkey),"""


def dictionary(spark, d):
    """Country -> continent for all regions but one."""
    nation, region = B.table(spark, d, "nation"), B.table(spark, d, "region")
    listed = region.where(F.col("r_regionkey") < 4)
    return nation.join(listed, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("country"), F.col("r_name").alias("continent")
    )


def population(spark, d):
    """Customers with country and continent."""
    people = (
        B.table(spark, d, "customer")
        .join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumnRenamed("n_name", "country")
    )
    return joins.lookup_continent(people, dictionary(spark, d))


@query(
    "a08_members_by_continent",
    "continent:s position:i country:s members:i",
    """SELECT continent, row_number() OVER (PARTITION BY continent ORDER BY country) AS position,
              country, count(*) OVER (PARTITION BY continent) AS members
       FROM (SELECT DISTINCT country, continent FROM pop)""",
    _DIM,
)
def members_by_continent(spark, d):
    return stats.members_by(population(spark, d), "continent", "country")


@query(
    "a08_group_summary",
    "continent:s n:i",
    """SELECT continent, count(*) AS n FROM pop GROUP BY 1
       UNION ALL SELECT 'Total', count(*) FROM pop""",
    _DIM,
)
def group_summary(spark, d):
    return stats.group_summary(population(spark, d), "continent")


_ZERO = f"""
bands AS ({_unpivot('ser', B.VARS)}),
zeros AS (
  SELECT variable AS band, count(value) AS total_valid, count(*) FILTER (WHERE value = 0) AS zero_count,
         count(*) FILTER (WHERE value = 0) * 100.0::DOUBLE / count(value) AS zero_pct,
         count(*) FILTER (WHERE value < 10) AS small_count,
         count(*) FILTER (WHERE value < 10) * 100.0::DOUBLE / count(value) AS small_pct,
         min(value) AS min, avg(value) AS mean
  FROM bands GROUP BY 1
),"""


@query(
    "a09_zero_stats",
    "band:s total_valid:i zero_count:i zero_pct:f small_count:i small_pct:f min:f mean:f warn:b",
    "SELECT *, zero_pct > 1 AS warn FROM zeros",
    B.SERIES + _ZERO,
)
def zero_stats(spark, d):
    return stats.zero_stats(B.series(spark, d), B.VARS)


@query(
    "s14_quality_report",
    "band:s total_valid:i zero_count:i zero_pct:f bands_above_1_pct:i bands_above_5_pct:i",
    """SELECT *, (SELECT count(*) FROM zeros WHERE zero_pct > 1) AS bands_above_1_pct,
              (SELECT count(*) FROM zeros WHERE zero_pct > 5) AS bands_above_5_pct FROM zeros""",
    B.SERIES + _ZERO,
)
def quality_report(spark, d):
    return stats.quality_report(stats.zero_stats(B.series(spark, d), B.VARS))


@query(
    "a10_zero_cooccurrence",
    "band:s zeros:i zeros_flagged:i flagged_pct:f",
    """SELECT variable AS band, count(*) FILTER (WHERE value = 0) AS zeros,
              count(*) FILTER (WHERE value = 0 AND tax = 0) AS zeros_flagged,
              coalesce(count(*) FILTER (WHERE value = 0 AND tax = 0) * 100.0::DOUBLE
                       / nullif(count(*) FILTER (WHERE value = 0), 0), 0) AS flagged_pct
       FROM (SELECT 'discount' AS variable, discount AS value, tax FROM ser
             UNION ALL SELECT 'quantity', quantity, tax FROM ser) GROUP BY 1""",
    B.SERIES,
)
def zero_cooccurrence(spark, d):
    return stats.zero_cooccurrence(B.series(spark, d), ["discount", "quantity"], "tax")


_NULLS = " + ".join(f"(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END)" for v in B.VARS)


@query(
    "a11_null_audit",
    "scope:s key:s nulls:i cells:i",
    f"""SELECT 'total' AS scope, 'all' AS key, sum(k) AS nulls, count(*) * 4 AS cells FROM v
        UNION ALL {" UNION ALL ".join(
            f"SELECT 'variable', '{n}', count(*) - count({n}), count(*) FROM v" for n in B.VARS)}
        UNION ALL SELECT 'week', CAST(pos AS VARCHAR), sum(k), count(*) * 4 FROM v
                  GROUP BY pos HAVING sum(k) > 0
        UNION ALL SELECT 'samples', 'with_nulls', count(*) FILTER (WHERE k > 0), count(*)
                  FROM (SELECT sample_idx, sum(k) AS k FROM v GROUP BY 1)
        UNION ALL SELECT * FROM (SELECT 'sample', CAST(sample_idx AS VARCHAR), sum(k), count(*) * 4
                  FROM v GROUP BY sample_idx HAVING sum(k) > 0 ORDER BY sample_idx LIMIT 10)""",
    B.CLEAN_SERIES + f"v AS (SELECT *, {_NULLS} AS k FROM clean WHERE valid),",
)
def null_audit(spark, d):
    return stats.null_audit(B.clean_series(spark, d), "sample_idx", B.VARS)


@query(
    "a21_class_distribution",
    "continent:s country:s c_mktsegment:s n:i",
    """SELECT continent, country, c_mktsegment, count(*) AS n
       FROM customer JOIN dim ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    _DIM,
)
def class_distribution(spark, d):
    return stats.class_distribution(population(spark, d), ["continent", "country", "c_mktsegment"])


@query(
    "j01_lookup_continent",
    "c_custkey:i country:s continent:s",
    "SELECT c_custkey, country, continent FROM customer JOIN dim ON c_nationkey = n_nationkey",
    _DIM,
)
def lookup_continent(spark, d):
    return population(spark, d)


@query(
    "j11_dense_counts",
    "class:i n:i",
    """SELECT class, coalesce(n, 0) AS n
       FROM (SELECT unnest(range((SELECT max(l_linenumber * 3) + 1 FROM lineitem))) AS class) r
       LEFT JOIN (SELECT l_linenumber * 3 AS c, count(*) AS n FROM lineitem GROUP BY 1) ON class = c""",
)
def dense_counts(spark, d):
    """Counts of all codes; two of three codes do not occur."""
    codes = B.table(spark, d, "lineitem").select((F.col("l_linenumber") * 3).alias("code"))
    return stats.dense_counts(codes, "code")


@query(
    "t01_top_zones",
    "l_partkey:i n:i",
    """SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey <> 0
       GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20""",
)
def top_zones(spark, d):
    return stats.top_k(B.table(spark, d, "lineitem"), "l_partkey", 20, sentinel=0)


@query(
    "t05_head",
    "c_custkey:i c_name:s",
    "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 2",
)
def head(spark, d):
    """The two-point development subset."""
    return stats.head_n(B.table(spark, d, "customer"), 2, ["c_custkey"])


_RICH = "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0"
_BUYERS = "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000"


def _keys(spark, d):
    rich = B.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    buyers = (
        B.table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    )
    return rich, buyers


@query("u02_common_keys", "k:i", f"({_RICH}) INTERSECT ({_BUYERS})")
def common_keys(spark, d):
    return joins.common_keys(*_keys(spark, d))


@query(
    "u03_only_in",
    "k:i side:s",
    f"""SELECT k, 'a' AS side FROM (({_RICH}) EXCEPT ({_BUYERS}))
        UNION ALL SELECT k, 'b' FROM (({_BUYERS}) EXCEPT ({_RICH}))""",
)
def only_in(spark, d):
    return joins.only_in(*_keys(spark, d))


@query("u04_distinct_names", "p_type:s", "SELECT DISTINCT p_type FROM part")
def distinct_names(spark, d):
    return stats.distinct_names(B.table(spark, d, "part"), "p_type")


@query(
    "a01_weekly_stats_observations",
    "variable:s " + STATS,
    f"""SELECT variable, {_AGG} FROM (
          SELECT sample_idx, variable, date_trunc('week', ts) AS w, max(value) AS value
          FROM obs GROUP BY 1, 2, 3) GROUP BY 1""",
    B.EVENTS,
)
def weekly_stats_observations(spark, d):
    weekly = temporal.weekly_resample(
        B.events(spark, d), ["sample_idx", "variable"], "ts", ["value"], "max"
    )
    return stats.masked_stats(weekly, "value", ["variable"])
