"""Predicates, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, time as TM, values as V, vectors
from ..operators import filters
from . import bindings as B
from .registry import query

LINE = "l_orderkey:i l_linenumber:i l_partkey:i sample_idx:i"


@query(
    "p01_date_range",
    LINE + " ts:d price:f",
    "SELECT * FROM ser WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'",
    B.SERIES,
)
def date_range(spark, d):
    return filters.date_range(B.series(spark, d), "ts", "1997-01-01", "1998-01-01")


@query("p02_below", LINE + " quantity:f", "SELECT * FROM ser WHERE quantity < 25", B.SERIES)
def below(spark, d):
    return filters.below(B.series(spark, d), "quantity", 25)


@query(
    "p03_contains_all",
    "l_orderkey:i flags:s",
    """SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags
       FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1
       HAVING list_contains(list(l_returnflag), 'A') AND list_contains(list(l_returnflag), 'R')""",
)
def contains_all(spark, d):
    lines = B.table(spark, d, "lineitem").where(F.col("l_linestatus") == "F")
    flags = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    kept = filters.contains_all(flags, "f", ["A", "R"])
    return kept.withColumn("flags", F.concat_ws(",", "f"))


@query(
    "p04_select_variables",
    LINE + " tax:f price:f packed_tax:f packed_price:f",
    "SELECT *, tax AS packed_tax, price AS packed_price FROM ser",
    B.SERIES,
)
def select_variables(spark, d):
    """Two of four variables in a chosen order, from columns and from a packed array."""
    rows = B.series(spark, d).withColumn("packed", F.array(*B.VARS))
    picked = filters.select_packed(F.col("packed"), B.VARS, ["tax", "price"])
    rows = rows.withColumns({"packed_tax": picked[0], "packed_price": picked[1]})
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "sample_idx", "packed_tax", "packed_price"]
    return filters.select_variables(rows, ["tax", "price"], keep)


@query(
    "p05_metadata_defaults",
    "sample_id:s grid_id:i country:s continent:s classification:i temp_crop_area:f cell_area:f",
    """SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'p' || c_custkey
                   ELSE c_nationkey || '_' || c_custkey END AS sample_id,
              CASE WHEN c_mktsegment = 'BUILDING' THEN 0
                   WHEN c_mktsegment = 'MACHINERY' THEN c_custkey ELSE c_nationkey END AS grid_id,
              CASE WHEN c_mktsegment = 'MACHINERY' THEN n_name ELSE 'Unknown' END AS country,
              CASE WHEN c_mktsegment = 'MACHINERY' THEN r_name ELSE 'Europe' END AS continent,
              0 AS classification,
              CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS temp_crop_area, 0 AS cell_area
       FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey""",
)
def metadata_defaults(spark, d):
    """Point ids with and without a grid prefix, properties present for one segment only."""
    c = (
        B.table(spark, d, "customer")
        .join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    own = F.col("c_mktsegment") == "MACHINERY"
    props = F.struct(
        F.when(own, F.col("c_custkey").cast("int")).alias("grid_id"),
        F.when(own, F.col("n_name")).alias("country"),
        F.when(own, F.col("r_name")).alias("continent"),
        F.lit(None).cast("int").alias("classification"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("tempCropArea"),
        F.lit(None).cast("double").alias("cellArea"),
    )
    plain = F.concat(F.lit("p"), F.col("c_custkey"))
    prefixed = F.concat_ws("_", "c_nationkey", "c_custkey")
    named = F.when(F.col("c_mktsegment") == "BUILDING", plain).otherwise(prefixed)
    return filters.with_metadata_defaults(c.select(named.alias("id"), props.alias("properties")))


@query(
    "p09_clamp",
    LINE + " code:i kept:i",
    """SELECT *, CASE WHEN l_linenumber = 7 THEN 0 ELSE least(greatest(l_linenumber - 2, 0), 3) END AS code,
              CASE WHEN l_linenumber = 7 THEN -9 ELSE least(greatest(l_linenumber - 2, 0), 3) END AS kept
       FROM ser""",
    B.SERIES,
)
def clamp(spark, d):
    """Codes bounded to 0..3; one code counts as missing."""
    raw = F.nullif(F.col("l_linenumber") - 2, F.lit(5))
    kept = F.coalesce(V.clamp(raw, 0, 3, keep_null=True), F.lit(-9))
    return B.series(spark, d).withColumns({"code": V.clamp(raw, 0, 3), "kept": kept})


@query(
    "p10_priority_class",
    "l_orderkey:i crop_class:i",
    """SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'A') > 0 THEN 1
                               WHEN count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax > 0.04) > 0 THEN 2
                               WHEN count(*) FILTER (WHERE l_quantity > 45) > 0 THEN 3
                               ELSE 0 END AS crop_class
       FROM lineitem GROUP BY 1""",
)
def priority_class(spark, d):
    signals = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "A", 100)).alias("maize"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.04)).alias("winter"),
        F.sum(F.when(F.col("l_quantity") > 45, 100).otherwise(0)).alias("spring"),
    )
    cls = V.priority_class(F.col("maize"), F.col("winter"), F.col("spring"))
    return signals.withColumn("crop_class", cls)


@query(
    "p11_slug",
    "c_custkey:i slug:s",
    """SELECT c_custkey, replace(replace(replace(replace(replace(lower(c_name || ' & ' || n_name
              || ', d''St.'), ' ', '_'), '&', 'and'), ',', ''), '''', ''), '.', '') AS slug
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def slug(spark, d):
    c = B.table(spark, d, "customer").join(
        B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    name = F.concat(F.col("c_name"), F.lit(" & "), F.col("n_name"), F.lit(", d'St."))
    return c.withColumn("slug", V.slug(name))


@query(
    "p12_drop_sentinel",
    "o_orderkey:i code:i first:i second:i",
    """SELECT * FROM (
         SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE day(o_orderdate) END AS code,
                CASE WHEN o_totalprice < 100000 THEN -1 ELSE month(o_orderdate) END AS first,
                CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE year(o_orderdate) END AS second
         FROM orders)
       WHERE code <> -1 AND (first <> -1 OR second <> -1)""",
)
def drop_sentinel(spark, d):
    date = F.col("o_orderdate")
    o = B.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", -1).otherwise(F.day(date)).alias("code"),
        F.when(F.col("o_totalprice") < 100000, -1).otherwise(F.month(date)).alias("first"),
        F.when(F.col("o_orderpriority") == "5-LOW", -1).otherwise(F.year(date)).alias("second"),
    )
    packed = o.withColumn("codes", F.array("first", "second"))
    return filters.drop_sentinel(packed, ["code", "codes"])


@query(
    "p13_finite_or_zero",
    LINE + " ratio:f root:f",
    """SELECT *, CASE WHEN tax = 0 THEN 0 ELSE discount / tax END AS ratio,
              CASE WHEN quantity < 25 THEN 0 ELSE sqrt(quantity - 25) END AS root FROM ser""",
    B.SERIES,
)
def finite_or_zero(spark, d):
    """Infinite ratios, NaN roots and missing values become 0."""
    infinite = F.lit(float("inf")) * F.signum(F.col("discount") + F.lit(1.0))
    raw = F.when(F.col("tax") == 0, infinite).otherwise(F.try_divide("discount", "tax"))
    root = F.sqrt(F.col("quantity") - 25.0)
    return B.series(spark, d).withColumns(
        {"ratio": V.finite_or_zero(raw), "root": V.finite_or_zero(root)}
    )


@query(
    "p14_drop_targets",
    "sample_idx:i label:i columns:s",
    "SELECT *, 'batch_id,label,sample_idx,z' AS columns FROM emb",
    B.EMBEDDINGS,
)
def drop_targets(spark, d):
    """Model inputs without the reference vector; the remaining columns are listed."""
    kept = filters.drop_targets(B.embeddings(spark, d), ["s"])
    return kept.withColumn("columns", F.lit(",".join(sorted(kept.columns))))


DEPTHS = ["0-5cm", "5-15cm", "15-30cm"]


@query(
    "p17_pack_depths",
    "p_partkey:i variable:s depth:s value:f",
    """SELECT p_partkey, 'clay' AS variable, unnest(['0-5cm', '5-15cm', '15-30cm']) AS depth,
              unnest([p_size::DOUBLE, p_retailprice, NULL]) AS value FROM part
       UNION ALL
       SELECT p_partkey, 'soc', unnest(['0-5cm', '5-15cm', '15-30cm']),
              unnest([p_retailprice * 2, p_size / 2::DOUBLE, p_partkey::DOUBLE]) FROM part""",
)
def pack_depths(spark, d):
    """Depth rows to fixed-order arrays and back; one depth of one variable is absent."""
    part = B.table(spark, d, "part")
    cell = lambda v, i, x: F.struct(
        F.lit(v).alias("variable"), F.lit(DEPTHS[i]).alias("depth"), x.cast("double").alias("value")
    )
    rows = part.select(
        "p_partkey",
        F.explode(
            F.array(
                cell("soc", 2, F.col("p_partkey")),
                cell("clay", 0, F.col("p_size")),
                cell("soc", 0, F.col("p_retailprice") * 2),
                cell("clay", 1, F.col("p_retailprice")),
                cell("soc", 1, F.col("p_size") / 2),
            )
        ).alias("r"),
    ).select("p_partkey", "r.*")
    keys = ["p_partkey", "variable"]
    return filters.unpack_depths(filters.pack_depths(rows, keys, DEPTHS), keys, DEPTHS)


@query(
    "f01_cyclic_coords",
    "sample_idx:i lon_sin:f lon_cos:f lat_sin:f lat_cos:f",
    """SELECT sample_idx, sin(2 * pi() * lon / 360) AS lon_sin, cos(2 * pi() * lon / 360) AS lon_cos,
              sin(2 * pi() * lat / 360) AS lat_sin, cos(2 * pi() * lat / 360) AS lat_cos FROM pts""",
    B.POINTS,
)
def cyclic_coords(spark, d):
    return B.points(spark, d).withColumns(geo.cyclic_coords(F.col("lon"), F.col("lat")))


@query(
    "f02_cyclic_week",
    "o_orderkey:i week_sin:f week_cos:f",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 0
                               ELSE sin(2 * pi() * weekofyear(o_orderdate) / 52) END AS week_sin,
              CASE WHEN o_orderpriority = '5-LOW' THEN 0
                   ELSE cos(2 * pi() * weekofyear(o_orderdate) / 52) END AS week_cos FROM orders""",
)
def cyclic_week(spark, d):
    """Keys as ``YYYY-Www``, as dates and unreadable, by order priority."""
    date = F.col("o_orderdate")
    key = (
        F.when(F.col("o_orderpriority") == "5-LOW", "NA")
        .when(F.col("o_orderpriority") == "1-URGENT", F.date_format(date, "yyyy-MM-dd"))
        .otherwise(F.format_string("%d-W%02d", F.year(date), F.weekofyear(date)))
    )
    sin, cos = TM.cyclic_week(key)
    return B.table(spark, d, "orders").withColumns({"week_sin": sin, "week_cos": cos})


@query(
    "f03_week_key",
    "o_orderkey:i week_end:d week_key:s",
    """SELECT o_orderkey, week_end, year(week_end) || '-W' ||
              lpad(CAST(weekofyear(week_end) AS VARCHAR), 2, '0') AS week_key
       FROM (SELECT o_orderkey,
                    CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS week_end
             FROM orders)""",
)
def week_key(spark, d):
    end = TM.week_end(F.col("o_orderdate"))
    return B.table(spark, d, "orders").withColumns({"week_end": end, "week_key": TM.week_key(end)})


_CALENDAR = """
cal AS (
  SELECT o_custkey, o_orderpriority AS p, min(dayofyear(o_orderdate)) AS sos,
         CASE WHEN count(*) > 1 THEN dayofyear(max(o_orderdate)) END AS eos
  FROM orders GROUP BY 1, 2
),
wide AS (
  SELECT o_custkey, o_custkey % 4 AS cls,
         max(sos) FILTER (WHERE p = '1-URGENT') AS s1, max(eos) FILTER (WHERE p = '1-URGENT') AS e1,
         max(sos) FILTER (WHERE p = '2-HIGH') AS s2, max(eos) FILTER (WHERE p = '2-HIGH') AS e2,
         max(sos) FILTER (WHERE p = '3-MEDIUM') AS s3, max(eos) FILTER (WHERE p = '3-MEDIUM') AS e3
  FROM cal GROUP BY 1
),
target AS (
  SELECT *, CASE cls WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 END AS s,
            CASE cls WHEN 1 THEN e1 WHEN 2 THEN e2 WHEN 3 THEN e3 END AS e,
            coalesce(s1 + e1 + s2 + e2 + s3 + e3, -1) > 0 AS complete
  FROM wide
),"""


def crop_calendar(spark, d):
    """Six day-of-year values per customer, from the dates of its orders by priority."""
    o = B.table(spark, d, "orders")
    cal = o.groupBy("o_custkey", "o_orderpriority").agg(
        F.min(F.dayofyear("o_orderdate")).alias("sos"),
        F.when(F.count(F.lit(1)) > 1, F.dayofyear(F.max("o_orderdate"))).alias("eos"),
    )
    slots = [
        F.max(F.when(F.col("o_orderpriority") == p, F.col(v))).cast("double")
        for p in B.PRIORITIES[:3]
        for v in ("sos", "eos")
    ]
    return cal.groupBy("o_custkey").agg(F.array(*slots).alias("calendar")).withColumn(
        "cls", F.col("o_custkey") % 4
    )


@query(
    "f04_season_length",
    "o_custkey:i sos:i length:i plain_sos:i plain_length:i",
    """SELECT o_custkey, coalesce(CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN s END, -1) AS sos,
              coalesce(CASE WHEN e >= s THEN e - s ELSE 365 - s + e END, -1) AS length,
              CASE WHEN complete THEN s1 ELSE -1 END AS plain_sos,
              CASE WHEN NOT complete THEN -1 WHEN e1 >= s1 THEN e1 - s1 ELSE 365 - s1 + e1 END
                AS plain_length
       FROM target""",
    _CALENDAR,
)
def season_length(spark, d):
    """Season start and length by class, and without one; -1 where there is none."""
    sos, length = V.season_target(F.col("cls"), F.col("calendar"))
    plain_sos, plain_length = V.season_target(None, F.col("calendar"))
    named = {"sos": sos, "length": length, "plain_sos": plain_sos, "plain_length": plain_length}
    rows = crop_calendar(spark, d)
    return rows.withColumns({n: F.coalesce(c, F.lit(-1.0)) for n, c in named.items()})


@query(
    "f05_mercator",
    "sample_idx:i x_km:f y_km:f lon2:f lat2:f",
    """SELECT sample_idx, x / 1000 AS x_km, y / 1000 AS y_km, degrees(x / 6378137) AS lon2,
              degrees(2 * atan(exp(y / 6378137)) - pi() / 2) AS lat2
       FROM (SELECT sample_idx, radians(lon) * 6378137 AS x,
                    ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 AS y FROM pts)""",
    B.POINTS,
)
def mercator(spark, d):
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    there = B.points(spark, d).withColumns({"x": x, "y": y})
    lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
    km = {"x_km": F.col("x") / 1000, "y_km": F.col("y") / 1000}
    return there.withColumns({"lon2": lon, "lat2": lat, **km})


@query(
    "f06_lenient_time",
    "o_orderkey:i parsed:s",
    """SELECT o_orderkey, coalesce(strftime(CASE
                WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN NULL
                ELSE o_orderdate END, '%Y-%m-%d'), 'none') AS parsed FROM orders""",
)
def lenient_time(spark, d):
    """Time strings in two readable and two unreadable spellings."""
    p, date = F.col("o_orderpriority"), F.col("o_orderdate")
    text = (
        F.when(p == "5-LOW", F.lit("NA"))
        .when(p == "4-NOT SPECIFIED", F.date_format(date, "yyyy-99-dd"))
        .when(p == "1-URGENT", F.date_format(date, "yyyy-MM-dd"))
        .otherwise(F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
    )
    parsed = F.date_format(TM.lenient_ts(text), "yyyy-MM-dd")
    return B.table(spark, d, "orders").withColumn("parsed", F.coalesce(parsed, F.lit("none")))


@query(
    "f07_variable_names",
    "p_partkey:i variable:s depth_index:i band:s",
    """SELECT p_partkey, lower(p_type) AS variable,
              CASE WHEN p_size < 20 THEN 0 WHEN p_size < 35 THEN 1 WHEN p_size < 45 THEN 2 ELSE -1 END
                AS depth_index,
              lower(p_type) || '_' || CASE WHEN p_size < 20 THEN '0-5cm' WHEN p_size < 35 THEN '5-15cm'
                WHEN p_size < 45 THEN '15-30cm' ELSE '30-60cm' END || '_mean' AS band FROM part""",
)
def variable_names(spark, d):
    size = F.col("p_size")
    depth = (
        F.when(size < 20, "0-5cm").when(size < 35, "5-15cm").when(size < 45, "15-30cm").otherwise("30-60cm")
    )
    part = B.table(spark, d, "part").withColumn("depth", depth)
    variable, index = V.split_variable(F.concat_ws("_", F.lower("p_type"), "depth"))
    return part.withColumns(
        {"variable": variable, "depth_index": index, "band": V.band_name(F.lower("p_type"), F.col("depth"))}
    )


@query(
    "f08_week_index",
    "sample_idx:i modality:s o_orderkey:i week_idx:i",
    "SELECT * FROM tok",
    B.ORDER_TOKENS,
)
def week_index(spark, d):
    return B.order_tokens(spark, d)


@query(
    "f09_vectors",
    "sample_idx:i unit_norm:f cosine:f distance:f lse:f",
    """SELECT sample_idx, 1 AS unit_norm,
              list_dot_product(z, s) / sqrt(list_dot_product(z, z) * list_dot_product(s, s)) AS cosine,
              list_distance(z, s) AS distance,
              ln(list_sum(list_transform(z, lambda x: exp(x)))) AS lse FROM emb""",
    B.EMBEDDINGS,
)
def vector_functions(spark, d):
    z, s = F.col("z"), F.col("s")
    return B.embeddings(spark, d).withColumns(
        {
            "unit_norm": vectors.l2_norm(vectors.l2_normalize(z)),
            "cosine": vectors.cosine(z, s),
            "distance": vectors.euclidean(z, s),
            "lse": vectors.logsumexp(z),
        }
    )


@query(
    "f10_zscore",
    LINE + " z:f flat:f",
    """SELECT *, (price - (SELECT avg(price) FROM ser)) / (SELECT stddev_pop(price) FROM ser) AS z,
              CAST(NULL AS DOUBLE) AS flat FROM ser""",
    B.SERIES,
)
def zscore(spark, d):
    """z-scores; a variable without spread has none."""
    rows = B.series(spark, d)
    stats = rows.agg(F.struct(F.avg("price").alias("m"), F.stddev_pop("price").alias("s"))).scalar()
    return rows.withColumns(
        {
            "z": V.zscore(F.col("price"), stats["m"], stats["s"]),
            "flat": V.zscore(F.col("price"), stats["m"], stats["s"] * 0),
        }
    )


@query(
    "f11_position_encoding",
    "sample_idx:i token_pos:i dim:i position_code:f week_code:f",
    """SELECT sample_idx, token_pos, dim,
              CASE WHEN dim % 2 = 0 THEN sin(token_pos / pow(10000, 2 * (dim // 2) / 8::DOUBLE))
                   ELSE cos(token_pos / pow(10000, 2 * (dim // 2) / 8::DOUBLE)) END AS position_code,
              CASE WHEN dim % 2 = 0 THEN sin(2 * pi() * week_idx / 52)
                   ELSE cos(2 * pi() * week_idx / 52) END AS week_code
       FROM tok, (SELECT unnest(range(8)) AS dim)""",
    B.ORDER_TOKENS,
)
def position_encoding(spark, d):
    """Position and week codes of every token."""
    tokens = B.order_tokens(spark, d).withColumn(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(7)))
    )
    return tokens.withColumns(
        {
            "position_code": TM.position_encoding(F.col("token_pos"), F.col("dim"), 8),
            "week_code": TM.week_encoding(F.col("week_idx"), F.col("dim")),
        }
    )


@query(
    "f11_position_table",
    "pos:i dim:i position_code:f week_code:f",
    """SELECT pos, dim, CASE WHEN dim % 2 = 0 THEN sin(pos / pow(10000, 2 * (dim // 2) / 16::DOUBLE))
                   ELSE cos(pos / pow(10000, 2 * (dim // 2) / 16::DOUBLE)) END AS position_code,
              CASE WHEN dim % 2 = 0 THEN sin(2 * pi() * (pos % 52) / 52)
                   ELSE cos(2 * pi() * (pos % 52) / 52) END AS week_code
       FROM (SELECT DISTINCT token_pos AS pos FROM tok), (SELECT unnest(range(16)) AS dim)""",
    B.ORDER_TOKENS,
)
def position_table(spark, d):
    """The lookup table for all positions that occur."""
    positions = B.order_tokens(spark, d).select(F.col("token_pos").alias("pos")).distinct()
    return TM.position_table(positions, 16)


@query(
    "f12_strip_prefixes",
    "c_custkey:i key:s",
    "SELECT c_custkey, 'encoder.' || lower(c_mktsegment) || '.model.w' AS key FROM customer",
)
def strip_prefixes(spark, d):
    """Wrapper prefixes in several orders, repeated; inner ones stay."""
    heads = F.array(*[F.lit(h) for h in ("", "model.", "module._orig_mod.", "model._orig_mod.model.")])
    head = F.element_at(heads, (F.col("c_custkey") % 4 + 1).cast("int"))
    key = F.concat(head, F.lit("encoder."), F.lower("c_mktsegment"), F.lit(".model.w"))
    return B.table(spark, d, "customer").withColumn("key", V.strip_prefixes(key))


@query(
    "f13_loss_terms",
    "sample_idx:i hinge:f nll:f",
    """SELECT sample_idx, greatest(0, 1 - list_distance(z, s)) AS hinge,
              -ln(abs(z[1]) + 1e-8) AS nll FROM emb""",
    B.EMBEDDINGS,
)
def loss_terms(spark, d):
    z = F.col("z")
    return B.embeddings(spark, d).withColumns(
        {"hinge": vectors.hinge(vectors.euclidean(z, F.col("s"))), "nll": vectors.nll(F.abs(z[0]))}
    )


@query(
    "f14_year_long",
    "o_orderkey:i year:i variable:s value:f",
    """SELECT o_orderkey, year(o_orderdate) AS year, 'landcover_' || v AS variable, value
       FROM (SELECT o_orderkey, o_orderdate, 'price' AS v, o_totalprice AS value FROM orders
             UNION ALL
             SELECT o_orderkey, o_orderdate, 'class',
                    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE day(o_orderdate) END FROM orders)
       WHERE value IS NOT NULL AND year(o_orderdate) IN (1996, 1997)""",
)
def year_long(spark, d):
    """Long form of two supported years; other years and missing values are skipped."""
    date = F.col("o_orderdate")
    cls = F.when(F.col("o_orderstatus") != "O", F.day(date)).cast("double")
    o = B.table(spark, d, "orders").select(
        "o_orderkey", F.year(date).alias("year"), F.col("o_totalprice").alias("Price"), cls.alias("Class")
    )
    return filters.year_long(o, ["o_orderkey"], "year", ["Price", "Class"], [1996, 1997], "landcover")


@query(
    "f15_cell_area",
    "sample_idx:i area:f",
    """SELECT sample_idx, pow(6371.0088, 2) * radians(0.5) *
              (sin(radians(lat + 0.25)) - sin(radians(lat))) AS area FROM pts""",
    B.POINTS,
)
def cell_area(spark, d):
    """Area in km² of a half by a quarter degree cell at each point."""
    lon, lat = F.col("lon"), F.col("lat")
    area = geo.cell_area(lon, lat, lon + 0.5, lat + 0.25) / 1e6
    return B.points(spark, d).withColumn("area", area)
