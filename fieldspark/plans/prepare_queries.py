"""Samples, splits, shuffles, tokens and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, values as V
from ..operators import masking, records, sampling, stats, tokens
from . import bindings as B
from .registry import query


def index(spark, d):
    """Orders as a dense sample index."""
    return B.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sample_idx"), "o_orderpriority", "o_totalprice"
    )


@query(
    "w01_stratified_sample",
    "sample_idx:i stratum:i",
    f"""SELECT sample_idx, stratum FROM pts QUALIFY row_number() OVER (
          PARTITION BY stratum ORDER BY {B.digest(42, "sample_idx")}, sample_idx) <= 10""",
    B.POINTS,
)
def stratified_sample(spark, d):
    """Up to ten points per nation."""
    return sampling.stratified_sample(B.points(spark, d), "stratum", ["sample_idx"], 10)


@query(
    "w01_stratified_orders",
    "sample_idx:i o_orderpriority:s",
    f"""SELECT o_orderkey AS sample_idx, o_orderpriority FROM orders QUALIFY row_number() OVER (
          PARTITION BY o_orderpriority ORDER BY {B.digest(7, "o_orderkey")}, o_orderkey) <= 100""",
)
def stratified_orders(spark, d):
    return sampling.stratified_sample(
        index(spark, d), "o_orderpriority", ["sample_idx"], 100, seed=7
    )


@query(
    "w01_stratified_lines",
    "o_orderkey:i l_linenumber:i l_returnflag:s",
    f"""SELECT l_orderkey AS o_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (
          PARTITION BY l_returnflag ORDER BY {B.digest(7, "l_orderkey", "l_linenumber")}, l_orderkey, l_linenumber)
          <= 20000""",
)
def stratified_lines(spark, d):
    """Up to 20 000 lines per return flag, more than one task ranks."""
    lines = B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag"
    )
    return sampling.stratified_sample(lines, "l_returnflag", ["o_orderkey", "l_linenumber"], 20_000, seed=7)


@query(
    "w02_slice_batches",
    "sample_idx:i batch_id:i",
    """SELECT o_orderkey AS sample_idx,
              least(o_orderkey // (SELECT count(*) // 7 FROM orders), 6) AS batch_id FROM orders""",
)
def slice_batches(spark, d):
    return sampling.slice_batches(index(spark, d), 7)


_SPLIT = """CASE WHEN {0} < floor(n * 0.8::DOUBLE) THEN 'train'
            WHEN {0} < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END"""


@query(
    "d01_split_contiguous",
    "sample_idx:i split:s",
    f"""SELECT o_orderkey AS sample_idx, {_SPLIT.format("o_orderkey")} AS split
        FROM orders, (SELECT count(*) AS n FROM orders)""",
)
def split_contiguous(spark, d):
    return sampling.split_contiguous(index(spark, d))


@query(
    "d02_split_random",
    "sample_idx:i split:s",
    f"""SELECT sample_idx, {_SPLIT.format("r")} AS split FROM (
          SELECT o_orderkey AS sample_idx, count(*) OVER () AS n,
                 row_number() OVER (ORDER BY {B.digest(42, "o_orderkey")}, o_orderkey) - 1 AS r
          FROM orders)""",
)
def split_random(spark, d):
    return sampling.split_random(index(spark, d))


def _shuffle_sql(chunk: int, block: int) -> str:
    return f"""
ch AS (SELECT o_orderkey AS sample_idx, o_orderkey // {chunk} AS chunk_id,
              o_orderkey // {chunk} // {block} AS block_id FROM orders),
blk AS (
  SELECT block_id, row_number() OVER (ORDER BY {B.digest(42, "block_id")}, block_id) - 1 AS block_rank
  FROM (SELECT DISTINCT block_id FROM ch)
),
ranked AS (
  SELECT chunk_id, block_id, block_rank,
         row_number() OVER (ORDER BY block_rank, chunk_id) - 1 AS chunk_rank
  FROM (SELECT DISTINCT chunk_id, block_id FROM ch) JOIN blk USING (block_id)
),"""


SHUFFLE_SPEC = "sample_idx:i chunk_id:i block_id:i block_rank:i chunk_rank:i"
_SHUFFLED = "SELECT sample_idx, r.* FROM ch JOIN ranked r ON ch.chunk_id = r.chunk_id"


@query("d04_block_shuffle", SHUFFLE_SPEC, _SHUFFLED, _shuffle_sql(17, 32))
def block_shuffle(spark, d):
    return sampling.block_shuffle(index(spark, d), 17)


@query("d04_chunk_shuffle", SHUFFLE_SPEC, _SHUFFLED, _shuffle_sql(128, 1))
def chunk_shuffle(spark, d):
    return sampling.block_shuffle(index(spark, d), 128, block=1)


@query(
    "d06_assign_readers",
    "sample_idx:i chunk_rank:i reader:i",
    f"""SELECT sample_idx, chunk_rank,
              chunk_rank // CAST(ceil((SELECT count(*) FROM ranked) / 8::DOUBLE) AS BIGINT) AS reader
        FROM ({_SHUFFLED})""",
    _shuffle_sql(17, 32),
)
def assign_readers(spark, d):
    return sampling.assign_readers(sampling.block_shuffle(index(spark, d), 17), 8)


TOKEN = "sample_idx:i modality:s token_pos:i "


@query(
    "d15_token_table",
    TOKEN + "modality_idx:i week_idx:i is_temporal:b",
    "SELECT * FROM tok",
    B.ORDER_TOKENS,
)
def token_table(spark, d):
    return B.order_tokens(spark, d)


@query(
    "d15_series_tokens",
    TOKEN + "modality_idx:i week_idx:i value:f",
    " UNION ALL ".join(
        f"SELECT sample_idx, '{v}' AS modality, {i * 52} + pos AS token_pos, {i} AS modality_idx, "
        f"pos AS week_idx, {v} AS value FROM clean"
        for i, v in enumerate(B.VARS)
    ),
    B.CLEAN_SERIES,
)
def series_tokens(spark, d):
    """Four variables of 52 weeks: 208 tokens per supplier."""
    return tokens.series_tokens(B.clean_series(spark, d), "sample_idx", B.VARS)


_H = B.digest(42, "sample_idx", "token_pos")
_RANDOM = f"""
rnd AS (
  SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY {_H}, token_pos)
            <= floor(count(*) OVER (PARTITION BY sample_idx) * 0.75::DOUBLE) AS masked FROM tok
),"""
_STEPS = f"""
steps_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sample_idx, modality ORDER BY {_H}, token_pos) AS r,
         count(*) OVER (PARTITION BY sample_idx, modality) AS n FROM tok
),
steps AS (
  SELECT * EXCLUDE (r, n), n > 1 AND r <= greatest(least(floor(n * 0.75::DOUBLE), n - 1), 1) AS masked
  FROM steps_ranked
),"""
_WHOLE = f"""
drawn AS (
  SELECT batch_id, m, row_number() OVER (PARTITION BY batch_id
           ORDER BY {B.digest(42, "batch_id", "m")}, m) AS r
  FROM (SELECT DISTINCT batch_id FROM tok), (SELECT DISTINCT o_orderpriority AS m FROM orders)
),
whole AS (
  SELECT t.*, r <= 2 AS masked FROM tok t JOIN drawn d ON t.batch_id = d.batch_id AND modality = m
),"""
_PATTERN = f"""
pat AS (
  SELECT *, ['monthly', 'first_half', 'second_half'][
              CAST(floor({B.uniform(B.digest(42, "batch_id", "'pattern'"))} * 3) AS INTEGER) + 1] AS pattern
  FROM tok
),
weeks AS (
  SELECT *, is_temporal AND NOT (CASE pattern WHEN 'monthly' THEN week_idx % 4 = 0
              WHEN 'first_half' THEN week_idx >= 26 ELSE week_idx < 26 END) AS masked
  FROM pat
),"""
PATTERNS = ("monthly", "first_half", "second_half")


def _enforced(source: str) -> str:
    h = B.digest(42, "'ratio'", "sample_idx", "token_pos")
    return f"""SELECT * EXCLUDE (masked), row_number() OVER (PARTITION BY sample_idx
                 ORDER BY masked DESC, {h}, token_pos)
               <= floor(count(*) OVER (PARTITION BY sample_idx) * 0.75::DOUBLE) AS masked
               FROM {source}"""


@query("d08_mask_random", TOKEN + "masked:b", "SELECT * FROM rnd", B.ORDER_TOKENS + _RANDOM)
def mask_random(spark, d):
    return masking.mask_random(B.order_tokens(spark, d), "sample_idx")


@query("d09_mask_modality", TOKEN + "masked:b", "SELECT * FROM whole", B.ORDER_TOKENS + _WHOLE)
def mask_modality(spark, d):
    return masking.mask_modality(B.order_tokens(spark, d), "batch_id", B.PRIORITIES)


@query("d10_mask_timesteps", TOKEN + "masked:b", "SELECT * FROM steps", B.ORDER_TOKENS + _STEPS)
def mask_timesteps(spark, d):
    return masking.mask_timesteps(B.order_tokens(spark, d), "sample_idx")


@query(
    "d11_mask_pattern",
    TOKEN + "pattern:s masked:b",
    "SELECT * FROM weeks",
    B.ORDER_TOKENS + _PATTERN,
)
def mask_pattern(spark, d):
    return masking.mask_pattern(B.order_tokens(spark, d), "batch_id", PATTERNS)


@query(
    "d12_enforce_ratio",
    TOKEN + "masked:b",
    _enforced("steps"),
    B.ORDER_TOKENS + _STEPS,
)
def enforce_ratio(spark, d):
    return masking.enforce_ratio(mask_timesteps(spark, d), "sample_idx")


_U = B.uniform(B.digest(42, "batch_id", "'strategy'"))
_STRATEGY = f"""CASE WHEN {_U} < 0.25 THEN 'random' WHEN {_U} < 0.5 THEN 'modality'
                WHEN {_U} < 0.75 THEN 'timesteps' ELSE 'pattern' END"""


@query(
    "d13_choose_strategy",
    "batch_id:i strategy:s without_weeks:s weighted:s",
    f"""SELECT batch_id, {_STRATEGY} AS strategy,
              CASE WHEN {_U} >= 0.75 THEN 'random' ELSE {_STRATEGY} END AS without_weeks,
              CASE WHEN {_U} < 0.125 THEN 'random' WHEN {_U} < 0.25 THEN 'modality'
                   WHEN {_U} < 0.75 THEN 'timesteps' ELSE 'pattern' END AS weighted
        FROM (SELECT DISTINCT batch_id FROM tok)""",
    B.ORDER_TOKENS,
)
def choose_strategy(spark, d):
    """Equal weights, equal weights without week numbers, and uneven weights."""
    batches = B.order_tokens(spark, d).select("batch_id").distinct()
    batch = F.col("batch_id")
    return batches.withColumns(
        {
            "strategy": masking.choose_strategy(batch),
            "without_weeks": masking.choose_strategy(
                batch, available=("random", "modality", "timesteps")
            ),
            "weighted": masking.choose_strategy(batch, (1, 1, 4, 2)),
        }
    )


_STRUCTURED = f"""
mixed AS (
  SELECT t.*, {_STRATEGY.replace("batch_id", "t.batch_id")} AS strategy,
         CASE {_STRATEGY.replace("batch_id", "t.batch_id")} WHEN 'modality' THEN w.masked
              WHEN 'timesteps' THEN s.masked WHEN 'pattern' THEN k.masked ELSE FALSE END AS masked
  FROM tok t JOIN whole w ON t.sample_idx = w.sample_idx AND t.token_pos = w.token_pos
  JOIN steps s ON t.sample_idx = s.sample_idx AND t.token_pos = s.token_pos
  JOIN weeks k ON t.sample_idx = k.sample_idx AND t.token_pos = k.token_pos
),"""


@query(
    "d13_structured_mask",
    TOKEN + "strategy:s masked:b",
    _enforced("mixed"),
    B.ORDER_TOKENS + _WHOLE + _STEPS + _PATTERN + _STRUCTURED,
)
def structured_mask(spark, d):
    """The strategy of each batch, brought to the exact ratio."""
    return masking.structured_mask(
        B.order_tokens(spark, d), "sample_idx", "batch_id", B.PRIORITIES, patterns=PATTERNS
    )


@query(
    "d14_mask_slots",
    "sample_idx:i token_pos:i masked:b slot:i",
    """SELECT *, row_number() OVER (PARTITION BY sample_idx, masked ORDER BY token_pos) - 1 AS slot
       FROM rnd""",
    B.ORDER_TOKENS + _RANDOM,
)
def mask_slots(spark, d):
    return tokens.mask_slots(mask_random(spark, d), "sample_idx")


@query(
    "d14_mask_indices",
    "sample_idx:i kept:s removed:s",
    """SELECT sample_idx,
              coalesce(string_agg(token_pos, ',' ORDER BY token_pos) FILTER (WHERE NOT masked), '') AS kept,
              coalesce(string_agg(token_pos, ',' ORDER BY token_pos) FILTER (WHERE masked), '') AS removed
       FROM rnd GROUP BY 1""",
    B.ORDER_TOKENS + _RANDOM,
)
def mask_indices(spark, d):
    """The position arrays of every sample, written out as text."""
    lists = tokens.mask_indices(mask_random(spark, d), "sample_idx")
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return lists.withColumns({"kept": text("kept"), "removed": text("removed")})


@query(
    "d18_restore_order",
    "sample_idx:i token_pos:i value:i masked:b",
    """SELECT sample_idx, token_pos, CASE WHEN masked THEN -1 ELSE token_pos * 10 END AS value, masked
       FROM rnd""",
    B.ORDER_TOKENS + _RANDOM,
)
def restore_order(spark, d):
    """Kept values back at their positions, a placeholder at the masked ones."""
    slots = tokens.mask_slots(mask_random(spark, d), "sample_idx")
    values = slots.where(~F.col("masked")).withColumn("value", F.col("token_pos") * 10)
    return tokens.restore_slots(slots, values, "sample_idx", F.lit(-1).cast("bigint"))


@query(
    "d16_collate",
    "batch_id:i records:i first:i last:i total:f",
    """SELECT o_orderkey // 256 AS batch_id, count(*) AS records, min(o_orderkey) AS first,
              max(o_orderkey) AS last, sum(o_totalprice) AS total FROM orders GROUP BY 1""",
)
def collate(spark, d):
    """Batches of 256 records, summarised from the record arrays."""
    batches = sampling.collate(index(spark, d), ["o_totalprice"])
    r = F.col("records")
    return batches.select(
        "batch_id",
        F.element_at(r, 1)["sample_idx"].alias("first"),
        F.element_at(r, -1)["sample_idx"].alias("last"),
        F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x["o_totalprice"]).alias("total"),
        F.size(r).alias("records"),
    )


_MODEL = ", ".join(
    f"coalesce((c.{v} - (SELECT avg({v}) FROM clean WHERE valid)) / "
    f"(SELECT stddev_pop({v}) FROM clean WHERE valid), 0) AS {v}"
    for v in ("price", "tax")
)


@query(
    "d17_model_inputs",
    "sample_idx:i pos:i week_idx:i valid:b tax:f price:f lon_sin:f lat_cos:f crop_class:i elevation:f",
    f"""SELECT c.sample_idx, c.pos, c.pos % 52 AS week_idx, c.valid, {_MODEL},
              p.lon_sin, p.lat_cos, least(greatest(coalesce(s.s_nationkey, -1), 0), 3) AS crop_class,
              (s.s_acctbal - (SELECT avg(s_acctbal) FROM supplier))
                / (SELECT stddev_pop(s_acctbal) FROM supplier) AS elevation
        FROM clean c
        LEFT JOIN (SELECT sample_idx, sin(2 * pi() * lon / 360) AS lon_sin,
                          cos(2 * pi() * lat / 360) AS lat_cos FROM pts) p ON p.sample_idx = c.sample_idx
        LEFT JOIN supplier s ON s.s_suppkey = c.sample_idx""",
    B.CLEAN_SERIES + B.POINTS,
)
def model_inputs(spark, d):
    """Records of all suppliers with a series, coordinates, a class and a height, listed by step."""
    clean = B.clean_series(spark, d)
    suppliers = B.table(spark, d, "supplier").withColumnRenamed("s_suppkey", "sample_idx")
    coords = B.points(spark, d).select(
        "sample_idx",
        *[c.alias(n) for n, c in geo.cyclic_coords(F.col("lon"), F.col("lat")).items()],
    )
    height = suppliers.select("sample_idx", F.col("s_acctbal").alias("elevation"))
    crop = suppliers.select("sample_idx", V.clamp(F.col("s_nationkey"), 0, 3).alias("crop_class"))
    table = stats.dataset_stats(
        [
            stats.long_form(clean, "temporal_modalities", "ser", B.VARS, F.col("valid")),
            stats.long_form(height, "static_modalities", "elevation", ["elevation"]),
        ]
    )
    record = records.model_inputs(
        suppliers.select("sample_idx"),
        {"ser": records.Source(clean, ["tax", "price"])},
        {
            "encoded_coordinates": records.Source(coords, ["lon_sin", "lat_cos"]),
            "elevation": records.Source(height, ["elevation"]),
        },
        {"cropmask": crop},
        table,
        filled=["ser"],
    )
    steps = record.select(
        "sample_idx",
        "encoded_coordinates",
        "elevation",
        "cropmask",
        F.posexplode("ser.steps").alias("pos", "s"),
    )
    return steps.select(
        "sample_idx",
        "pos",
        "s.week_idx",
        "s.valid",
        F.col("s.data")[0].alias("tax"),
        F.col("s.data")[1].alias("price"),
        F.col("encoded_coordinates.data")[0].alias("lon_sin"),
        F.col("encoded_coordinates.data")[1].alias("lat_cos"),
        "cropmask.crop_class",
        F.col("elevation.data")[0].alias("elevation"),
    )
