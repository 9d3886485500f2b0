"""Pairwise metrics and scores of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import losses, pairs
from . import bindings as B
from .filter_queries import _CALENDAR, crop_calendar
from .registry import query


@query(
    "j10_pair_summary",
    "batch_id:i sample_idx:i partners:i mean_cosine:f max_cosine:f distance_sum:f min_distance:f "
    "upper_pairs:i upper_distance:f",
    """SELECT batch_id, i AS sample_idx, count(*) AS partners, avg(sim) AS mean_cosine,
              max(sim) AS max_cosine, sum(dist) AS distance_sum, min(dist) AS min_distance,
              count(*) FILTER (WHERE i < j) AS upper_pairs,
              coalesce(sum(dist) FILTER (WHERE i < j), 0) AS upper_distance
       FROM pairs GROUP BY 1, 2""",
    B.PAIRS,
)
def pair_summary(spark, d):
    return pairs.pair_summary(B.embeddings(spark, d), "batch_id", "sample_idx", "z")


_SOFTMAX = """
den AS (SELECT batch_id, i, greatest(sum(exp(sim / 0.07)), 1e-8) AS den FROM pairs GROUP BY 1, 2),
row_loss AS (
  SELECT p.batch_id, p.i, avg(-ln(exp(sim / 0.07) / den + 1e-8)) AS loss
  FROM pairs p JOIN den d ON p.batch_id = d.batch_id AND p.i = d.i
  WHERE yi = yj AND yi > 0 GROUP BY 1, 2
),
contrastive AS (SELECT batch_id, avg(loss) AS loss, count(*) AS rows_ FROM row_loss GROUP BY 1),"""


@query(
    "a17_contrastive_loss",
    "batch_id:i loss:f rows_:i",
    "SELECT * FROM contrastive",
    B.PAIRS + _SOFTMAX,
)
def contrastive_loss(spark, d):
    loss = pairs.contrastive_loss(B.embeddings(spark, d), "batch_id", "sample_idx", "z", "label")
    return loss.withColumnRenamed("rows", "rows_")


_EAM = """
eam AS (
  SELECT batch_id,
         coalesce(avg(pow(dz - ds, 2)) FILTER (WHERE yi = yj AND yi > 0), 0) AS align,
         coalesce(avg(greatest(1 - dz, 0)) FILTER (WHERE yi <> yj), 0) AS shatter
  FROM pairs WHERE i < j GROUP BY 1
),"""


@query(
    "a18_eam_loss",
    "batch_id:i align:f shatter:f loss:f",
    "SELECT *, align + shatter AS loss FROM eam",
    B.PAIRS + _EAM,
)
def eam_loss(spark, d):
    return pairs.eam_loss(B.embeddings(spark, d), "batch_id", "sample_idx", "z", "s", "label")


@query(
    "a20_collapse_metrics",
    "batch_id:i repr_std:f repr_norm:f max_offdiag_cosine:f",
    """SELECT s.batch_id, repr_std, repr_norm, max_offdiag_cosine
       FROM (SELECT batch_id, avg(sd) AS repr_std
             FROM (SELECT batch_id, k, stddev_samp(x) AS sd
                   FROM (SELECT batch_id, unnest(range(64)) AS k, unnest(z) AS x FROM emb) GROUP BY 1, 2)
             GROUP BY 1) s
       JOIN (SELECT batch_id, avg(sqrt(list_dot_product(z, z))) AS repr_norm FROM emb GROUP BY 1) n
         ON n.batch_id = s.batch_id
       JOIN (SELECT batch_id, avg(top) AS max_offdiag_cosine
             FROM (SELECT batch_id, i, max(sim) AS top FROM pairs GROUP BY 1, 2) GROUP BY 1) m
         ON m.batch_id = s.batch_id""",
    B.PAIRS,
)
def collapse_metrics(spark, d):
    return pairs.collapse_metrics(B.embeddings(spark, d), "batch_id", "sample_idx", "z", B.DIM)


@query(
    "a13_mean_pool",
    "label:i dim:i mean:f",
    """SELECT label, dim, avg(x) AS mean
       FROM (SELECT label, unnest(range(64)) AS dim, unnest(z) AS x FROM emb) GROUP BY 1, 2""",
    B.EMBEDDINGS,
)
def mean_pool(spark, d):
    return losses.mean_pool(B.embeddings(spark, d), ["label"], "z")


_MSE = """
mse AS (
  SELECT modality, avg(pow(quantity * 1000 - price, 2)) / 1e6 AS loss, count(*) AS cells
  FROM masked WHERE masked AND price < 90000 GROUP BY 1
),"""


def reconstruction(spark, d):
    """Masked error of price predicted from quantity; very high targets are missing."""
    cells = B.cells_masked(spark, d)
    cell = ["modality", "sample_idx", "token_pos"]
    prediction = cells.select(*cell, (F.col("quantity") * 1000).alias("value"))
    target = cells.select(*cell, F.when(F.col("price") < 90000, F.col("price")).alias("value"))
    mask = cells.select("sample_idx", "token_pos", "masked")
    scored = losses.masked_mse(prediction, target, mask, cell, ["sample_idx", "token_pos"])
    return scored.withColumn("loss", F.col("loss") / F.lit(1e6))


@query("a14_masked_mse", "modality:s loss:f cells:i", "SELECT * FROM mse", B.CELLS_MASKED + _MSE)
def masked_mse(spark, d):
    return reconstruction(spark, d)


@query(
    "a15_cross_entropy",
    "loss:f rows_:i",
    """SELECT avg(ln(exp(z[1]) + exp(z[2]) + exp(z[3]) + exp(z[4])) - z[label + 1]) AS loss,
              count(*) AS rows_ FROM emb""",
    B.EMBEDDINGS,
)
def cross_entropy(spark, d):
    """The first four dimensions as class logits."""
    rows = B.embeddings(spark, d).withColumn("logits", F.slice("z", 1, 4))
    return losses.cross_entropy(rows, "logits", "label").withColumnRenamed("rows", "rows_")


_LENGTH = "CASE WHEN {e} >= {s} THEN {e} - {s} ELSE 365 - {s} + {e} END"


@query(
    "a16_season_mse",
    "kind:s loss:f rows_:i",
    f"""SELECT 'by_class' AS kind, avg((pow((120 - s) / 365::DOUBLE, 2)
              + pow((150 - ({_LENGTH.format(s="s", e="e")})) / 365::DOUBLE, 2)) / 2) AS loss,
              count(*) AS rows_ FROM target WHERE s IS NOT NULL AND e IS NOT NULL
        UNION ALL
        SELECT 'first_pair', avg((pow((120 - s1) / 365::DOUBLE, 2)
              + pow((150 - ({_LENGTH.format(s="s1", e="e1")})) / 365::DOUBLE, 2)) / 2),
              count(*) FROM target WHERE complete""",
    _CALENDAR,
)
def season_mse(spark, d):
    """A constant season prediction, scored with and without the crop class."""
    rows = crop_calendar(spark, d).withColumns({"sos": F.lit(120.0), "len": F.lit(150.0)})
    by_class = losses.season_mse(rows, "sos", "len", "cls", "calendar")
    first = losses.season_mse(rows, "sos", "len", None, "calendar")
    both = by_class.withColumn("kind", F.lit("by_class")).unionByName(
        first.withColumn("kind", F.lit("first_pair"))
    )
    return both.withColumnRenamed("rows", "rows_")


_ALL_LOSSES = """
all_losses AS (
  SELECT 'reconstruction' AS type, modality AS name, loss FROM mse
  UNION ALL SELECT 'contrastive', CAST(batch_id AS VARCHAR), loss FROM contrastive
  UNION ALL SELECT 'eam', CAST(batch_id AS VARCHAR), align + shatter FROM eam
),"""


@query(
    "a19_combine_losses",
    "kind:s total:f",
    """SELECT 'mean' AS kind, avg(loss) AS total FROM all_losses
       UNION ALL
       SELECT 'weighted', sum(loss * CASE WHEN type || ':' || name = 'contrastive:3' THEN 2.5
                                          WHEN type = 'contrastive' THEN 0.5
                                          WHEN type = 'reconstruction' THEN 0.25 ELSE 1 END)
       FROM all_losses""",
    B.CELLS_MASKED + _MSE + B.PAIRS + _SOFTMAX + _EAM + _ALL_LOSSES,
)
def combine_losses(spark, d):
    """Plain mean, and a sum weighted by full key, by type and by default."""
    e = B.embeddings(spark, d)
    line = lambda df, t, n: df.select(
        F.lit(t).alias("type"), F.col(n).cast("string").alias("name"), "loss"
    )
    table = (
        line(reconstruction(spark, d), "reconstruction", "modality")
        .unionByName(
            line(
                pairs.contrastive_loss(e, "batch_id", "sample_idx", "z", "label"),
                "contrastive",
                "batch_id",
            )
        )
        .unionByName(
            line(
                pairs.eam_loss(e, "batch_id", "sample_idx", "z", "s", "label"), "eam", "batch_id"
            )
        )
    )
    # a full-key weight of exactly 1 gives way to the weight of its type
    weights = {
        "contrastive:3": 2.5,
        "contrastive:4": 1.0,
        "contrastive": 0.5,
        "reconstruction": 0.25,
    }
    mean = losses.combine_losses(table).withColumn("kind", F.lit("mean"))
    weighted = losses.combine_losses(table, weights).withColumn("kind", F.lit("weighted"))
    return mean.unionByName(weighted)
