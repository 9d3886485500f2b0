"""Ranks and bounded groups that hold up when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A group above this size is ranked in pieces.
HEAVY_ROWS = 1_000_000
# Up to this many rows per group, Spark's group limit keeps the first rows before the exchange.
GROUP_LIMIT = 16_384


def small_table(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` as a local table marked for broadcast, if it has at most ``max_rows`` rows.

    Runs a job that fetches no more than ``max_rows + 1`` rows. A larger table comes back as it
    is: its joins shuffle, and AQE splits their skewed partitions.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``left`` joined to the groups of ``right``; NULL keys form a group like any other."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(named, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def heavy_groups(
    df: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS
) -> DataFrame | None:
    """(keys, _n) of the groups too large for one task, None if there are none.

    Runs one counting job that combines before its exchange. A short list becomes a broadcast
    local table, a longer one stays distributed; no heavy group is left out.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.where(F.col("_n") > heavy_rows)
    found = small_table(largest)
    return None if found is not largest and found.isEmpty() else found


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    heavy_rows: int | None = HEAVY_ROWS,
) -> DataFrame:
    """Add ``_rank`` (1-based, per group) and ``_n`` (group size), both BIGINT.

    Without heavy groups this is one window. Otherwise heavy groups are cut by ``bucket``, an
    expression that never decreases along ``order``: each bucket is ranked on its own and shifted
    by the rows in earlier buckets, so no task sees a whole heavy group. ``order`` must be total.
    ``heavy_rows=None`` skips the check where the caller knows that groups are bounded.
    """
    keys = list(keys)
    heavy = None if heavy_rows is None else heavy_groups(df, keys, heavy_rows)
    if heavy is None:
        group = Window.partitionBy(*keys)
        return df.withColumn(
            "_rank", F.row_number().over(group.orderBy(*order)).cast("bigint")
        ).withColumn("_n", F.count(F.lit(1)).over(group))
    marked = join_groups(df, heavy.withColumnRenamed("_n", "_hn"), keys, "left").withColumn(
        "_b", F.when(F.col("_hn").isNotNull(), bucket)
    )
    group = Window.partitionBy(*keys, "_b")
    local = marked.withColumn("_local", F.row_number().over(group.orderBy(*order))).withColumn(
        "_size", F.count(F.lit(1)).over(group)
    )
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.where(F.col("_hn").isNotNull())
        .groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.sum("_c").over(earlier))
        .drop("_c")
    )
    return (
        join_groups(local, offsets, [*keys, "_b"], "left")
        .withColumn("_rank", F.col("_local").cast("bigint") + F.coalesce("_before", F.lit(0)))
        .withColumn("_n", F.coalesce("_hn", "_size"))
        .drop("_b", "_hn", "_local", "_size", "_before")
    )


def prefix_counts(df: DataFrame, digest: str, digits: int) -> list[tuple[str, int]]:
    """Sorted (digest prefix, rows) pairs: at most 16 ** digits of them, by one counting job."""
    prefix = F.substring(F.col(digest), 1, digits)
    rows = df.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["p"], r["n"]) for r in rows)


def global_hash_rank(df: DataFrame, digest: str, ties: Sequence[str], digits: int = 3) -> DataFrame:
    """Add ``_rank``, the 0-based position of every row in digest order.

    Rows are ranked per digest prefix and shifted by the rows of earlier prefixes.
    """
    starts, running = [], 0
    for prefix, n in prefix_counts(df, digest, digits):
        starts.append((prefix, running))
        running += n
    table = df.sparkSession.createDataFrame(starts, "_p string, _start bigint")
    order = Window.partitionBy("_p").orderBy(digest, *ties)
    return (
        df.withColumn("_p", F.substring(F.col(digest), 1, digits))
        .withColumn("_local", F.row_number().over(order) - 1)
        .join(F.broadcast(table), "_p")
        .withColumn("_rank", F.col("_start") + F.col("_local"))
        .drop("_p", "_local", "_start")
    )


def hash_rank(
    df: DataFrame, keys: Sequence[str], digest: str, ties: Sequence[str], heavy_rows: int | None = HEAVY_ROWS
) -> DataFrame:
    """`rank_within` in digest order; heavy groups are cut by the first three hex digits."""
    return rank_within(
        df,
        keys,
        [F.col(digest), *[F.col(t) for t in ties]],
        F.substring(F.col(digest), 1, 3),
        heavy_rows,
    )


def series_rank(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], heavy_rows: int | None = HEAVY_ROWS
) -> DataFrame:
    """`rank_within` in time order; heavy groups are cut by the hour."""
    return rank_within(
        df,
        keys,
        [F.col(ts), *[F.col(t) for t in ties]],
        F.date_trunc("hour", F.col(ts).cast("timestamp")),
        heavy_rows,
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark keeps only ``n`` rows per group before the exchange, so the size of a group does not
    matter.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n)


def first_by_digest(
    df: DataFrame, keys: Sequence[str], digest: str, ties: Sequence[str], n: int, digits: int = 3
) -> DataFrame:
    """`first_rows` in digest order for any ``n``, however many rows a group has.

    Counts per digest prefix, combined before their exchange, tell in which prefix a group's row
    ``n`` lies. Rows of earlier prefixes are taken where they are; only that one prefix is exchanged
    and ranked. One job finds the prefixes, a row per group, which are broadcast if they are few.
    """
    keys = list(keys)
    cut = df.withColumn("_p", F.substring(F.col(digest), 1, digits))
    order = Window.partitionBy(*keys).orderBy("_p")
    counts = cut.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))
    running = counts.withColumn("_until", F.sum("_c").over(order))
    # the first prefix that reaches n; a group that never does is taken whole
    reached = running.where(F.col("_until") >= n).groupBy(*keys).agg(
        F.min_by(F.struct(F.col("_p").alias("at"), (F.col("_until") - F.col("_c")).alias("before")), "_p").alias("_cut")
    )
    marked = join_groups(cut, small_table(reached), keys, "left")
    whole = marked.where(F.col("_cut").isNull() | (F.col("_p") < F.col("_cut")["at"]))
    edge = marked.where(F.col("_p") == F.col("_cut")["at"])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(digest, *ties))
    edge = edge.withColumn("_rank", rank).where(F.col("_rank") <= n - F.col("_cut")["before"]).drop("_rank")
    return whole.unionByName(edge).drop("_p", "_cut")


def bounded_lists(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    fields: Sequence[str],
    max_rows: int,
    name: str = "rows",
) -> DataFrame:
    """One ordered array of structs per group; a group above ``max_rows`` is an error.

    The limit is checked before anything is collected: no list grows past ``max_rows + 1``.
    """
    kept = first_rows(df, keys, order, max_rows + 1)
    packed = kept.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rank", *fields))).alias("_list")
    )
    too_long = F.raise_error(
        F.concat(F.lit(f"more than {max_rows} rows in group "), F.to_json(F.struct(*keys)))
    )
    checked = F.when(F.size("_list") > max_rows, too_long).otherwise(
        F.transform("_list", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    )
    return packed.select(*keys, checked.alias(name))


def split_long(
    df: DataFrame, keys: Sequence[str], max_rows: int, error: str = "error"
) -> tuple[DataFrame, DataFrame]:
    """(rows of groups with at most ``max_rows`` rows, (keys, error) of the others).

    For operators that refuse longer groups: one over-long group becomes a failure, and the rest goes
    on. Sizes come from a count that combines before its exchange, and no group is ever put together.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    reason = F.concat(F.col("_n").cast("string"), F.lit(f" rows, at most {max_rows} fit"))
    return join_groups(df, sizes.drop("_n"), keys, "left_anti"), sizes.select(*keys, reason.alias(error))


def position_in_group(
    df: DataFrame, keys: Sequence[str], position: str, span: int = 65_536, heavy_rows: int | None = HEAVY_ROWS
) -> DataFrame:
    """`rank_within` along an integer position; heavy groups are cut into ``span``-wide pieces."""
    return rank_within(
        df, keys, [F.col(position)], F.floor(F.col(position) / F.lit(span)), heavy_rows
    )
