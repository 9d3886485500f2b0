"""Reproducible samples, splits, batches, chunks and file layout."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from . import ranking

SHARD = 1024
CHUNK = 128


def stratified_sample(
    df: DataFrame,
    stratum: str,
    ids: Sequence[str],
    n: int,
    seed: int = 42,
    group_limit: int = ranking.GROUP_LIMIT,
) -> DataFrame:
    """Up to ``n`` rows per stratum, chosen by the md5 order of seed and id.

    Above ``group_limit`` rows a stratum is no longer ranked in one task; the rows are the same.
    """
    hashed = df.withColumn("_h", V.seeded_hash(seed, *[F.col(i) for i in ids]))
    if n > group_limit:
        return ranking.first_by_digest(hashed, [stratum], "_h", ids, n).drop("_h")
    order = [F.col("_h"), *[F.col(i) for i in ids]]
    return ranking.first_rows(hashed, [stratum], order, n).drop("_h", "_rank")


def slice_batches(df: DataFrame, n: int, index: str = "sample_idx") -> DataFrame:
    """``n`` contiguous batches of a dense index; the last takes the rest."""
    total = df.agg(F.count(F.lit(1))).scalar()
    size = F.greatest(F.floor(total / F.lit(n)), F.lit(1))
    batch = F.least(F.floor(F.col(index) / size), F.lit(n - 1))
    return df.withColumn("batch_id", batch.cast("int"))


def _check_fractions(train: float, val: float, test: float) -> None:
    if not all(0 < f < 1 for f in (train, val, test)):
        raise ValueError("split fractions have to lie between 0 and 1")
    if not math.isclose(train + val + test, 1.0, rel_tol=0, abs_tol=1e-9):
        raise ValueError("split fractions have to sum to 1")


def split_contiguous(
    df: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1, index: str = "sample_idx"
) -> DataFrame:
    """Label a dense index: the first int(N·train) rows, the next int(N·val) rows, the rest."""
    _check_fractions(train, val, test)
    total = df.agg(F.count(F.lit(1))).scalar()
    train_end = F.floor(total * F.lit(train))
    val_end = train_end + F.floor(total * F.lit(val))
    position = F.col(index)
    name = F.when(position < train_end, "train").when(position < val_end, "val").otherwise("test")
    return df.withColumn("split", name)


def split_random(
    df: DataFrame,
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    index: str = "sample_idx",
) -> DataFrame:
    """`split_contiguous` over the md5 order, with the same exact sizes.

    One job counts rows per four-digit digest prefix (at most 65536 counts), a second one ranks
    the one or two prefixes a boundary falls into and fetches the boundary rows. The result
    compares every row with these two keys and moves nothing.
    """
    _check_fractions(train, val, test)
    hashed = df.withColumn("_h", V.seeded_hash(seed, F.col(index)))
    counts = ranking.prefix_counts(hashed, "_h", 4)
    total = sum(n for _, n in counts)
    train_end = math.floor(total * train)
    first_train, first_val = _rows_at(hashed, index, counts, [train_end, train_end + math.floor(total * val)])

    def before(cut: tuple[str, int] | None) -> Column:
        if cut is None:
            return F.lit(True)
        digest, i = F.lit(cut[0]), F.lit(cut[1])
        return (F.col("_h") < digest) | ((F.col("_h") == digest) & (F.col(index) < i))

    name = F.when(before(first_train), "train").when(before(first_val), "val").otherwise("test")
    return hashed.withColumn("split", name).drop("_h")


def _rows_at(
    hashed: DataFrame, index: str, counts: list[tuple[str, int]], places: list[int]
) -> list[tuple[str, int] | None]:
    """(digest, index) of the rows at the given places of the digest order, None behind the end."""
    wanted, running = [], 0
    for prefix, n in counts:
        wanted += [(prefix, at - running + 1, at) for at in places if running <= at < running + n]
        running += n
    if not wanted:
        return [None for _ in places]
    prefix = F.substring("_h", 1, 4)
    near = hashed.where(prefix.isin([p for p, _, _ in wanted])).select("_h", index)
    order = Window.partitionBy("_p").orderBy("_h", index)
    ranked = near.withColumn("_p", prefix).withColumn("_r", F.row_number().over(order))
    hit = F.lit(False)
    for p, r, _ in wanted:
        hit = hit | ((F.col("_p") == p) & (F.col("_r") == r))
    rows = {(x["_p"], x["_r"]): (x["_h"], x[index]) for x in ranked.where(hit).collect()}
    found = {at: rows[p, r] for p, r, at in wanted}
    return [found.get(at) for at in places]


def export_chunk(chunk: int, batch: int) -> int:
    """Chunk size for export: above four batches and not a multiple of the batch."""
    return max(chunk, 4 * batch + max(1, batch // 4))


def block_shuffle(
    df: DataFrame, chunk: int, block: int = 32, seed: int = 42, index: str = "sample_idx"
) -> DataFrame:
    """Shuffle blocks of ``block`` chunks of a dense index; chunks keep their order in a block.

    Chunks are counted from the first index of ``df``, which may be a part of a larger table. Adds ``chunk_id``, ``block_id``, ``block_rank`` and ``chunk_rank``. Only the table of blocks
    is ranked, one row per ``chunk * block`` samples. ``block=1`` shuffles the chunks.
    """
    first = df.agg(F.min(index)).scalar()
    chunks = df.withColumn("chunk_id", F.floor((F.col(index) - first) / F.lit(chunk))).withColumn(
        "block_id", F.floor(F.col("chunk_id") / F.lit(block))
    )
    blocks = (
        chunks.groupBy("block_id")
        .agg((F.max("chunk_id") - F.col("block_id") * block + 1).alias("_chunks"))
        .withColumn("_h", V.seeded_hash(seed, F.col("block_id")))
    )
    ranked = ranking.global_hash_rank(blocks, "_h", ["block_id"]).select(
        "block_id", "_chunks", F.col("_rank").alias("block_rank")
    )
    order = ranking.small_table(ranked)
    # every block is full but the last; blocks shuffled behind that one move up by its gap
    last = order.agg(F.max_by(F.struct("block_rank", "_chunks"), "block_id").alias("b")).first()["b"]
    last_rank, last_chunks = (last["block_rank"], last["_chunks"]) if last else (0, block)
    gap = F.when(F.col("block_rank") > last_rank, block - last_chunks).otherwise(0)
    start = F.col("block_rank") * block - gap
    inside = F.col("chunk_id") - F.col("block_id") * block
    return (
        chunks.join(order, "block_id")
        .withColumn("chunk_rank", start + inside)
        .drop("_chunks")
    )


def assign_readers(df: DataFrame, k: int, chunk_rank: str = "chunk_rank") -> DataFrame:
    """Contiguous runs of ceil(chunks / k) shuffled chunks per reader."""
    per_reader = F.ceil((df.agg(F.max(chunk_rank)).scalar() + F.lit(1)) / F.lit(k))
    return df.withColumn("reader", F.floor(F.col(chunk_rank) / per_reader).cast("int"))


def with_layout(
    df: DataFrame, chunk: int = CHUNK, shard: int = SHARD, index: str = "sample_idx"
) -> DataFrame:
    return df.withColumns(
        {
            "chunk_id": F.floor(F.col(index) / F.lit(chunk)),
            "shard_id": F.floor(F.col(index) / F.lit(shard)),
        }
    )


def relayout(
    df: DataFrame,
    chunk: int = CHUNK,
    shard: int = SHARD,
    index: str = "sample_idx",
    order: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Samples in index order, range-partitioned, with chunk and shard numbers.

    Range bounds come from sampled rows, so they follow the data. ``order`` continues the sort
    inside a sample; with it a sample with very many rows spans several partitions. Without a
    number of ``partitions`` AQE picks one by size.
    """
    laid = with_layout(df, chunk, shard, index)
    keys = ["shard_id", index, *order]
    ranged = laid.repartitionByRange(partitions, *keys) if partitions else laid.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def collate(
    df: DataFrame, fields: Sequence[str], batch_size: int = 256, index: str = "sample_idx"
) -> DataFrame:
    """Batches of records in index order; a batch holds at most ``batch_size`` records."""
    batched = df.withColumn("batch_id", F.floor(F.col(index) / F.lit(batch_size)))
    return ranking.bounded_lists(
        batched, ["batch_id"], [F.col(index)], [index, *fields], batch_size, "records"
    )
