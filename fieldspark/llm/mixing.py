"""Mixing sources to target weights by Sainte-Lague apportionment (Spark only).

Targets share the wanted size by weight; a target stops at a multiple of its source's size and the
rest is shared again. Documents are dealt to shards by a hash, and within a shard and source they
form a stream in seeded order that is cut into as few blocks of equal size as the block size allows.
Over the whole table, blocks go to the sources by highest quotients votes / (2 * seats + 1); a
source's votes are its target in blocks of its own mean size. Its seats are dealt to the shards by
cumulative rounding in the order of block size, so they miss the target by about a block however many
shards there are. In a shard a source then takes its quota of blocks: whole passes over its stream and
a seeded choice of distinct blocks for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MAX_REPEAT = 2
BLOCK_WORDS = 64
SHARD_DOCUMENTS = 20_000
# A prime above any number of blocks in a shard: multiplying by it permutes the block numbers.
STEP = 2_147_483_647


def count_words(text: Column) -> Column:
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    return F.coalesce(F.size(words), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``, one small row per source.

    The fair level is found in one pass: sorted by size per weight, the sources that stop are a
    prefix, and the level is what the wanted size leaves per remaining weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    sources = sources.withColumn("weight", F.get(weights, place % len(WEIGHTS)))
    sources = sources.withColumn("most", F.lit(float(MAX_REPEAT)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * (TOTAL_PERCENT / 100)
    left = wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    sources = sources.withColumn("_level", left / F.sum("weight").over(after))
    # the first source whose own limit lies above the level sets the level for all the rest
    free = F.when(F.col("_level") * F.col("weight") <= F.col("most"), F.col("_level"))
    level = F.first(free, ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))
    return sources.select("source", "source_size", target.alias("target"))


def apportion(votes: DataFrame, block: int) -> DataFrame:
    """(shard, source, seats) from ``votes(shard, source, votes)`` in words.

    Each shard has as many seats as blocks fit its votes. The final divisor lies within half a seat
    per source of the simple one, which leaves a few open seats per source; only their quotients
    are listed and ranked.
    """
    shard = Window.partitionBy("shard")
    v = votes.withColumn("all", F.sum("votes").over(shard)).withColumn("k", F.count("*").over(shard))
    v = v.withColumn("house", F.round(F.col("all") / block).cast("bigint"))
    v = v.withColumn("per", F.col("votes") / F.when(F.col("all") > 0, F.col("all")))
    sure = F.greatest(F.lit(0), F.floor(F.col("per") * (F.col("house") - F.col("k") / 2) - 0.5))
    most = F.ceil(F.col("per") * (F.col("house") + F.col("k") / 2) + 0.5)
    v = v.withColumn("sure", F.coalesce(sure, F.lit(0)).cast("bigint"))
    v = v.withColumn("most", F.coalesce(most, F.lit(0)).cast("bigint"))
    v = v.withColumn("open", F.col("house") - F.sum("sure").over(shard))
    tried = v.where("most > sure and votes > 0").withColumn(
        "seat", F.explode(F.sequence(F.col("sure") + 1, F.col("most")))
    )
    order = Window.partitionBy("shard").orderBy(
        (F.col("votes") / (2 * F.col("seat") - 1)).desc(), F.col("source").asc_nulls_last()
    )
    won = tried.withColumn("rank", F.row_number().over(order)).where("rank <= open")
    won = won.groupBy("shard", F.col("source").alias("_source")).agg(F.count("*").alias("won"))
    joined = v.join(won.withColumnRenamed("shard", "_shard"), (F.col("shard") == F.col("_shard")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("shard", "source", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("seats"))


def mix_sources(docs: DataFrame, keep: list[str], seed: int = 7, block: int = BLOCK_WORDS) -> DataFrame:
    """``keep`` columns of every row with size, source_size, target, taken, and what is taken.

    ``begin``, ``stream``, ``blocks``, ``passes``, ``rest`` and ``shift`` say which words: the document
    begins at word ``begin`` of the ``stream`` words of its shard and source, which are ``blocks`` blocks.
    A null text has size 0 and gives nothing; a null source is a source of its own, the last. A null
    doc_id is an id; repeated rows are documents of their own. Reruns and other partitionings give
    the same result. An empty table gives an empty result.
    """
    base = docs.select(
        *keep,
        F.col("source").cast("string").alias("_source"),
        count_words(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("_h"),
    )
    base = stored(base, "sizes")
    shards = max(1, -(-base.count() // SHARD_DOCUMENTS))
    base = base.withColumn("shard", F.pmod("_h", F.lit(shards)).cast("int"))
    cells = base.groupBy("shard", F.col("_source").alias("source")).agg(F.sum("size").alias("size"))
    cells = stored(cells.withColumn("blocks", F.ceil(F.col("size") / block).cast("bigint")), "cells")
    targets = source_targets(cells.select("source", "size"))
    in_all = cells.groupBy(F.col("source").alias("s")).agg(F.sum("blocks").alias("all_blocks"))
    targets = targets.join(in_all, F.col("source").eqNullSafe(F.col("s")))
    votes = F.col("target") * F.col("all_blocks") / F.when(F.col("source_size") > 0, F.col("source_size"))
    targets = stored(targets.withColumn("votes", F.coalesce(votes, F.lit(0.0))), "targets")
    # seats over the whole table, in blocks: one shard that stands for all
    seats = apportion(targets.select(F.lit(0).alias("shard"), "source", "votes"), 1)
    seats = targets.join(seats.select(F.col("source").alias("so"), "seats"), F.col("source").eqNullSafe(F.col("so")))
    seats = seats.select(
        F.col("source").alias("s"), "source_size", "target", "all_blocks",
        F.least(F.col("seats"), MAX_REPEAT * F.col("all_blocks")).alias("seats"),
    )
    plan = cells.join(broadcast_if_small(stored(seats, "seats")), F.col("source").eqNullSafe(F.col("s")))
    # cells of nearly equal blocks follow each other, so what rounding moves is made up by the next
    order = Window.partitionBy("source").orderBy(F.col("size") / F.col("blocks"), "shard")
    upto = F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = lambda n: F.floor(F.col("seats") * (n / F.col("all_blocks")) + 0.5)
    plan = plan.withColumn("upto", upto)
    quota = F.coalesce(dealt(F.col("upto")) - dealt(F.col("upto") - F.col("blocks")), F.lit(0))
    blocks = F.col("blocks")
    plan = plan.select(
        F.col("shard").alias("sh"), F.col("source").alias("so"), "source_size", "target",
        F.col("size").alias("stream"), "blocks",
        F.when(blocks > 0, F.floor(quota / blocks)).otherwise(0).cast("bigint").alias("passes"),
        F.when(blocks > 0, quota % blocks).otherwise(0).cast("bigint").alias("rest"),
        F.abs(F.xxhash64(F.lit(seed), "shard", "source") % 1_000_003).alias("shift"),
    )
    plan = broadcast_if_small(stored(plan, "quotas"))
    in_stream = Window.partitionBy("shard", "_source").orderBy("_h", *[F.col(k) for k in keep])
    base = base.withColumn("begin", F.sum("size").over(in_stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    base = base.join(plan, (F.col("shard") == F.col("sh")) & F.col("_source").eqNullSafe(F.col("so")))
    return base.withColumn("taken", taken_words()).select(
        *keep, "size", "source_size", "target", "taken", "begin", "stream", "blocks", "passes", "rest", "shift"
    )


def chosen(number: Column) -> Column:
    """Whether the block is among the ``rest`` blocks that the seeded permutation puts first."""
    step = F.lit(STEP).cast("bigint") % F.col("blocks")
    return ((number * step + F.col("shift")) % F.col("blocks")) < F.col("rest")


def document_blocks() -> Column:
    """The document's runs of words in chosen blocks: (first word in the document, words).

    Block b of a stream holds the words from b * stream / blocks on, rounded down.
    """
    end = F.col("begin") + F.col("size")
    edge = lambda b: F.call_function("div", b * F.col("stream"), F.col("blocks"))
    holding = lambda word: F.call_function("div", (word + 1) * F.col("blocks") - 1, F.col("stream"))
    numbers = F.sequence(holding(F.col("begin")), holding(end - 1))
    runs = F.transform(
        F.filter(numbers, chosen),
        lambda b: F.struct(
            (F.greatest(F.col("begin"), edge(b)) - F.col("begin")).alias("first"),
            (F.least(end, edge(b + 1)) - F.greatest(F.col("begin"), edge(b))).alias("words"),
        ),
    )
    return F.when((F.col("size") > 0) & (F.col("rest") > 0), runs).otherwise(
        F.array().cast("array<struct<first:bigint,words:bigint>>")
    )


def taken_words() -> Column:
    extra = F.aggregate(document_blocks(), F.lit(0).cast("bigint"), lambda a, r: a + r["words"])
    return F.col("passes") * F.col("size") + extra


def mixed_documents(docs: DataFrame, seed: int = 7, block: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` as the mix takes them: a row per whole pass, and one with the chosen blocks' words.

    The words of chosen blocks keep the white space behind them. Documents without words are
    outside the mix and stay as they are, once. Other columns are copied.
    """
    names = docs.columns
    kept = docs.select(F.struct(*names).alias("_row"), "doc_id", "source", "text")
    mixed = mix_sources(kept.select("_row", "doc_id", "source", "text"), ["_row"], seed, block)
    text = F.col("_row")["text"]
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(
        F.flatten(
            F.transform(
                document_blocks(),
                lambda r: F.slice(pieces, (r["first"] + 1).cast("int"), r["words"].cast("int")),
            )
        ),
        "",
    )
    part = F.col("taken") - F.col("passes") * F.col("size")
    whole = F.when(F.col("size") == 0, 1).otherwise(F.col("passes")).cast("int")
    texts = F.concat(
        F.array_repeat(text, whole),
        F.when(part == F.col("size"), F.array(text)).when(part > 0, F.array(cut)).otherwise(F.array().cast("array<string>")),
    )
    texts = F.when(F.col("size") == 0, F.array(text)).otherwise(texts)
    rows = mixed.select("_row", F.explode(texts).alias("_text"))
    return rows.select(
        *[
            F.col("_text").alias(c) if c == "text"
            else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col("_row")[c].alias(c)
            for c in names
        ]
    )
