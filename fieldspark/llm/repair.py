"""Repair of conversation structure: faults, cheapest edits to a legal sequence of roles, repaired turns.

Turns are marked by windows; each conversation becomes a string of one code a turn, and every distinct
string is aligned once with the grammar ``(s?(ua)+)?`` (see ``alignment``). The edits go back to the turns by
their places, so that texts never gather in one row: a conversation of any length streams through its task.

Rows are ordered by turn (nulls first), then role and text. A null role or text stands for one space, and
rows with a null conv_id form one conversation. Repeated rows are turns of their own (and duplicates). An
empty table gives an empty result. Columns beside conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import align, edits
from .storage import stored

# Which adjacent initials are legal, and the names of inserted and changed roles.
LEGAL = ["su", "ua", "au"]
WORDLESS = r"^[\x20\x09-\x0D]*$"
UNFINISHED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$"


def _turns(turns: DataFrame) -> DataFrame:
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(
        F.col("conv_id").alias("_id"),
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        spaced("role").alias("role"),
        spaced("text").alias("text"),
    )


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with faults planted by a checksum of their place: some rows lost, emptied, cut, repeated,
    given another role."""
    rows = _turns(turns)
    place = F.concat_ws(":", F.coalesce("conv", F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(place.cast("binary")) % 20
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(
        F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")
    ).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select(F.col("_id").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def mark_faults(turns: DataFrame) -> DataFrame:
    """(conv, place, turn, role, text, fault, code, illegal, new_turn) of every row, written once.

    ``fault`` is blank, duplicate, truncated or null; ``illegal`` says that the row's role may not follow the one
    before, ``new_turn`` that its turn number was not seen yet.
    """
    rows = _turns(turns).drop("_id")
    alike = Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("_seen", F.row_number().over(alike) > 1)
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(F.col("text").rlike(WORDLESS), "blank")
        .when(F.col("_seen"), "duplicate")
        .when(F.col("text").rlike(UNFINISHED), "truncated")
    )
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = (
        F.when(F.col("fault").isin("blank", "duplicate"), "x")
        .when(F.col("fault") == "truncated", F.upper("known"))
        .otherwise(F.col("known"))
    )
    before = F.lag(initial).over(order)
    rows = rows.withColumns(
        {
            "place": F.row_number().over(order),
            "illegal": before.isNotNull() & ~F.concat(before, initial).isin(LEGAL),
            "new_turn": F.col("turn").isNotNull() & ~F.lag("turn").over(order).eqNullSafe(F.col("turn")),
            "fault": fault,
            "known": known,
        }
    )
    rows = rows.select("conv", "place", "turn", "role", "text", "fault", code.alias("code"), "illegal", "new_turn")
    return stored(rows, "marked")


def _aligned(codes: DataFrame) -> DataFrame:
    """(codes, cost, audit, edits) of every distinct code string."""

    def run(batches):
        for batch in batches:
            found = [align(c) for c in batch["codes"]]
            yield pd.DataFrame(
                {
                    "codes": batch["codes"],
                    "cost": [cost for cost, _ in found],
                    "audit": [audit for _, audit in found],
                    "edits": [edits(c, audit) for c, (_, audit) in zip(batch["codes"], found)],
                }
            )

    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by a hash of its own: dealt by the codes themselves, few bytes would become one task again
    spread = codes.distinct().repartition(parts, F.xxhash64("codes"))
    return spread.mapInPandas(run, "codes string, cost bigint, audit string, edits array<string>")


def align_conversations(marked: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, edits) of every conversation."""
    of = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    span = F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn")
    per = marked.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"),
        of("blank"),
        of("duplicate"),
        of("truncated"),
        F.count_if("illegal").alias("illegal"),
        F.array_sort(F.collect_list(F.struct("place", "code"))).alias("_codes"),
    )
    per = per.withColumn("codes", F.array_join(F.col("_codes.code"), "")).drop("_codes")
    per = stored(per, "conversations")
    return stored(per.join(_aligned(per.select("codes")), "codes").drop("codes"), "aligned")


def _same(name: str, other: str) -> Column:
    return F.col(name).eqNullSafe(F.col(other))


def repaired_turns(marked: DataFrame, aligned: DataFrame) -> DataFrame:
    """(conv, place, step, role, text): the turns after repair, in the order of place and step.

    ``place`` is that of the row a turn stems from or is put in front of.
    """
    todo = aligned.select(F.col("conv").alias("_conv"), F.posexplode("edits").alias("_place", "_edit")).where("_edit <> ''")
    todo = todo.withColumn("_place", F.col("_place") + 1)
    rows = marked.select("conv", "place", "role", "text")
    joined = todo.join(rows, _same("conv", "_conv") & (F.col("place") == F.col("_place")), "left")
    steps = F.transform(F.split("_edit", ""), lambda e: e)
    each = joined.select("_conv", "_place", "role", "text", F.posexplode(steps).alias("step", "_do")).where("_do <> ''")
    role = (
        F.when(F.col("_do") == "k", F.col("role"))
        .when(F.lower("_do") == "u", "user")
        .otherwise("assistant")
    )
    text = F.when(F.col("_do").isin("U", "A"), "").otherwise(F.col("text"))
    return each.select(
        F.col("_conv").alias("conv"), F.col("_place").alias("place"), "step", role.alias("role"), text.alias("text")
    )


def _hashes(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): every conversation streams through a running hash in the order of its turns."""
    line = F.concat("role", F.lit(":"), "text").alias("line")

    def run(batches):
        conv, digest = None, None
        for batch in batches:
            done = []
            # "=" in front tells a conversation without id from none at all
            for this, text in zip(batch["conv"], batch["line"]):
                if digest is None or this != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = this, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.encode("utf-8"))
            yield frame(done)
        if digest is not None:
            yield frame([(conv, digest.hexdigest())])

    def frame(rows):
        return pd.DataFrame(rows, columns=["conv", "repaired_sha256"], dtype="object")

    ordered = (
        repaired.select(F.coalesce(F.concat(F.lit("="), "conv"), F.lit("")).alias("conv"), "place", "step", line)
        .repartition("conv")
        .sortWithinPartitions("conv", "place", "step")
    )
    return ordered.mapInPandas(run, "conv string, repaired_sha256 string")


def repair_report(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: counted faults, cost, audit and the hash of the repaired conversation.

    ``every(conv_id)`` names conversations that get a row even if ``turns`` has none of theirs.
    """
    marked = mark_faults(turns)
    aligned = align_conversations(marked)
    hashes = _hashes(repaired_turns(marked, aligned))
    ids = _turns(turns).select(F.col("_id").alias("conv_id")) if every is None else every.select("conv_id")
    ids = ids.distinct().withColumn("_conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    named = F.coalesce(F.concat(F.lit("="), "conv"), F.lit(""))
    aligned = aligned.withColumn("_conv", named).drop("conv", "edits")
    report = ids.join(aligned, "_conv", "left").join(hashes.withColumnRenamed("conv", "_conv"), "_conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return report.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
