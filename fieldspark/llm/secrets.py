"""Secrets: fixed patterns plus random-looking tokens, judged by who owns them (Spark only).

Every candidate value is hashed and counted over the whole corpus by distinct owners, distinct
repositories of owners, and distinct texts. A value that many owners hold in many texts is a copied example, so
is one that most owners hold, and one that two or more owners spread over many repositories in many texts;
one that a single owner holds, in however many places, or that a copied document brought to a few
more, looks live. How many are many grows with the number of owners, or of repositories. Random-looking tokens outside the
fixed patterns are reported when they look live.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import count_kind, labelled, matches, of_kind, overlaps
from .storage import let, stored

KINDS = ("assign", "access", "hex")
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
# Owners, and texts, from which on a value is a copied example, at the least.
EXAMPLE_OWNERS = 3
# Bits a character of a random-looking token, and the part it has of what its characters allow.
MIN_ENTROPY = 3.4
MIN_EVENNESS = 0.82



def _assigned(value: Column) -> Column:
    return F.regexp_extract(value, ASSIGN, 1)


def base_spans(text: Column) -> Column:
    """The fixed-pattern spans by start, then kind as listed."""
    keyword = text.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    return F.array_sort(
        F.concat(
            of_kind(matches(text, ASSIGN, keyword), "assign", 0, lambda v: F.length(_assigned(v)) >= 12),
            of_kind(matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), "access", 1, lambda v: F.lit(True)),
            of_kind(matches(text, HEX, text.rlike("[0-9a-f]{16}")), "hex", 2, lambda v: F.lit(True)),
        )
    )


def many_owners(owners: int) -> int:
    """How many of all ``owners`` are many."""
    return max(EXAMPLE_OWNERS, math.ceil(1 + math.log2(max(1, owners))))


def _random_looking(value: Column) -> Column:
    """Whether the characters are as even as random ones of the same classes and number would be."""

    def entropy(chars: Column) -> Column:
        part = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
        return F.aggregate(chars, F.lit(0.0), lambda total, c: total - part(c) * F.log2(part(c)))

    classes = (("[0-9]", 10), ("[a-z]", 26), ("[A-Z]", 26), ("[+/_=-]", 5))
    alphabet = sum((F.when(value.rlike(c), n).otherwise(0) for c, n in classes), F.lit(0))
    alphabet = F.when(value.rlike("^[0-9A-F]+$"), 16).otherwise(alphabet)
    most = F.log2(F.least(F.length(value), alphabet).cast("double"))
    return let(
        entropy(F.array_distinct(F.split(value, ""))),
        lambda bits: (bits >= MIN_ENTROPY) & (bits >= MIN_EVENNESS * most),
    )


def find_secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(doc_id, base, found, n_live, n_example) per row of ``docs(doc_id, text)``.

    ``base`` are the fixed-pattern spans, ``found`` the random-looking tokens outside them that look
    live; n_live and n_example count the judged values of both. A null or empty text has none. A null
    owner counts as one of its own, and so does a null repository of each owner. Repositories count for
    values of two or more owners only. Repeated rows do not change a count of owners or texts;
    repeated and null ids are rows like any other. Extra columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.xxhash64(owner), F.lit(0)).alias("owner"),
        F.xxhash64(owner, repository).alias("repository"),
        text.alias("text"),
    )
    base = base.withColumn("base", base_spans(F.col("text")))
    more = of_kind(matches(F.col("text"), TOKEN, F.col("text").rlike(TOKEN)), "random", 3, _random_looking)
    more = F.filter(more, lambda s: ~overlaps(F.col("base"), s["start"], s["end"]))
    base = stored(base.withColumn("more", more).drop("text"), "candidates")

    value = lambda s: F.when(s["kind"] == "assign", _assigned(s["value"])).otherwise(s["value"])
    judged = base.select(
        "text_hash", "owner", "repository", F.explode(F.concat("base", "more")).alias("s")
    )
    judged = judged.select(
        "text_hash", "owner", "repository", "s", F.sha2(value(F.col("s")), 256).alias("secret")
    )
    # distinct holders and texts first, so that a value in a third of all rows is one row per task and holder
    per_place = judged.groupBy("secret", "owner", "repository").count()
    per_owner = per_place.groupBy("secret", "owner").agg(F.count("*").alias("n"))
    held = per_owner.groupBy("secret").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    texts = judged.groupBy("secret", "text_hash").count().groupBy("secret").agg(F.count("*").alias("texts"))
    owners = held.join(texts, "secret")
    per_owner = base.groupBy("owner", "repository").count().groupBy("owner").agg(F.count("*").alias("n"))
    everyone, anywhere = per_owner.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    many, many_places = many_owners(everyone), many_owners(anywhere)
    # copies of one text stand for one owner, unless most owners hold one
    example = (F.col("owners") >= many) & ((F.col("texts") >= many) | (2 * F.col("owners") > everyone))
    spread = (F.col("owners") >= 2) & (F.col("repositories") >= many_places) & (F.col("texts") >= many_places)
    example = example | spread
    verdict = owners.select("secret", (~example).alias("live"))
    places = judged.dropDuplicates(["text_hash", "s"]).join(verdict, "secret")
    per_text = places.groupBy("text_hash").agg(
        F.sort_array(F.collect_set(F.when(F.col("live") & (F.col("s.rank") == 3), F.col("s")))).alias("found"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"),
    )
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast(per_text.schema["found"].dataType)
    return base.select("doc_id", "text_hash", "base").join(per_text, "text_hash", "left").select(
        "doc_id",
        "base",
        F.coalesce("found", empty).alias("found"),
        F.coalesce("n_live", zero).alias("n_live"),
        F.coalesce("n_example", zero).alias("n_example"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans, one row per document."""
    counts = [count_kind(F.col("base"), k) for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(labelled(F.col("base")), 256).alias("base_sha256"),
        labelled(F.array_sort(F.concat("base", "found"))).alias("spans"),
        "n_live",
        "n_example",
    )
