"""Personal data: fixed patterns as seeds, and contexts bootstrapped from them (Spark only).

Mentions are tokens with a digit or an at sign; groups of digits side by side are one mention. A
mention that a seed covers is a known instance. A lexical pattern is the word before a mention, the
two words before it or the word after it, whatever the mention looks like; what it looks like is a
feature of its own, the part of a kind's known instances that share its coarse shape. Patterns and
instances are scored in turns: a pattern by the mean score of its distinct instances, an instance by
its best pattern and its shape. Instances above the bar count like seeds in the next turn, so patterns
without a seed can come in. Patterns that end above the bar name the kind of the mentions that no seed
covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import count_kind, labelled, matches, of_kind
from .storage import broadcast_if_small, stored

KINDS = ("email", "ip", "card", "phone")

# Equivalent to the plain forms, but each run of characters is tried once and loops do not recurse.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# A run of groups of digits, or any other token with a digit or an at sign.
GROUP = r"[0-9][^\x20\x09-\x0D@\p{L}]*+(?![^\x20\x09-\x0D])"
MENTION = (
    r"(?:(?<![^\x20\x09-\x0D])|\G)(?:"
    rf"[^\x20\x09-\x0D0-9@\p{{L}}]*+{GROUP}(?:(?<=[0-9)])\x20++\(?{GROUP})*+"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)

ROUNDS = 3
MIN_SEEDS = 5
CONFIDENCE = 0.8
MIN_DIGITS = 4


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return n.between(13, 19) & F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def seed_spans(text: Column) -> Column:
    """The fixed-pattern spans by kind, then start; matches that fail their test are dropped."""
    has_digit = text.rlike("[0-9]")
    phone_digits = lambda v: F.length(_digits(v)).between(9, 15)
    return F.concat(
        of_kind(matches(text, EMAIL, F.contains(text, F.lit("@"))), "email", 0, lambda v: F.lit(True)),
        of_kind(
            matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), "ip", 1, lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
        ),
        of_kind(matches(text, CARD, has_digit), "card", 2, lambda v: luhn(_digits(v))),
        of_kind(matches(text, PHONE, F.contains(text, F.lit("+"))), "phone", 3, phone_digits),
    )


def _shape(value: Column) -> Column:
    """The coarse shape of a mention; numbers of less than MIN_DIGITS digits are a shape of their own."""
    return (
        F.when(F.contains(value, F.lit("@")), "at")
        .when(value.rlike(r"\p{L}"), "mixed")
        .when(F.length(_digits(value)) >= MIN_DIGITS, "number")
        .otherwise("short")
    )


def _mentions(text: Column, seeds: Column) -> Column:
    """Every mention with its shape, its patterns and the kind of the seed that covers it, if any."""
    # from the start of a word only, and never shorter than whole: linear in runs of any length
    word = r"([^\x20\x09-\x0D]++)"
    blank = r"[\x20\x09-\x0D]++"
    start = r"(?<![^\x20\x09-\x0D])"

    def describe(m: Column) -> Column:
        one = F.lower(F.regexp_extract(m["before"], f"{start}{word}{blank}$", 1))
        two = F.lower(F.regexp_extract(m["before"], f"{start}({word}{blank}{word}){blank}$", 1))
        after = F.lower(F.regexp_extract(m["after"], f"^{blank}{word}", 1))
        cover = F.filter(seeds, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
        return F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["value"].alias("value"),
            _shape(m["value"]).alias("shape"),
            F.array(
                F.when(one != "", F.concat(F.lit("1 "), one)),
                F.when(two != "", F.concat(F.lit("2 "), two)),
                F.when(after != "", F.concat(F.lit("3 "), after)),
            ).alias("patterns"),
            F.get(F.transform(cover, lambda s: s["kind"]), 0).alias("seed"),
        )

    return F.transform(matches(text, MENTION, text.rlike("[0-9@]")), describe)


def _reached(places: DataFrame, patterns: DataFrame, fits: DataFrame) -> DataFrame:
    """``places(pattern, shape)`` under patterns above the bar whose kind their shape fits, with the
    kind and the score. Kinds made of digits need some digits."""
    good = patterns.where(F.col("score") >= CONFIDENCE)
    reached = places.join(good, "pattern").join(F.broadcast(fits), ["shape", "kind"])
    reached = reached.withColumn("score", F.col("score") * F.col("fit")).where(F.col("score") >= CONFIDENCE)
    return reached.where((F.col("kind") == "email") | (F.col("shape") != "short"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score) and (shape, kind, fit) from ``edges(pattern, instance, shape, seed)``.

    ``seed`` is a kind or null. Groups are reduced to sums before they meet, so a pattern with any
    number of instances is one row per task. A pattern's kind is that of most of its instances by
    score, the first by name on ties.
    """
    edges = stored(
        edges.groupBy("pattern", "instance", "shape").agg(F.min("seed").alias("seed")), "pattern-edges"
    )
    known = edges.where("seed is not null").select("instance", "shape", F.col("seed").alias("kind")).distinct()
    # at most four shapes and four kinds
    fits = known.groupBy("shape", "kind").agg(F.count("*").alias("n"))
    all_of = fits.groupBy("kind").agg(F.sum("n").alias("all"))
    fits = stored(fits.join(all_of, "kind").select("shape", "kind", (F.col("n") / F.col("all")).alias("fit")), "fits")
    current = edges.select("pattern", F.col("seed").alias("kind"), F.when(F.col("seed").isNotNull(), 1.0).alias("score"))
    for turn in range(rounds):
        # one row per pattern and kind; those without a kind count in the mean only
        sums = current.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("sum"))
        top = F.struct(-F.col("sum"), F.col("kind"), F.col("n"))
        patterns = sums.groupBy("pattern").agg(
            F.sum("n").alias("all"), F.min(F.when(F.col("kind").isNotNull(), top)).alias("top")
        )
        patterns = patterns.where(F.col("top.n") >= MIN_SEEDS).select(
            "pattern", F.col("top.kind").alias("kind"), (-F.col("top.col1") / (F.col("all") + 1)).alias("score")
        )
        if turn < rounds - 1:
            best = _reached(edges.where("seed is null"), patterns, fits).groupBy("instance")
            best = best.agg(F.max(F.struct("score", "kind")).alias("best"))
            current = edges.join(best, "instance", "left").select(
                "pattern",
                F.coalesce("seed", "best.kind").alias("kind"),
                F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("best.score")).alias("score"),
            )
    return patterns, fits


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_hash, seeds, found) per row of ``docs(doc_id, text)``.

    ``seeds`` are the fixed-pattern spans, ``found`` those that bootstrapped patterns add, both as
    arrays of (start, rank, end, kind, value) with code-point offsets; ``found`` never overlaps
    ``seeds``. A null or empty text has no spans. Repeated rows and repeated ids get equal results
    for equal texts; a null doc_id is a row like any other. Extra columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    base = base.withColumn("seeds", seed_spans(F.col("text")))
    base = base.withColumn("mentions", _mentions(F.col("text"), F.col("seeds"))).drop("text")
    base = stored(base, "mentions")
    each = base.select("text_hash", F.explode("mentions").alias("m")).select("text_hash", "m.*")
    edges = each.select(
        F.explode("patterns").alias("pattern"), F.xxhash64("value").alias("instance"), "shape", "seed"
    ).where("pattern is not null")
    patterns, fits = score_patterns(edges, rounds)
    unseen = each.where(F.col("seed").isNull()).withColumn("pattern", F.explode("patterns"))
    hits = _reached(unseen, patterns, fits).groupBy("text_hash", "start", "end", "value")
    hits = hits.agg(F.max(F.struct("score", "kind")).alias("best"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("best.kind")).cast("int") - 1
    added = hits.groupBy("text_hash").agg(
        F.sort_array(
            F.collect_set(F.struct("start", rank.alias("rank"), "end", F.col("best.kind").alias("kind"), "value"))
        ).alias("found")
    )
    empty = F.array().cast(added.schema["found"].dataType)
    return base.drop("mentions").join(added, "text_hash", "left").withColumn(
        "found", F.coalesce("found", empty)
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the seed spans and all spans, one row per document."""
    seeds = F.col("seeds")
    counts = [count_kind(F.col("seeds"), k) for k in KINDS]
    everything = F.array_sort(
        F.transform(
            F.concat(seeds, F.col("found")),
            lambda s: F.struct(s["rank"], s["start"], s["end"], s["kind"]),
        )
    )
    return found.select(
        "doc_id",
        *counts,
        F.sha2(labelled(seeds), 256).alias("base_sha256"),
        labelled(everything).alias("spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets.

    Overlapping spans are replaced as one, named after the first. A null text stays null. Rows and
    other columns are kept as they are.
    """
    found = find_personal_data(docs.select("doc_id", "text")).where("size(found) > 0")
    found = found.select(F.col("text_hash").alias("_hash"), F.col("found").alias("_found"))
    found = broadcast_if_small(found.dropDuplicates(["_hash"]))
    text = F.col("text").cast("string")

    # pieces of kept text and labels, cut at the spans that begin beyond all earlier ends
    reach = lambda spans, i: F.coalesce(
        F.array_max(F.transform(F.slice(spans, 1, i), lambda s: s["end"])), F.lit(0).cast("bigint")
    )
    piece = lambda s, i: F.when(
        s["start"] >= reach(F.col("_spans"), i),
        F.concat(
            F.substring(text, (reach(F.col("_spans"), i) + 1).cast("int"), (s["start"] - reach(F.col("_spans"), i)).cast("int")),
            F.lit("["), F.upper(s["kind"]), F.lit("]"),
        ),
    ).otherwise("")
    tail_from = reach(F.col("_spans"), F.size("_spans"))
    masked = F.concat(
        F.array_join(F.transform("_spans", piece), ""),
        F.substring(text, (tail_from + 1).cast("int"), F.length(text)),
    )
    joined = docs.withColumn("_hash", F.xxhash64(F.coalesce(text, F.lit("")))).join(found, "_hash", "left")
    seeds = seed_spans(F.coalesce(text, F.lit("")))
    empty = F.array().cast(found.schema["_found"].dataType)
    joined = joined.withColumn("_spans", F.array_sort(F.concat(seeds, F.coalesce("_found", empty))))
    return joined.withColumn("text", F.when(F.size("_spans") == 0, text).otherwise(masked)).select(*docs.columns)
