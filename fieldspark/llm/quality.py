"""Quality rules with risk-controlled cutoffs (Spark only).

Each rule scores a document; above the cutoff of its stratum the document is rejected. Cutoffs come
from a fixed grid and are certified on labelled documents: with the good labelled documents of a
stratum as holdout, the exact binomial bound on the rate of good documents lost must lie below the
rule's share of the allowed risk. Grid values are tested from the mildest on and testing stops at the
first that fails, so only strata and rules enter the Bonferroni correction. Of the certified
cutoffs of a rule the one that separates bad from good labels best is used, the milder on ties.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, let, stored

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# rule -> grid of cutoffs, mildest (highest) first
GRIDS = {
    "symbol_rate": [2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2],
    "duplicate_line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "repeat_rate": [0.29, 0.25, 0.2, 0.15],
    "upper_rate": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5],
    "bang_rate": [2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3],
}
# Allowed rate of good documents lost per stratum, over all rules, and the chance of exceeding it.
RISK = 0.05
DELTA = 0.05
# How much worse losing a good document is than keeping a bad one.
GOOD_WEIGHT = 10.0


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the text."""

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
            twin = lambda x, k: (
                F.when(k > 0, same(x, F.get(s, k - 1))).otherwise(False) | same(x, F.get(s, k + 1))
            )
            marked = F.transform(s, lambda x, k: F.when(twin(x, k), x["i"]))
            return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, places), total)

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - WINDOW + 1),
        lambda i: F.xxhash64(F.slice(words, i, WINDOW)),
    )
    count = let(
        windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))
    )
    return F.when(F.size(words) <= WINDOW, 0).otherwise(count)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of every row's whole text; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*keep, text.alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.translate(x, BLANK, "")) > 0)
    from_words = let(
        _words(F.col("_text")),
        lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("repeat")),
    )
    base = base.select(
        *keep,
        from_words.alias("_w"),
        F.length(F.translate("_text", BLANK, "")).cast("bigint").alias("word_chars"),
        _count_of(F.col("_text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(lines, lambda x: F.size(x)).cast("bigint").alias("n_lines"),
        _count_of(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_upper"),
        _count_of(F.col("_text"), "!").cast("bigint").alias("n_bang"),
    )
    base = base.withColumn("n_words", F.col("_w.n").cast("bigint"))
    base = base.withColumn("n_repeat_words", F.col("_w.repeat").cast("bigint")).drop("_w")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def rule_scores() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "duplicate_line_rate": F.col("n_dup_lines") / lines,
        "repeat_rate": F.col("n_repeat_words") / words,
        "upper_rate": F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
        "bang_rate": F.col("n_bang") / words,
    }


def binomial_tail_log(k: Column, n: Column, p: float) -> Column:
    """Logarithm of P(X <= k) for X binomial(n, p), summed term by term; null where k > n * p.

    Beyond the mean the tail is about a half or more, so no bound at a small level can hold.
    """
    odds = math.log(p) - math.log1p(-p)
    first = n * F.lit(math.log1p(-p))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log(n - i + 1) - F.log(i) + odds
        top = F.greatest(state["total"], term)
        total = top + F.log(F.exp(state["total"] - top) + F.exp(term - top))
        return F.struct(term.alias("term"), total.alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.when(k <= n * p, F.aggregate(steps, start, add, lambda s: s["total"]))


def certify(
    labelled: DataFrame, risk: float = RISK, delta: float = DELTA, grids: dict = GRIDS
) -> DataFrame:
    """(stratum, rule, cutoff) from ``labelled(stratum, good, <one column per rule>)``.

    A stratum or rule without a certified, useful cutoff has no row: it rejects nothing.
    """
    share = risk / len(grids)
    tests = [(rule, i, float(c)) for rule, grid in grids.items() for i, c in enumerate(grid)]
    out = [F.col(rule) > c for rule, _, c in tests]
    counted = labelled.groupBy("stratum").agg(
        F.count(F.when(F.col("good"), 1)).alias("n_good"),
        F.count(F.when(~F.col("good"), 1)).alias("n_bad"),
        F.array(*[F.count(F.when(F.col("good") & o, 1)) for o in out]).alias("lost"),
        F.array(*[F.count(F.when(~F.col("good") & o, 1)) for o in out]).alias("caught"),
    )
    each = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(step).alias("step"),
            F.lit(cutoff).alias("cutoff"),
            F.get("lost", F.lit(i)).alias("lost"),
            F.get("caught", F.lit(i)).alias("caught"),
        )
        for i, (rule, step, cutoff) in enumerate(tests)
    ]
    counted = counted.select("stratum", "n_good", "n_bad", F.explode(F.array(*each)).alias("t"))
    counted = counted.select("stratum", "n_good", "n_bad", "t.*")
    strata = labelled.agg(F.greatest(F.count_distinct("stratum"), F.lit(1)).alias("strata"))
    counted = counted.crossJoin(F.broadcast(strata))  # one row
    level = F.lit(math.log(delta / len(grids))) - F.log("strata")
    tail = binomial_tail_log(F.col("lost"), F.col("n_good"), share)
    counted = counted.withColumn("ok", F.coalesce(tail <= level, F.lit(False)))
    path = Window.partitionBy("stratum", "rule").orderBy("step")
    counted = counted.withColumn("ok", F.min("ok").over(path))
    gain = F.col("caught") / F.greatest("n_bad", F.lit(1)) - GOOD_WEIGHT * F.col("lost") / F.greatest(
        "n_good", F.lit(1)
    )
    best = counted.where("ok").withColumn("gain", gain).groupBy("stratum", "rule")
    best = best.agg(F.max(F.struct("gain", "cutoff")).alias("best")).where("best.gain > 0")
    return best.select("stratum", "rule", "best.cutoff")


def judge(docs: DataFrame, labels: DataFrame, stratum: Column, keep: list[str]) -> DataFrame:
    """``measure`` of every row with ``kept``: false if the base rules fail or a cutoff is exceeded.

    Labels are matched by doc_id; a document labelled more than once is good only if all labels
    say so; labels without a document and documents without a label do no harm. A null stratum is
    a stratum. Empty texts fail the base rules. Empty tables give empty results; without labels the
    base rules decide alone.
    """
    scored = measure(docs.withColumn("stratum", F.coalesce(stratum.cast("string"), F.lit(""))), [*keep, "stratum"])
    for rule, score in rule_scores().items():
        scored = scored.withColumn(rule, score)
    scored = stored(scored, "quality")
    good = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").alias("_id")
    ).agg((F.min("quality") == 1).alias("good"))
    holdout = scored.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_id"))
    cutoffs = stored(certify(holdout), "cutoffs")
    by_stratum = cutoffs.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"_{rule}") for rule in GRIDS]
    )
    judged = scored.join(broadcast_if_small(by_stratum), "stratum", "left")
    out = F.lit(False)
    for rule in GRIDS:
        out = out | F.coalesce(F.col(rule) > F.col(f"_{rule}"), F.lit(False))
    judged = judged.withColumn("kept", ~(F.col("base_failed") | out))
    return judged.drop(*[f"_{rule}" for rule in GRIDS])
