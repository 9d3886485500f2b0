"""Jaccard join on word shingle sets: a size-aware heavy-light join, and its components.

Equal sets become one class first. Small ("light") sets are matched by fixed-size subsets: two sets
of n and m shingles link when they share c(n, m) of them, so each emits its c-subsets, and sets
that meet under a subset are linked. Large ("heavy") sets are matched by inverted lists. A list only
holds a set under the rarest shingles that it cannot lose and still link; shingles of common words and
of passages that many documents hold come last, and so have short lists. Two sets are compared if they
meet early enough in both orders and their parity sketches differ in no more bits than linked sets can.
What travels by lists is narrow: members of short lists meet by key and place alone, and only the few pairs
that are left are given their sketches.
The boundary between the two is the size at which the counted cost is least.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .phrases import FILTER_BITS, frequent_filter
from .shingles import mix, ranked_shingle_sets, set_key, shingle_sets
from .storage import in_small_batches, stored

# Slots of the tables that say which shingles and words are frequent: as many bytes whatever the input.
SLOT_BITS = 22
# Slots whose levels one task puts together.
LEVEL_BLOCK = 1 << 15
# Bits of a set's parity sketch, in 64-bit words. Sets of a symmetric difference d differ in at most d bits.
PARITY_WORDS = 16
PARITY = [f"p{i}" for i in range(PARITY_WORDS)]
# The same for sets of more shingles than WIDE_FROM, whose differences would fill the small one: 1 KB a set.
WIDE_WORDS = 128
WIDE_FROM = 2000
# A word is counted where it makes up at least this part of a task's words.
WORD_PART = 1 << 18
# No boundary above this size is tried, so the size histogram read by the driver is bounded.
MAX_LIGHT = 32
# What a posting costs (shuffle, sort, candidate check) next to a subset, which needs no check.
POSTING_COST = 4.0
# Postings a task gathers before it hands them on.
FRAME_ROWS = 1 << 15
# A set's lists just before a list that go with it there, to tell whether two sets have met before.
EARLIER = 16
# Lists of up to this many members are paired whole: at most half as many pairs for each posting. Longer ones
# carry sketches, so that the join itself drops pairs that cannot link.
SHORT_LIST = 32
# Members of an open list that a part of it holds.
LIST_PART = 1000
# Ids (8 bytes each) or candidate pairs (32 bytes) up to this many are broadcast to pick texts; beyond, a shuffle
# join does it.
BROADCAST_IDS = 1_000_000


def needed_overlap(n: int, m: int, percent: int) -> int:
    """Smallest intersection i with 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles of a common order two linked sets cannot both avoid sharing."""
    return n - (-(-percent * n // 100)) + 1


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_count(n: int, limit: int, percent: int) -> int:
    return sum(
        math.comb(n, needed_overlap(n, m, percent))
        for m in partner_sizes(n, percent)
        if 0 < m <= limit
    )


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size, by the least cost of subsets plus postings over all sets."""

    def cost(limit: int) -> float:
        light = sum(k * subset_count(n, limit, percent) for n, k in sizes.items() if n <= limit)
        posted = sum(
            k * prefix_length(n, percent)
            for n, k in sizes.items()
            if n <= MAX_LIGHT and partner_sizes(n, percent)[-1] > limit
        )
        return light + POSTING_COST * posted

    return min(range(MAX_LIGHT + 1), key=lambda limit: (cost(limit), limit))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def parity_sketch(hashes: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """For every bit, whether an odd number of the set's hashes fall on it."""
    bits = 64 * words
    places = (hashes & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(places, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _may_link(percent: int) -> str:
    """True for every pair that links: the sketches differ in no more bits than the sets may."""
    differing = " + ".join(f"bit_count({p}_a ^ {p}_b)" for p in PARITY)
    return f"({differing}) <= n_a + n_b - 2 * {_needed_sql(percent)}"


def _not_too_wide(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` without those of large sets whose wide sketches tell that they do not link."""
    for side in "ab":
        pairs = pairs.join(wide.toDF(side, f"n_{side}", f"wide_{side}"), side, "left")
    differing = "aggregate(zip_with(wide_a, wide_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    may_link = f"{differing} <= n_a + n_b - 2 * {_needed_sql(percent)}"
    return pairs.where(f"coalesce({may_link}, true)").select("a", "b")


def _needed_sql(percent: int, sizes: str = "n_a + n_b") -> str:
    return f"cast(ceil({percent} * ({sizes}) / {100 + percent}D) as int)"


def _near(percent: int) -> str:
    """Whether a member can be the smaller set of a pair that first meets in this list.

    Before the first shingle that linked sets share, each holds only shingles it does not share; the smaller
    one shares at least as many as with a set of its own size. A list needs one such member.
    """
    return f"pair > 0 or pos <= n - {_needed_sql(percent, 'n + n')}"


def _may_meet(percent: int) -> str:
    """What two members a, b of a list pass if they first meet there; b is the larger set."""
    return (
        f"component_a <> component_b and (n_a < n_b or (n_a = n_b and key_a < key_b)) and n_b * {percent} <= n_a * 100 "
        f"and pos_a <= n_a - {_needed_sql(percent)} and pos_b <= n_b - {_needed_sql(percent)}"
    )


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs(a, b)`` of set keys with the sizes and sketches of both."""
    for side in "ab":
        sketch = classes.select("key", "n", *PARITY).toDF(side, f"n_{side}", *[f"{p}_{side}" for p in PARITY])
        pairs = pairs.join(sketch, side)
    return pairs


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """Per document its id, set key and size (kind 0); per task its frequent shingle slots (kind 1)
    and word slots (kind 2) with their counts."""

    def run(batches):
        counts = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        words = np.zeros(1 << SLOT_BITS, dtype=np.uint32)

        def count_words(hashes: np.ndarray) -> np.ndarray:
            np.add.at(words, _slots(hashes), 1)
            return np.zeros(len(hashes), dtype=np.int8)

        for batch in batches:
            keys, sizes, sketches, wide = [], [], [], []
            for hashes, _ in ranked_shingle_sets(batch["text"].tolist(), width, count_words):
                np.add.at(counts, _slots(hashes), 1)
                keys.append(set_key(hashes))
                sizes.append(len(hashes))
                sketches.append(parity_sketch(hashes))
                wide.append(parity_sketch(hashes, WIDE_WORDS) if len(hashes) > WIDE_FROM else None)
            out = {"kind": 0, "doc_id": batch["doc_id"].astype("Int64"), "key": keys, "n": sizes, "wide": pd.Series(wide, dtype=object)}
            sketch = np.array(sketches, dtype=np.int64).reshape(len(keys), PARITY_WORDS)
            yield pd.DataFrame(out | {p: sketch[:, i] for i, p in enumerate(PARITY)})
        mean = counts.mean()
        floors = (max(2, int(mean + 3 * math.sqrt(mean))), max(2, int(words.sum()) // WORD_PART))
        for kind, table, floor in zip((1, 2), (counts, words), floors):
            hot = np.flatnonzero(table > floor)
            out = {"kind": kind, "doc_id": pd.Series(hot, dtype="Int64"), "key": table[hot].astype(np.int64), "n": 0, "wide": None}
            yield pd.DataFrame(out | dict.fromkeys(PARITY, 0))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(
        run, "kind int, doc_id bigint, key bigint, n int, wide array<bigint>, " + ", ".join(f"{p} bigint" for p in PARITY)
    )


def _frequency_levels(described: DataFrame, kind: int) -> bytes:
    """One byte per slot: the logarithm of how often it was counted, 0 for the rare.

    Tasks put the bytes of a block of slots together, so the driver handles a few byte strings of a fixed
    total. The levels only choose the order of shingles; any order gives the same links.
    """
    counts = described.where(F.col("kind") == kind).groupBy(F.col("doc_id").alias("slot"))
    levels = counts.agg((4 * F.log2(F.sum("key").cast("double"))).cast("int").alias("level"))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        slots = rows["slot"].to_numpy(dtype=np.int64)
        held = np.zeros(LEVEL_BLOCK, dtype=np.uint8)
        held[slots % LEVEL_BLOCK] = rows["level"].to_numpy(dtype=np.uint8)
        return pd.DataFrame({"at": [slots[0] // LEVEL_BLOCK], "levels": [held.tobytes()]})

    blocks = levels.groupBy(F.floor(F.col("slot") / LEVEL_BLOCK)).applyInPandas(block, "at bigint, levels binary")
    whole = bytearray(1 << SLOT_BITS)
    for row in blocks.collect():
        whole[row["at"] * LEVEL_BLOCK : (row["at"] + 1) * LEVEL_BLOCK] = row["levels"]
    return bytes(whole)


def _lists(
    docs: DataFrame, width: int, percent: int, boundary: int, shared: Broadcast, repeated: Broadcast | None = None
) -> DataFrame:
    """(token, key, n, pair, pos): a set under its prefix shingles (pair 0) with their places in its
    order, or under its subsets (pair > 0). ``shared`` has the levels of shingles and of words; with
    ``repeated``, lists whose slot tells that they have one member are left out."""

    def run(batches):
        bits = np.frombuffer(repeated.value, dtype=np.uint8) if repeated else None
        levels, word_levels = [np.frombuffer(part, dtype=np.uint8) for part in shared.value]
        seen = set()
        rarity = lambda words: word_levels[_slots(words)]
        for batch in batches:
            tokens, keys, sizes, pairs, held = [], [], [], [], 0
            for hashes, common in ranked_shingle_sets(batch["text"].tolist(), width, rarity):
                n, key = len(hashes), set_key(hashes)
                # a copy in the same task adds nothing; the set key stands for all copies
                if not n or key in seen:
                    continue
                seen.add(key)
                if n <= boundary:
                    for m in partner_sizes(n, percent):
                        if not 0 < m <= boundary:
                            continue
                        small = min(n, m)
                        for part in combinations(hashes, needed_overlap(n, m, percent)):
                            tag = small * 4096 + max(n, m)
                            total = np.add.reduce(mix(np.array(part, np.uint64) + np.uint64(tag)))
                            tokens.append(np.array([total], np.uint64))
                            keys.append(key), sizes.append(n), pairs.append(small)
                            held += 1
                if partner_sizes(n, percent)[-1] > boundary:
                    # passages last, then by how common the words are, then by hash
                    level = levels[_slots(hashes)].astype(np.int64) * 4096 + common
                    first = hashes[np.argsort(level, kind="stable")][: prefix_length(n, percent)]
                    tokens.append(first)
                    keys.append(key), sizes.append(n), pairs.append(0)
                    held += len(first)
                if held > FRAME_ROWS:
                    yield frame(bits, tokens, keys, sizes, pairs)
                    tokens, keys, sizes, pairs, held = [], [], [], [], 0
            if keys:
                yield frame(bits, tokens, keys, sizes, pairs)

    def frame(bits, tokens, keys, sizes, pairs):
        rows = [len(part) for part in tokens]
        named = {"key": np.array(keys, np.int64), "n": sizes, "pair": pairs}
        out = {name: np.repeat(values, rows) for name, values in named.items()}
        token = np.concatenate(tokens)
        out = pd.DataFrame({"token": token.view(np.int64), **out, "pos": np.concatenate([np.arange(k) for k in rows])})
        if bits is None:
            return out
        slots = (token >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return out[(bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1]

    return docs.select(F.col("text").cast("string")).mapInPandas(
        run, "token bigint, key bigint, n int, pair int, pos int"
    )


def _verified(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, repeated: bool
) -> DataFrame:
    """The candidate pairs (a, b) of set keys that link, counted on whole texts.

    ``repeated``: some rows share a doc_id.
    """
    ids = classes.select("key", "doc_id")
    pairs = pairs.join(ids.select(F.col("key").alias("a"), F.col("doc_id").alias("doc_a")), "a")
    pairs = pairs.join(ids.select(F.col("key").alias("b"), F.col("doc_id").alias("doc_b")), "b")
    pairs = stored(pairs, "candidates")
    # Few pairs are sent to the texts, so that a text travels once for each pair and once to meet them.
    sent = F.broadcast if pairs.count() <= BROADCAST_IDS else lambda table: table
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))

    def texts(side: str) -> DataFrame:
        wanted = pairs.select(F.col(f"doc_{side}").alias("doc_id")).distinct()
        found = whole.join(sent(wanted), "doc_id", "left_semi")
        if repeated:
            # else every copy of a row would meet every copy of the other
            found = found.withColumn("hash", F.xxhash64("text")).dropDuplicates(["doc_id", "hash"])
        return found.select(F.col("doc_id").alias(f"doc_{side}"), F.col("text").alias(f"text_{side}"))

    left = texts("a").join(sent(pairs), "doc_a")
    joined = left.join(texts("b"), "doc_b").select("a", "b", "text_a", "text_b")

    def run(batches):
        last = (None, None, None)
        for batch in batches:
            kept = []
            sets_a = shingle_sets(batch["text_a"].tolist(), width)
            for a, b, text_b, set_a in zip(batch["a"], batch["b"], batch["text_b"], sets_a):
                if last[0] != b or last[1] is not text_b and last[1] != text_b:
                    last = (b, text_b, next(shingle_sets([text_b], width)))
                set_b = last[2]
                # a repeated doc_id may bring another text: it is not the set that was meant
                if set_key(set_a) != a or set_key(set_b) != b:
                    continue
                common = len(np.intersect1d(set_a, set_b, assume_unique=True))
                if 100 * common >= percent * (len(set_a) + len(set_b) - common):
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return stored(joined.mapInPandas(run, "a bigint, b bigint").distinct(), "links")


def _long_list_pairs(posted: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of long lists that may link and are in different components."""
    mixed = posted.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    posted = posted.join(mixed.where("low <> high").select("token"), "token")
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(-EARLIER, -1)
    posted = posted.withColumn("earlier", F.collect_list("token").over(before))
    parts = F.ceil(F.col("members") / LIST_PART).cast("int")
    open_lists = stored(posted.join(classes.select("key", *PARITY), "key").withColumn("parts", parts), "open")
    names = ["key", "n", "pos", "component", "earlier", *PARITY]
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    one = open_lists.select("token", part.alias("part"), *[F.col(c).alias(f"{c}_a") for c in names])
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    two = open_lists.select("token", each.alias("part"), *[F.col(c).alias(f"{c}_b") for c in names])
    return (
        one.join(two, ["token", "part"])
        .where(_may_meet(percent))
        .where(_may_link(percent))
        # two sets always pass in the first long list they share, or met in a short one; a later one need
        # not make them again
        .where("not arrays_overlap(earlier_a, earlier_b)")
        .select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
        .distinct()
    )


@in_small_batches
def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links, itself included. Two texts link
    when 100 * intersection >= percent * union of their shingle sets. Texts without words (null,
    empty, white space) link with nothing. Repeated rows link like any copies. Rows without doc_id
    come back with a null component. An empty table gives an empty result. Columns other than
    doc_id and text are not looked at.
    """
    described = stored(_describe(docs, width), "sets")
    sets = described.where("kind = 0").select("doc_id", "key", F.col("n").alias("n_shingles"))
    classes = (
        described.where("kind = 0 and n > 0 and doc_id is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), *[F.max(p).alias(p) for p in PARITY])
    )
    classes = stored(classes, "classes")
    wide = described.where("wide is not null and doc_id is not null").select("key", "n", "wide")
    wide = stored(wide.dropDuplicates(["key"]), "wide")
    ids = sets.where("doc_id is not null").groupBy("doc_id").count()
    repeated = not ids.where("count > 1").isEmpty()
    histogram = {
        r["n"]: r["count"] for r in classes.where(F.col("n") <= MAX_LIGHT).groupBy("n").count().collect()
    }
    boundary = choose_boundary(histogram, percent)
    named = docs.where(F.col("doc_id").isNotNull())
    levels = (_frequency_levels(described, 1), _frequency_levels(described, 2))
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    # Most lists have one member, or none that can be the smaller of a pair. They are found by counting tokens
    # alone, and a filter of a fixed size keeps them from travelling as postings; a full filter would only let
    # more of them pass.
    member = F.when(F.expr(_near(percent)), (1 << 32) + 1).otherwise(1)
    tokens = _lists(named, width, percent, boundary, shared).groupBy(F.col("token").alias("id")).agg(F.sum(member).alias("count"))
    # the members in the low half, of which near ones in the high half
    tokens = tokens.where(F.col("count") >= 1 << 32).withColumn("count", F.col("count").bitwiseAND((1 << 32) - 1))
    repeated_lists = docs.sparkSession.sparkContext.broadcast(frequent_filter(tokens, 2))
    lists = stored(_lists(named, width, percent, boundary, shared, repeated_lists), "postings")
    shared.destroy()
    repeated_lists.destroy()

    # Every member of a list against one set of it: the smallest is enough for subsets. For prefixes it
    # is the one of least key, which is a hash, as a set of usual size links with more of its near copies
    # than the smallest does, and many lists agree on it. Both are aggregates of plain numbers, combined
    # before they travel, and the lists that meet them again are a join, which is split where a list is long.
    ends = lists.groupBy("token", "pair").agg(
        F.min("key").alias("low"),
        F.max("key").alias("high"),
        F.min_by("n", "key").alias("n_low"),
        F.min(F.when(F.col("n") == F.col("pair"), F.col("key"))).alias("first"),
        F.count("*").alias("members"),
        F.max(F.expr(_near(percent))).alias("near"),
    )
    met = lists.join(ends.where("low <> high and near").drop("high", "near"), ["token", "pair"])
    met = stored(met, "lists")
    light = met.where("pair > 0 and key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    # the larger set is a, the smaller b
    own, hub = F.struct("n", "key"), F.struct(F.col("n_low").alias("n"), F.col("low").alias("key"))
    heavy = met.where("pair = 0 and key <> low").select(F.greatest(own, hub).alias("a"), F.least(own, hub).alias("b"))
    close = F.col("a.n") * percent <= F.col("b.n") * 100
    stars = heavy.where(close).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    stars = _sketched(stars, classes).where(_may_link(percent)).select("a", "b")
    stars = stored(_not_too_wide(stars, wide, percent), "stars")
    links = light.distinct().union(_verified(stars, classes, docs, width, percent, repeated))
    # stars over stored edges: read again, not written again
    found = connected_components(links)

    # What the stars left open: members of one list that are still in different components.
    label = found.select(F.col("node").alias("key"), "component")
    posted = met.where("pair = 0").select("token", "key", "n", "pos", "members")
    # copies in several tasks have left the same postings; a set's are few enough to be dealt by its key
    posted = posted.repartition("key").distinct().join(label, "key", "left")
    posted = stored(posted.withColumn("component", F.coalesce("component", "key")), "posted")
    names = ["key", "n", "pos", "component"]
    short = posted.where(F.col("members") <= SHORT_LIST)
    one, two = (short.select("token", *[F.col(c).alias(f"{c}_{side}") for c in names]) for side in "ab")
    rest = one.join(two, "token").where(_may_meet(percent)).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    rest = _sketched(rest.distinct(), classes).where(_may_link(percent)).select("a", "b")
    long = posted.where(F.col("members") > SHORT_LIST)
    if not long.isEmpty():
        rest = rest.union(_long_list_pairs(long, classes, percent))
    rest = _not_too_wide(rest.distinct(), wide, percent)
    rest = rest.join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    more = _verified(rest, classes, docs, width, percent, repeated)
    if not more.isEmpty():
        # the components so far stand for their links
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = connected_components(links.union(more.select("a", "b")))

    label = found.select(F.col("node").alias("key"), "component")
    classes = classes.join(label, "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    smallest = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(smallest, "component").select("key", "component_id")
    linked = sets.join(named.withColumnRenamed("key", "class"), (F.col("key") == F.col("class")) & (F.col("n_shingles") > 0), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return linked.select("doc_id", F.col("n_shingles").cast("bigint"), own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: of the smallest doc_id, the text of smallest hash.

    Groups are made of texts, so a repeated row is a copy, and a doc_id with several texts is in
    several groups. Rows without doc_id are in the groups of their texts too and come last there: one
    stays only where no row of the group has an id. Texts without words are in no group: their rows stay.
    """
    text, names = F.col("text").cast("string"), docs.columns
    others = F.to_json(F.struct(*[F.col(c) for c in names if c != "text"]))
    # equal pairs of hashes are equal rows
    marked = docs.withColumn("_text", F.xxhash64("doc_id", text)).withColumn("_row", F.xxhash64(others, text))
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = marked.where(worded).select(F.col("_text").alias("doc_id"), "text")
    found = jaccard_components(texts, width, percent).select("doc_id", "component_id").distinct()
    rows = marked.where(worded).select("_text", "_row", "doc_id").distinct()
    rows = rows.join(found.withColumnRenamed("doc_id", "_found"), F.col("_text") == F.col("_found"))
    best = rows.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", "_row")).alias("best")
    )
    best = best.select(F.col("best._text").alias("_text"), F.col("best._row").alias("_row"))
    kept = marked.where(worded).join(best, ["_text", "_row"], "left_semi").dropDuplicates(["_text", "_row"])
    return kept.select(*names).union(docs.where(~worded))
