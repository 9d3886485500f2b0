"""Near-duplicates by circulant MinHash: signatures, bands, and links confirmed on full shingle sets.

A first permutation scatters the shingles over a ring of 2^32 places; the second one, turned along the ring by one
more step for every coordinate, gives all coordinates: the smallest place that the set takes under it.
Two sets agree in a coordinate with the probability of their Jaccard similarity.

Documents of equal sets are one class. Classes that share a band are candidates. In a few rounds each is compared
with the best of its buckets' hubs (one set per bucket, picked by another hash each round, so that many buckets
pick the same), and then only sets of one bucket that are still in different components, so that a group of
copies is never expanded into its pairs. Before a pair is made, parities of the sets bound their difference
exactly and bits of the signatures estimate it. Every link is confirmed on the full sets of whole texts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ngram_join import BROADCAST_IDS, PARITY, parity_sketch
from .shingles import mix, set_key, shingle_sets
from .storage import stored

# Rows of a band, and bands: at a similarity of 0.8 all bands miss with probability 3 in 10^7.
ROWS, BANDS = 6, 50
# How far the second permutation is turned between coordinates; odd, so that no turn comes back early.
TURN = 0x9E3779B1
# One bit of each of the first coordinates, in 64-bit words: two sets agree in (1 + similarity) / 2 of them.
SKETCH_WORDS = 4
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
SKETCHES = [*SKETCH, *PARITY]
# Standard deviations below the expected agreement at the threshold that a pair may fall: 1 in 10^9 falls deeper.
DEVIATIONS = 6
# Rounds in which sets are compared with hubs.
HUB_ROUNDS = 3
# Shingles whose coordinates are made at a time, and members of a bucket that a part of it holds.
AT_A_TIME = 1 << 17
BUCKET_PART = 1000


def _places(hashes: np.ndarray) -> np.ndarray:
    """The first permutation: where on the ring each shingle falls."""
    return (mix(hashes + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


def _second(places: np.ndarray, work: np.ndarray) -> np.ndarray:
    """The second permutation, in place: multiplications by odd numbers and shifted sums are one to one."""
    for shift, factor in ((16, 0x21F0AAAD), (15, 0xD35A2D97)):
        np.right_shift(places, np.uint32(shift), out=work)
        np.bitwise_xor(places, work, out=places)
        np.multiply(places, np.uint32(factor), out=places)
    np.right_shift(places, np.uint32(15), out=work)
    return np.bitwise_xor(places, work, out=places)


def signatures(sets: list[np.ndarray], size: int = ROWS * BANDS) -> np.ndarray:
    """One row of ``size`` coordinates for each of some sets that are not empty."""
    out = np.empty((len(sets), size), dtype=np.uint32)
    first = 0
    while first < len(sets):
        last, held = first + 1, len(sets[first])
        while last < len(sets) and held + len(sets[last]) <= AT_A_TIME:
            held += len(sets[last])
            last += 1
        places = _places(np.concatenate(sets[first:last]))
        starts = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        turned, work = np.empty_like(places), np.empty_like(places)
        for k in range(size):
            np.add(places, np.uint32(k * TURN & 0xFFFFFFFF), out=turned)
            out[first:last, k] = np.minimum.reduceat(_second(turned, work), starts)
        first = last
    return out


def band_tokens(signature: np.ndarray) -> np.ndarray:
    """A 64-bit token of every band of every signature."""
    coordinates = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    token = mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :].repeat(len(signature), axis=0)
    for r in range(ROWS):
        token = mix(token * np.uint64(0xFF51AFD7ED558CCD) + coordinates[:, :, r])
    return token.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    bits = (signature[:, : 64 * SKETCH_WORDS] & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def _agreement(a: str, b: str) -> Column:
    """In how many bits of their sketches two sets agree."""
    differing = " + ".join(f"bit_count({s}_{a} ^ {s}_{b})" for s in SKETCH)
    return F.expr(f"{64 * SKETCH_WORDS} - ({differing})")


def least_agreement(percent: int) -> int:
    bits, p = 64 * SKETCH_WORDS, (1 + percent / 100) / 2
    return math.floor(bits * p - DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def _may_link(percent: int) -> Column:
    """True for every pair that links, but for the share of DEVIATIONS: close sizes, parities that differ in no more
    places than linked sets can, and enough bits that agree."""
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    odd = " + ".join(f"bit_count({p}_a ^ {p}_b)" for p in PARITY)
    # the symmetric difference is at most (100 - percent) per cent of the union
    few = F.expr(f"({odd}) * {100 + percent} <= {100 - percent} * (n_a + n_b)")
    return close & few & (_agreement("a", "b") >= least_agreement(percent))


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, hash, key, n, tokens, sketch) of every row; tokens only once a task for equal sets.

    ``hash`` tells the texts of a repeated doc_id apart.
    """

    def run(batches):
        seen = set()
        for batch in batches:
            sets = list(shingle_sets(batch["text"].tolist(), width))
            keys = [set_key(s) for s in sets]
            new = []
            for i, (named, key) in enumerate(zip(batch["doc_id"].notna(), keys)):
                if named and len(sets[i]) and key not in seen:
                    seen.add(key)
                    new.append(i)
            tokens, sketch = [None] * len(sets), np.zeros((len(sets), len(SKETCHES)), dtype=np.int64)
            if new:
                signature = signatures([sets[i] for i in new])
                for i, row in zip(new, band_tokens(signature)):
                    tokens[i] = row
                sketch[new, :SKETCH_WORDS] = sketches(signature)
                sketch[new, SKETCH_WORDS:] = [parity_sketch(sets[i]) for i in new]
            out = {"doc_id": batch["doc_id"].astype("Int64"), "hash": batch["hash"], "key": keys}
            out |= {"n": [len(s) for s in sets], "tokens": tokens}
            yield pd.DataFrame(out | {s: sketch[:, i] for i, s in enumerate(SKETCHES)})

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    names = "".join(f", {s} bigint" for s in SKETCHES)
    return rows.mapInPandas(run, f"doc_id bigint, hash bigint, key bigint, n int, tokens array<bigint>{names}")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys whose full sets link; each class is read from one of its texts."""
    for side in "ab":
        named = classes.select(
            F.col("key").alias(side), F.col("doc_id").alias(f"doc_{side}"), F.col("hash").alias(f"hash_{side}")
        )
        pairs = pairs.join(named, side)
    pairs = stored(pairs, "candidates")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    wanted = pairs.select(F.col("doc_a").alias("doc_id"), F.col("hash_a").alias("hash")).union(
        pairs.select("doc_b", "hash_b")
    )
    wanted = stored(wanted.distinct(), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, ["doc_id", "hash"], "left_semi")
    one = texts.groupBy("doc_id", "hash").count().where("count > 1")
    if not one.isEmpty():
        # else every copy of a row would meet every copy of the other
        texts = texts.dropDuplicates(["doc_id", "hash"])
    joined = pairs
    for side in "ab":
        own = texts.select("doc_id", "hash", "text").toDF(f"doc_{side}", f"hash_{side}", f"text_{side}")
        joined = joined.join(own, [f"doc_{side}", f"hash_{side}"])

    def run(batches):
        last, hub = None, None
        for batch in batches:
            kept = []
            sets_a = shingle_sets(batch["text_a"].tolist(), width)
            for a, b, text_b, set_a in zip(batch["a"], batch["b"], batch["text_b"], sets_a):
                if b != last:
                    last, hub = b, next(shingle_sets([text_b], width))
                common = len(np.intersect1d(set_a, hub, assume_unique=True))
                if 100 * common >= percent * (len(set_a) + len(hub) - common):
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return stored(joined.select("a", "b", "text_a", "text_b").mapInPandas(run, "a bigint, b bigint"), "links")


def _merged(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``found`` so far, which stand for their links, joined by new links."""
    if found is not None:
        if links.isEmpty():
            return found
        links = links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return stored(connected_components(links), "components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links, itself included; ``kept`` marks the rows that
    carry it. Two texts link when 100 * intersection >= percent * union of their sets of ``width``-word shingles
    and a band finds them, which it does for all but about 3 in 10^7 pairs at 80 per cent. Texts without words
    link with nothing. Repeated rows link like copies; rows without doc_id come back with a null component,
    not kept. An empty table gives an empty result. Columns other than doc_id and text are not looked at.
    """
    described = stored(_describe(docs, width), "sets")
    sets = described.select("doc_id", "key", F.col("n").alias("n_shingles"))
    named = described.where("n > 0 and doc_id is not null")
    classes = named.groupBy("key").agg(F.min(F.struct("doc_id", "hash")).alias("row"), F.max("n").alias("n"))
    classes = stored(classes.select("key", "n", "row.doc_id", "row.hash"), "classes")
    signed = stored(
        described.where("tokens is not null").dropDuplicates(["key"]).select("key", "n", "tokens", *SKETCHES), "signatures"
    )
    postings = signed.select("key", F.explode("tokens").alias("token"))
    picked = lambda t: F.min(F.struct(F.xxhash64("key", F.lit(t)).alias("hash"), "key")).alias(f"hub{t}")
    buckets = postings.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    # most buckets have one member: only the others are looked at again
    met = stored(postings.join(buckets, "token"), "buckets")
    hubs = met.groupBy("token").agg(*[picked(t) for t in range(HUB_ROUNDS)])
    hubs = hubs.select("token", *[F.col(f"hub{t}.key").alias(f"hub{t}") for t in range(HUB_ROUNDS)])
    stars = met.join(hubs, "token").select("key", F.posexplode(F.array(*[f"hub{t}" for t in range(HUB_ROUNDS)])).alias("turn", "hub"))
    stars = stars.where("key <> hub").distinct()
    sketch = signed.select("key", "n", *SKETCHES)
    for_side = lambda side: sketch.toDF(side, *[f"{c}_{side}" for c in ("n", *SKETCHES)])
    stars = stars.toDF("a", "turn", "b").join(for_side("a"), "a").join(for_side("b"), "b").where(_may_link(percent))
    stars = stored(stars.select("a", "b", "turn", _agreement("a", "b").alias("bits")), "stars")
    found = None
    for turn in range(HUB_ROUNDS):
        open_stars = stars.where(F.col("turn") == turn)
        if found is not None:
            for side in "ab":
                own = found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
                open_stars = open_stars.join(own, side, "left")
            open_stars = open_stars.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        best = open_stars.groupBy("a").agg(F.max(F.struct("bits", "b")).alias("hub"))
        links = _confirmed(best.select("a", F.col("hub.b").alias("b")), classes, docs, width, percent)
        found = _merged(found, links)

    # what is still open: members of one bucket in different components
    label = found.select(F.col("node").alias("key"), "component")
    placed = met.select("token", "key", "members").join(label, "key", "left")
    placed = placed.withColumn("component", F.coalesce("component", "key"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    placed = placed.join(mixed.where("low <> high").select("token"), "token").join(sketch, "key")
    placed = stored(placed.withColumn("parts", F.ceil(F.col("members") / BUCKET_PART).cast("int")), "open")
    names = ["key", "n", "component", *SKETCHES]
    one = placed.select("token", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"{c}_a") for c in names])
    two = placed.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in names])
    rest = one.join(two, ["token", "part"]).where(F.col("component_a") < F.col("component_b")).where(_may_link(percent))
    rest = rest.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
    more = _confirmed(rest, classes, docs, width, percent)
    found = _merged(found, more)

    label = found.select(F.col("node").alias("key"), "component")
    whole = classes.join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    chosen = whole.join(smallest, "component").select(F.col("key").alias("class"), "component_id")
    linked = sets.join(chosen, (F.col("key") == F.col("class")) & (F.col("n_shingles") > 0), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = linked.select("doc_id", F.col("n_shingles").cast("bigint"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
