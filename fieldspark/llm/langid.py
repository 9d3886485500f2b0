"""Language identification by partial matching: byte context trees with escape probabilities.

Per language, a tree of contexts of 0 to ``MAX_ORDER`` bytes holds how often each byte followed them in
the training sample; contexts seen too rarely are pruned and the size of a tree is bounded. After training
the counts are frozen. A byte is coded in its deepest kept context: -log2(count / (total + distinct)) if
it was seen there; else an escape, -log2(distinct / (total + distinct)), leads to the context one byte
shorter, where the bytes already refused no longer count, neither in the total nor in the distinct ones.
Below the empty context all bytes never seen share the rest. So the 256 probabilities of a place sum to 1.
The language with the shortest code for the text wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small

# Training documents per language, the first by a hash of their id; all of a text is used.
TRAIN_DOCUMENTS = 400
# Bytes of the longest context; with the byte itself a key has at most 7 bytes.
MAX_ORDER = 4
# A context seen less often in the sample is pruned, the empty one excepted: what few texts hold is
# remembered passages, of texts with a wrong label too, rather than language.
MIN_SEEN = 64
# Contexts per language, the most frequent; this bounds the model whatever the sample holds.
MAX_CONTEXTS = 16_000
FOLDS = 5
UNKNOWN = "und"
CHUNK_BYTES = 1 << 20


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def _keys(texts: list[bytes]) -> np.ndarray:
    """For every byte, text by text, its key: the ``MAX_ORDER`` bytes before it and itself.

    Each text comes with that many bytes in front.
    """
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    own = np.ones(len(raw), dtype=bool)
    own[((ends - lengths)[:, None] + np.arange(MAX_ORDER)).ravel()] = False
    at = np.flatnonzero(own)
    keys = raw[at]
    for back in range(1, MAX_ORDER + 1):
        keys |= raw[at - back] << (8 * back)
    return keys


def _pieces(texts: Iterable[tuple[int, str]], size: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(row, piece) of at most ``size`` own bytes, each behind the ``MAX_ORDER`` bytes that precede it;
    line feeds stand before a text."""
    for row, text in texts:
        data = b"\n" * MAX_ORDER + text.encode("utf-8", "surrogatepass")
        for at in range(0, len(data) - MAX_ORDER, size):
            yield row, data[at : at + MAX_ORDER + size]


def context_trees(
    docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS, min_seen: int = MIN_SEEN, max_contexts: int = MAX_CONTEXTS
) -> DataFrame:
    """(lang, level, key, n): how often a byte followed a kept context of ``level`` bytes in the bounded
    training sample of ``docs(doc_id, text, lang)``; the key is the context and the byte.

    With a context all its suffixes are kept: they were seen as often at least, and come first in ties.
    """
    named = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    # choose ids first, so that only the chosen texts travel; the limit is applied before the exchange
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = named.select("doc_id", "lang").withColumn("r", F.row_number().over(order))
    ids = ids.where(F.col("r") <= train_documents).select("doc_id", "lang").distinct()
    sample = named.join(broadcast_if_small(ids, 1_000_000), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def run(batches):
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                for _, piece in _pieces(enumerate(group["text"])):
                    found, counts = np.unique(_keys([piece]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "key": found, "n": counts})

    counted = sample.mapInPandas(run, "lang string, key bigint, n bigint")
    counted = counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(MAX_ORDER))).alias("level")
    # the counts of shorter contexts are sums of the longest ones'
    suffix = F.expr("key & (shiftleft(1L, 8 * (level + 1)) - 1)").alias("key")
    symbols = counted.select("lang", "key", "n", level).select("lang", "level", suffix, "n")
    symbols = symbols.groupBy("lang", "level", "key").agg(F.sum("n").alias("n"))
    symbols = symbols.withColumn("context", F.shiftright("key", 8))
    contexts = symbols.groupBy("lang", "level", "context").agg(F.sum("n").alias("seen"))
    contexts = contexts.where((F.col("seen") >= min_seen) | (F.col("level") == 0))
    often = Window.partitionBy("lang").orderBy(F.col("seen").desc(), "level", "context")
    contexts = contexts.withColumn("r", F.row_number().over(often)).where(F.col("r") <= max_contexts)
    return symbols.join(contexts, ["lang", "level", "context"], "left_semi").select("lang", "level", "key", "n")


class Level:
    """The kept contexts of one length, frozen: what followed each, and what an escape from it leaves."""

    def __init__(self, length: int, keys: np.ndarray, counts: np.ndarray, shorter: Level | None) -> None:
        order = np.argsort(keys)
        self.keys, self.counts = keys[order].astype(np.int64), counts[order].astype(np.float64)
        contexts, self.inside = np.unique(self.keys >> 8, return_inverse=True)
        self.distinct = np.bincount(self.inside, minlength=len(contexts)).astype(np.float64)
        self.total = np.bincount(self.inside, weights=self.counts, minlength=len(contexts))
        # the bytes that the next shorter context still offers, and their count, once those seen here are refused
        if shorter is None:
            self.left, self.left_total = 256 - self.distinct, np.zeros(len(contexts))
        elif len(contexts):
            place, _, _ = shorter.find(self.keys & ((1 << 8 * length) - 1))
            refused = np.bincount(self.inside, weights=shorter.counts[place])
            # every byte seen here was seen there, so one place of each context tells its totals
            first = shorter.inside[place[np.searchsorted(self.inside, np.arange(len(contexts)))]]
            self.left = shorter.distinct[first] - self.distinct
            self.left_total = shorter.total[first] - refused

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per key a place of its context (its own, if it has one), whether it has one, whether the context is kept."""
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[place] == wanted
        place = np.where(self.keys[place] >> 8 == wanted >> 8, place, np.maximum(place - 1, 0))
        return place, hit, self.keys[place] >> 8 == wanted >> 8


class Model:
    """The frozen context tree of one language: the code length of any key."""

    def __init__(self, levels: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        self.levels: list[Level] = []
        for length in range(MAX_ORDER + 1):
            at = levels == length
            if not at.any():
                break
            self.levels.append(Level(length, keys[at], counts[at], self.levels[-1] if length else None))

    def code_lengths(self, wanted: list[np.ndarray], parents: list[np.ndarray]) -> np.ndarray:
        """Bits of each of the last of ``distinct_keys``: coded from the empty context on, every level
        serves the keys whose context it has."""
        cost = after = hit = count = None
        for length, (keys, parent) in enumerate(zip(wanted, parents)):
            if length >= len(self.levels):
                cost = cost[parent]
                continue
            level = self.levels[length]
            place, here, kept = level.find(keys)
            at = level.inside[place]
            left, room = level.left[at], level.left[at] + level.left_total[at]
            if not length:
                beyond = np.log2(np.maximum(left, 1))
            else:
                # a byte refused by this context: the shorter one has it, escapes too, or offers nothing new
                below = np.where(hit[parent], np.maximum(count[parent], 1), np.maximum(left, 1))
                beyond = np.log2(np.maximum(room, 1) / below) + np.where(hit[parent], 0, after[parent])
                beyond = np.where(left > 0, beyond, after[parent])
            total, distinct = level.total[at], level.distinct[at]
            own = np.log2((total + distinct) / np.where(here, level.counts[place], distinct))
            own = own + np.where(here, 0, beyond)
            cost = own if not length else np.where(kept, own, cost[parent])
            after, hit, count = beyond, here, level.counts[place]
        return cost


def distinct_keys(keys: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Distinct keys by length of their context, for each its place among those one byte shorter, and the
    place of every given key among the longest."""
    longest, where = np.unique(keys, return_inverse=True)
    wanted, parents = [longest], []
    for length in range(MAX_ORDER, 0, -1):
        shorter, parent = np.unique(wanted[0] & ((1 << 8 * length) - 1), return_inverse=True)
        wanted.insert(0, shorter)
        parents.insert(0, parent)
    return wanted, [np.arange(len(wanted[0])), *parents], where


def identify(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs(doc_id, text, lang)``.

    Training uses a bounded sample (``train_documents`` per language) of the rows outside the held-out fold with
    text and lang; the driver reads and broadcasts its context trees alone, at most ``MAX_CONTEXTS``
    contexts a language. Prediction sees the text alone, the whole of it, a long one piece by piece. ``und`` with
    score 0 for a null text, a text without a letter, or if nothing was learned. The score is the winner's share
    of 2 ** -(code length per byte); on ties the first language by name wins. A null doc_id counts as held out.
    Repeated rows are rows like any other; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    trees = context_trees(docs, train_documents).toPandas()
    models = {
        lang: Model(g["level"].to_numpy(), g["key"].to_numpy(), g["n"].to_numpy())
        for lang, g in sorted(trees.groupby("lang"), key=lambda x: x[0].encode())
    }
    shared = spark.sparkContext.broadcast(models)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.when(letter, F.col("text").cast("string")).alias("text"),
    )

    def run(batches):
        models = shared.value
        names = list(models)
        for batch in batches:
            bits, sizes = np.zeros((len(batch), len(names))), np.zeros(len(batch))

            def add(part: list[tuple[int, bytes]]) -> None:
                own = [len(piece) - MAX_ORDER for _, piece in part]
                owner = np.repeat([row for row, _ in part], own)
                wanted, parents, where = distinct_keys(_keys([piece for _, piece in part]))
                sizes[:] += np.bincount(owner, minlength=len(batch))
                for j, model in enumerate(models.values()):
                    cost = model.code_lengths(wanted, parents)[where]
                    bits[:, j] += np.bincount(owner, weights=cost, minlength=len(batch))

            part, held = [], 0
            for row, piece in _pieces((i, t) for i, t in enumerate(batch["text"]) if t and names):
                part.append((row, piece))
                held += len(piece)
                if held >= CHUNK_BYTES:
                    add(part)
                    part, held = [], 0
            if part:
                add(part)
            predicted, score = np.full(len(batch), UNKNOWN, dtype=object), np.zeros(len(batch))
            coded = np.flatnonzero(sizes)
            if len(coded):
                gap = bits[coded] - bits[coded].min(axis=1, keepdims=True)
                predicted[coded] = np.array(names, dtype=object)[gap.argmin(axis=1)]
                score[coded] = 1 / np.exp2(-gap / sizes[coded, None]).sum(axis=1)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "held_out": batch["held_out"],
                    "lang_pred": predicted,
                    "score": score,
                }
            )

    return rows.mapInPandas(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
