"""Collocations of two and three words from a weighted de Bruijn graph of the corpus.

Nodes are word pairs, an edge joins two that overlap, and its weight counts the three words in a row. Every
word occurrence starts one edge: it leads on to the next pair, or to ``END`` where the piece ends. So what
leaves a node is the count of its pair, what leaves the nodes of a first word is the count of that word, and
only edges are counted and shuffled. Words too rare for any candidate are one word, ``OTHER``, on edges.

Nodes that all of their flow enters by one edge and leaves by one edge are compacted: a path has one weight,
which is the count of every pair and triple inside it.

Words are 64-bit ids of word and language. The dictionary that leads back to the words is checked for two words
of one id, and the run starts again with another seed if there are any, so that counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shingles import mix
from .storage import stored

UNKNOWN = "und"
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
# What an edge leads to beside words. No word has these ids.
OTHER, END = 0, 1
# Bits of the filter of frequent words, 8 MB whatever the input; a full filter only lets more edges pass.
FILTER_BITS = 26
# Bytes of text taken at a time (a longer text is one part), and words gathered before equal edges are merged.
PART_BYTES = 1 << 20
GATHERED = 1 << 21
SEEDS = 8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# 0 in a word, 1 between words, 2 between pieces
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(BLANKS)] = 1
_CLASS[list(BREAKS)] = 2


def _parts(texts: list, langs: list) -> Iterator[tuple[list[bytes], list[bytes]]]:
    held, tags, size = [], [], 0
    for text, lang in zip(texts, langs):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if held and size + len(data) > PART_BYTES:
            yield held, tags
            held, tags, size = [], [], 0
        held.append(data)
        tags.append(lang.encode("utf-8", "surrogatepass"))
        size += len(data) + 1
    if held:
        yield held, tags


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every stretch of ``raw``: a polynomial in an odd base, scrambled."""
    base = np.uint64((0x9E3779B97F4A7C15 + 2 * seed * 0x632BE59BD9B4E019) % (1 << 64) | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    size = len(raw) + 1
    power = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base)], dtype=np.uint64)
    back = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse)], dtype=np.uint64)
    total = np.zeros(size, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    found = (total[ends] - total[starts]) * back[starts]
    return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(part: list[bytes], tags: list[bytes], seed: int):
    """(folded bytes, starts, ends, ids, texts, joined) of all words of the texts, in order.

    ``texts`` is the text each word is from; ``joined`` tells whether the next word is in the same piece.
    """
    raw = _FOLD[np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)]
    kind = _CLASS[raw]
    inside = kind == 0
    before = np.concatenate(([False], inside[:-1]))
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    breaks = np.cumsum(kind == 2)[starts]
    joined = np.zeros(len(starts), dtype=bool)
    joined[:-1] = breaks[1:] == breaks[:-1]
    bounds = np.cumsum([len(x) + 1 for x in part])
    texts = np.searchsorted(bounds, starts, side="right")
    names = sorted(set(tags))
    letters = np.frombuffer(b"".join(names) + b"\n", dtype=np.uint8)
    cut = np.concatenate(([0], np.cumsum([len(x) for x in names], dtype=np.int64)))
    salt = _hashes(letters, cut[:-1], cut[1:], seed)
    own = salt[np.searchsorted(np.array(names, dtype=object), np.array(tags, dtype=object))]
    ids = mix(_hashes(raw, starts, ends, seed) + own[texts] * np.uint64(0xFF51AFD7ED558CCD))
    return raw, starts, ends, np.maximum(ids, np.uint64(END + 1)), texts, joined


def _vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """(id, lang, word, count) of every word of the corpus."""

    def run(batches):
        for batch in batches:
            langs = batch["lang"].tolist()
            done = 0
            for part, tags in _parts(batch["text"].tolist(), langs):
                raw, starts, ends, ids, texts, _ = words_of(part, tags, seed)
                found, first, counts = np.unique(ids, return_index=True, return_counts=True)
                data = raw.tobytes()
                word = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                lang = [langs[done + t] for t in texts[first].tolist()]
                yield pd.DataFrame({"id": found.view(np.int64), "lang": lang, "word": word, "count": counts})
                done += len(part)

    rows = docs.mapInPandas(run, "id bigint, lang string, word string, count bigint")
    return rows.groupBy("id", "lang", "word").agg(F.sum("count").alias("count"))


def frequent_filter(vocabulary: DataFrame, least: int) -> bytes:
    """One bit per slot of ids: whether a word that counts at least ``least`` falls on it. A fixed size."""
    # Spark's bitmaps count from 1, in buckets from 1 up
    slot = F.shiftrightunsigned("id", 64 - FILTER_BITS) + 1
    bits = (
        vocabulary.where(F.col("count") >= least)
        .select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    whole = bytearray((1 << FILTER_BITS) // 8)
    for row in bits.collect():
        at = (row["bucket"] - 1) * len(row["bits"])
        whole[at : at + len(row["bits"])] = row["bits"]
    return bytes(whole)


def _merged(columns: list[np.ndarray]) -> pd.DataFrame:
    """Equal edges as one with their count; edges that only share a sort key stay apart."""
    w1, w2, w3 = columns
    key = mix(mix(w1 + np.uint64(1)) * np.uint64(3) + mix(w2 + np.uint64(2)) * np.uint64(5) + w3)
    order = np.argsort(key)
    w1, w2, w3 = w1[order], w2[order], w3[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (w3[1:] != w3[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(order)))
    named = {"w1": w1, "w2": w2, "w3": w3}
    return pd.DataFrame({n: c[at].view(np.int64) for n, c in named.items()} | {"weight": counts})


def _edges(docs: DataFrame, frequent: bytes, seed: int) -> DataFrame:
    """(w1, w2, w3, weight): one edge per occurrence of a frequent word w1, merged per task."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        held, size = [], 0
        for batch in batches:
            for part, tags in _parts(batch["text"].tolist(), batch["lang"].tolist()):
                _, _, _, ids, _, joined = words_of(part, tags, seed)
                slots = (ids >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                known = (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
                w = np.concatenate((np.where(known, ids, np.uint64(OTHER)), np.zeros(2, np.uint64)))
                joined = np.append(joined, False)
                n = len(ids)
                w2 = np.where(joined[:n], w[1 : n + 1], np.uint64(END))
                w3 = np.where(joined[1 : n + 1], w[2 : n + 2], np.uint64(END))
                # behind a rare word, or behind the end, nothing is told apart
                w3 = np.where(w2 > END, w3, w2)
                held.append([c[known] for c in (w[:n], w2, w3)])
                size += len(held[-1][0])
                if size > GATHERED:
                    yield _merged([np.concatenate(c) for c in zip(*held)])
                    held, size = [], 0
        if size:
            yield _merged([np.concatenate(c) for c in zip(*held)])

    return docs.mapInPandas(run, "w1 bigint, w2 bigint, w3 bigint, weight bigint")


def _graph(edges: DataFrame, least: int, words: DataFrame | None = None) -> DataFrame:
    """(kind, w1, w2, w3, weight): edges (3), nodes (2) and words (1) that count at least ``least``.

    All come from one exchange by node: an edge's weights are summed there, a node's count is what
    leaves it, and a word's count what leaves the nodes it begins. ``words(w1, weight)`` are those counts
    where they are known, so that the edges need not be summed for them once more.
    """
    whole = edges.repartition("w1", "w2").groupBy("w1", "w2", "w3").agg(F.sum("weight").alias("weight"))
    nodes = whole.groupBy("w1", "w2").agg(F.sum("weight").alias("weight"))
    if words is None:
        words = nodes.groupBy("w1").agg(F.sum("weight").alias("weight"))
    none = F.lit(None).cast("bigint")

    def heavy(*ahead):
        """Enough of it, and words ahead. One comparison, as parts of it would move below the exchange,
        which then could not be shared."""
        none_ahead = F.lit(False)
        for c in ahead:
            none_ahead = none_ahead | F.col(c).isin(OTHER, END)
        return F.when(none_ahead, 0).otherwise(F.col("weight")) >= least

    return (
        whole.where(heavy("w2", "w3")).select(F.lit(3).alias("kind"), "w1", "w2", "w3", "weight")
        .union(nodes.where(heavy("w2")).select(F.lit(2), "w1", "w2", none, "weight"))
        .union(words.where(heavy()).select(F.lit(1), "w1", none, none, "weight"))
    )


def _ranked(links: DataFrame) -> DataFrame:
    """(node, tail, hops): every node's last follower over ``links(node, next)`` and the way to it.

    No two nodes have the same follower. Pointers double each round. A ring is cut in front of its
    smallest node, which it shows once a whole round has changed nothing.
    """
    done = None
    start = links.select("node", "next", F.lit(1).alias("hops"), F.col("node").alias("low"))
    tails = links.select(F.col("next").alias("node")).join(links.select("node"), "node", "left_anti")
    state = stored(start, "pointers")
    ended = stored(tails.select("node", F.col("node").alias("tail"), F.lit(0).alias("hops")), "tails")
    seen = None
    while True:
        count, lows = state.agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if not count:
            return ended
        if seen == (count, lows):
            # only rings are left, and each node knows the smallest of its ring
            cut = links.join(state.select("node", "low"), "node").where("next <> low")
            lone = state.join(cut.select("node"), "node", "left_anti").select("node")
            done = ended
            again = _ranked(cut.select("node", "next"))
            more = lone.join(again.select("node"), "node", "left_anti")
            more = more.select("node", F.col("node").alias("tail"), F.lit(0).alias("hops"))
            return done.union(again).union(more)
        seen = (count, lows)
        ahead = ended.select(F.col("node").alias("next"), "tail", F.col("hops").alias("rest"))
        joined = state.join(ahead, "next", "left")
        arrived = joined.where("tail is not null").select("node", "tail", (F.col("hops") + F.col("rest")).alias("hops"))
        going = state.select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("hops").alias("rest"), F.col("low").alias("near"))
        moved = joined.where("tail is null").drop("tail", "rest").join(going, "next")
        moved = moved.select("node", F.col("then").alias("next"), (F.col("hops") + F.col("rest")).alias("hops"), F.least("low", "near").alias("low"))
        ended = stored(ended.union(arrived), "tails")
        state = stored(moved, "pointers")


def compact_paths(graph: DataFrame) -> DataFrame:
    """(words, weight): the edges of the graph, those that follow each other through unary nodes as one path.

    A node is unary if one edge brings all of its count and one edge takes it on. Paths hold the ids
    of their words; a path of n words stands for n - 2 edges.
    """
    edges = graph.where("kind = 3").select("w1", "w2", "w3", "weight")
    edges = stored(edges.withColumn("edge", F.monotonically_increasing_id()), "edges")
    nodes = graph.where("kind = 2").select("w1", "w2", F.col("weight").alias("flow"))
    # an edge that carries the whole count of a node is its only one
    into = edges.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("edge").alias("node"), F.col("weight").alias("flow"))
    out = edges.select("w1", "w2", F.col("edge").alias("next"), F.col("weight").alias("flow"))
    links = nodes.join(into, ["w1", "w2", "flow"]).join(out, ["w1", "w2", "flow"]).select("node", "next")
    links = stored(links.where("node <> next"), "links")
    ranked = _ranked(links)
    placed = edges.join(ranked.withColumnRenamed("node", "edge"), "edge", "left")
    step = F.struct((-F.coalesce("hops", F.lit(0))).alias("at"), "w1", "w2", "w3")
    paths = placed.groupBy(F.coalesce("tail", "edge").alias("tail")).agg(
        F.array_sort(F.collect_list(step)).alias("steps"), F.max("weight").alias("weight")
    )
    last = F.element_at("steps", -1)
    words = F.concat(F.col("steps.w1"), F.array(last["w2"], last["w3"]))
    return stored(paths.select(words.alias("words"), "weight"), "paths")


def _cut(k: int, left: str, right: str) -> Column:
    """(score, k, l, r) of a cut: floor(1000000 * a * a / (l * r)), exact for counts up to 10^12."""
    wide = lambda c: f"cast({c} as decimal(13,0))"
    score = f"({wide('a')} * {wide('a')} * cast(1000000 as decimal(7,0))) div ({wide(left)} * {wide(right)})"
    return F.struct(F.expr(score).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, lang: Column, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words.

    Texts are folded from A-Z, cut into pieces and words, and counted with all overlaps per language (null:
    ``und``). A phrase is a candidate if it counts ``a >= least``; its score is that of its weakest cut, ties to
    the earliest one; it is dropped where a longer candidate around it counts at least ``inside`` per cent of
    it. Order: score, then a, both falling, then the phrase. Null and empty texts have no words; repeated
    rows count as often as they occur; an empty table gives an empty result; other columns are not looked at.
    """
    table = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(lang.cast("string"), F.lit(UNKNOWN)).alias("lang"))
    for seed in range(SEEDS):
        vocabulary = stored(_vocabulary(table, seed), "vocabulary")
        if vocabulary.groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise ValueError(f"two words share an id under each of {SEEDS} seeds")
    # every occurrence of a word starts one edge
    counted = vocabulary.select(F.col("id").alias("w1"), F.col("count").alias("weight"))
    graph = stored(_graph(_edges(table, frequent_filter(vocabulary, least), seed), least, counted), "graph")
    paths = compact_paths(graph)
    nodes = graph.where("kind = 2").select("w1", "w2", "weight")
    words = graph.where("kind = 1").select("w1", "weight")

    # three words: every step of a path. Inside the path a pair counts what the path weighs.
    at = F.posexplode(F.sequence(F.lit(1), F.size("words") - 2)).alias("place", "i")
    steps = paths.select("words", F.col("weight").alias("a"), at)
    steps = steps.select(
        *[F.element_at("words", F.col("i") + k).alias(f"w{k + 1}") for k in range(3)],
        "a",
        F.when(F.col("place") > 0, F.col("a")).alias("first"),
        F.when(F.col("i") < F.size("words") - 2, F.col("a")).alias("second"),
    )
    for name, pair in (("first", ("w1", "w2")), ("second", ("w2", "w3"))):
        flow = nodes.select(F.col("w1").alias(pair[0]), F.col("w2").alias(pair[1]), F.col("weight").alias("flow"))
        open_steps = steps.where(F.col(name).isNull()).drop(name).join(flow, list(pair)).withColumnRenamed("flow", name)
        steps = steps.where(F.col(name).isNotNull()).unionByName(open_steps)

    # two words: nodes, unless an edge into or out of them carries enough of their count
    edges = graph.where("kind = 3")
    around = edges.select("w1", "w2", "weight").union(edges.select("w2", "w3", "weight"))
    around = around.groupBy("w1", "w2").agg(F.max("weight").alias("longer"))
    pairs = nodes.withColumnRenamed("weight", "a").join(around, ["w1", "w2"], "left")
    pairs = pairs.where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    none = F.lit(None).cast("bigint")
    found = steps.unionByName(pairs.select("w1", "w2", "a", none.alias("w3"), none.alias("first"), none.alias("second")))

    names = vocabulary.select("id", "lang", "word")
    totals = vocabulary.groupBy("lang").agg(F.sum("count").alias("n"))
    for k in (1, 2, 3):
        known = words.join(names, F.col("w1") == F.col("id")).select(
            F.col("id").alias(f"w{k}"), F.col("weight").alias(f"f{k}"), F.col("word").alias(f"word{k}"),
            *(["lang"] if k == 1 else []),
        )
        found = found.join(known, f"w{k}", "left" if k == 3 else "inner")
    of_two, of_three = F.array(_cut(1, "f1", "f2")), F.array(_cut(1, "f1", "second"), _cut(2, "first", "f3"))
    cuts = F.when(F.col("w3").isNull(), of_two).otherwise(of_three)
    phrase = F.concat_ws(" ", "word1", "word2", "word3")
    scored = found.select("lang", phrase.alias("phrase"), "a", F.array_min(cuts).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = best.join(totals, "lang")
    return out.select(
        "lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", F.col("n").cast("bigint"), F.col("score").cast("bigint")
    )
