"""Packing documents into fixed-length sequences by a grouping genetic algorithm on islands.

Documents are dealt to blocks of bounded size. Each block is solved by several islands that evolve
populations of packings from different seeds. Crossover puts whole well-filled bins of one parent
into the other, takes out the bins that would use a document twice, and best-fits the displaced
documents. Between epochs each island's elite moves on to the next island. Documents of one length
are interchangeable, so islands work on lengths and the documents are matched to the slots after.
The emptiest bins of all blocks are opened once more and packed together.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

CAPACITY = 2048
BLOCK_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 4
POPULATION = 4
# Bins below this fill, and at most this share of a block's bins, are opened for the second level.
OPEN_FILL, OPEN_SHARE = 0.98, 0.05
END_ID = 0
# Runs without a break this long go to the tokenizer whose cost does not grow with their square.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """A function from a list of texts to their lists of ids.

    The two files hold one vocabulary. The rank form is several times faster on ordinary text; texts
    with very long unbroken runs, and those in which one of the JSON form's added tokens is spelled out (it
    is one id there), are encoded from the JSON form with its default settings.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    added = [token.content for token in exact.get_added_tokens_decoder().values()]
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def encode(text: str) -> list[int]:
        if LONG_RUN.search(text) or any(token in text for token in added):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def piece_bounds(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first of a cut document may be shorter."""
    first = total % capacity or capacity
    starts = [0, *range(first, total, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]


def tokenize(docs: DataFrame, capacity: int = CAPACITY, json_path=None, ranks_path=None) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) per piece; ``row`` numbers the input rows."""

    def run(batches):
        encode = encoder(json_path, ranks_path)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    out.append((row, doc_id, k, start, length, crc))
                row += 1
            out = pd.DataFrame(out, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(
        run, "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


class OpenBins:
    """Bins by free room, with a bit mask of the rooms in use: best fit without a search."""

    def __init__(self, bins: list[list[int]], capacity: int) -> None:
        self.by_room: dict[int, list[list[int]]] = {}
        self.mask = 0
        self.capacity = capacity
        for b in bins:
            self._put(b, capacity - sum(b))

    def _put(self, items: list[int], room: int) -> None:
        self.by_room.setdefault(room, []).append(items)
        self.mask |= 1 << room

    def add(self, item: int) -> None:
        fitting = self.mask >> item
        if not fitting:
            self._put([item], self.capacity - item)
            return
        room = item + (fitting & -fitting).bit_length() - 1
        same = self.by_room[room]
        items = same.pop()
        if not same:
            self.mask &= ~(1 << room)
        items.append(item)
        self._put(items, room - item)

    def bins(self) -> list[list[int]]:
        return [b for same in self.by_room.values() for b in same]


def best_fit(bins: list[list[int]], items: list[int], capacity: int) -> list[list[int]]:
    packed = OpenBins(bins, capacity)
    for item in sorted(items, reverse=True):
        packed.add(item)
    return packed.bins()


def fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, uneven fill, which leaves room that can be used."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def crossover(base: list, donor: list, capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of ``donor`` put into ``base``, and the rest mended by best fit."""
    ranked = sorted(donor, key=lambda b: (-sum(b), b))
    share = max(1, int(len(ranked) * rng.uniform(0.1, 0.5)))
    injected = [list(b) for b in ranked[:share]]
    surplus = Counter(x for b in injected for x in b)
    kept, displaced = [], []
    for b in rng.sample(base, len(base)):
        if any(surplus[x] > 0 for x in b):
            for x in b:
                if surplus[x] > 0:
                    surplus[x] -= 1
                else:
                    displaced.append(x)
        else:
            kept.append(list(b))
    return best_fit(injected + kept, displaced, capacity)


def mutate(bins: list, capacity: int, rng: random.Random) -> list[list[int]]:
    """Opens the emptiest bins and a few at random and packs their documents again."""
    ranked = sorted(bins, key=lambda b: (sum(b), b))
    count = max(2, len(ranked) // 50)
    out = ranked[:count] + rng.sample(ranked[count:], min(count, len(ranked) - count))
    gone = set(map(id, out))
    items = [x for b in out for x in b]
    rng.shuffle(items)
    packed = OpenBins([list(b) for b in bins if id(b) not in gone], capacity)
    for item in items:
        packed.add(item)
    return packed.bins()


def evolve(
    items: list[int], seeds: list, capacity: int, rng: random.Random, generations: int, population: int
) -> list[list[int]]:
    """The best packing an island finds, from the packings it was handed and its own."""
    bound = -(-sum(items) // capacity)
    members = [*seeds, best_fit([], items, capacity)]
    key = lambda m: fitness(m, capacity)
    best = max(members, key=key)
    while len(members) < population and len(best) > bound:
        members.append(mutate(rng.choice(members), capacity, rng))
    for _ in range(generations):
        best = max(members, key=key)
        if len(best) <= bound:
            break
        donor, base = rng.sample(members, 2)
        children = [crossover(base, donor, capacity, rng), crossover(donor, base, capacity, rng)]
        children.append(mutate(best, capacity, rng))
        members = sorted([*members, *children], key=key, reverse=True)[:population]
    return max(members, key=key)


def _flat(bins: list[list[int]]) -> tuple[list[int], list[int]]:
    bins = sorted((sorted(b, reverse=True) for b in bins), reverse=True)
    return [x for b in bins for x in b], [len(b) for b in bins]


def _nested(items, sizes) -> list[list[int]]:
    ends = np.cumsum(sizes)
    return [list(map(int, items[e - n : e])) for e, n in zip(ends, sizes)]


def solve_blocks(
    blocks: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS
) -> DataFrame:
    """(block, items, sizes): the best packing of each row of ``blocks(block, lengths)``.

    ``items`` lists the lengths bin after bin, ``sizes`` the number of items per bin.
    """
    state = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = state.withColumn("elites", F.array().cast("array<struct<items:array<int>,sizes:array<int>>>"))
    schema = "block bigint, island int, items array<int>, sizes array<int>, bins int, fill double"
    best = None
    for epoch in range(epochs):

        def run(batches, epoch=epoch):
            for batch in batches:
                out = []
                for block, island, lengths, elites in zip(
                    batch["block"], batch["island"], batch["lengths"], batch["elites"]
                ):
                    rng = random.Random(f"{block} {island} {epoch}")
                    seeds = [_nested(e["items"], e["sizes"]) for e in elites]
                    found = evolve(list(map(int, lengths)), seeds, capacity, rng, GENERATIONS, POPULATION)
                    out.append((block, island, *_flat(found), len(found), fitness(found, capacity)[1]))
                yield pd.DataFrame(out, columns=["block", "island", "items", "sizes", "bins", "fill"])

        best = stored(
            state.select("block", "island", "lengths", "elites").repartition("block", "island").mapInPandas(run, schema), "islands"
        )
        # an island keeps its own elite and is handed that of its neighbour
        own = best.select("block", "island", "items", "sizes")
        moved = own.withColumn("island", (F.col("island") + 1) % islands)
        elites = own.union(moved).groupBy("block", "island").agg(
            F.sort_array(F.collect_list(F.struct("items", "sizes"))).alias("elites")
        )
        state = blocks.join(elites, "block")
    order = F.struct(F.col("bins"), -F.col("fill"), F.col("island"))
    winner = best.groupBy("block").agg(F.min_by(F.struct("items", "sizes"), order).alias("w"))
    return winner.select("block", "w.items", "w.sizes")


def _pack_level(items: DataFrame, level: int, capacity: int, last: bool) -> DataFrame:
    """``items(row, length)`` with sequence_id, offset and whether the bin is opened again."""
    count = items.count()
    blocks = max(1, -(-count // BLOCK_ITEMS))
    items = items.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
    lengths = items.groupBy("block").agg(
        F.sort_array(F.collect_list(F.col("length").cast("int"))).alias("lengths")
    )
    solved = stored(solve_blocks(stored(lengths, "blocks"), capacity), "packed")

    def slots(batches):
        for batch in batches:
            for block, flat, sizes in zip(batch["block"], batch["items"], batch["sizes"]):
                bins = _nested(flat, sizes)
                fills = [sum(b) / capacity for b in bins]
                worst = sorted(range(len(bins)), key=lambda k: (fills[k], k))
                limit = 0 if last else max(1, int(len(bins) * OPEN_SHARE))
                opened = {k for k in worst[:limit] if fills[k] < OPEN_FILL}
                out, used = [], Counter()
                for k, b in enumerate(bins):
                    offset = 0
                    for x in b:
                        used[x] += 1
                        number = (level << 56) | (int(block) << 20) | k
                        out.append((block, x, used[x], number, offset, k in opened))
                        offset += x
                yield pd.DataFrame(out, columns=["block", "length", "nth", "sequence_id", "offset", "opened"])

    places = solved.mapInPandas(
        slots, "block bigint, length bigint, nth int, sequence_id bigint, offset bigint, opened boolean"
    )
    nth = F.row_number().over(Window.partitionBy("block", "length").orderBy("row"))
    placed = items.withColumn("nth", nth).join(places, ["block", "length", "nth"])
    return placed.select("row", "length", "sequence_id", "offset", "opened")


def pack(docs: DataFrame, capacity: int = CAPACITY, json_path=None, ranks_path=None) -> DataFrame:
    """Every piece of every row of ``docs(doc_id, text)`` with its place in a sequence.

    A null text counts as empty and is one piece, the end id. Only documents longer than a sequence
    are cut. Repeated rows and repeated or null ids are documents of their own, told apart by
    ``row``. An empty table gives an empty result. Other columns are not looked at.
    """
    pieces = stored(tokenize(docs, capacity, json_path, ranks_path), "pieces")
    small = pieces.where(F.col("length") < capacity).select("row", "length")
    first = stored(_pack_level(small, 1, capacity, last=False), "level")
    again = _pack_level(first.where("opened").select("row", "length"), 2, capacity, last=True)
    places = first.where("not opened").unionByName(again)
    places = places.select(F.col("row").alias("_row"), "sequence_id", "offset")
    full = pieces.where(F.col("length") == capacity)
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("bigint")
    )
    rest = pieces.where(F.col("length") < capacity).join(places, F.col("row") == F.col("_row")).drop("_row")
    return alone.unionByName(rest)
