"""Lempel-Ziv phrase fingerprints: parse a text into dictionary phrases, keep the smallest hashes.

Two texts that a compressor would find alike share most phrases, so the likeness of their sets,
estimated from the smallest hashes, stands for compression-like similarity.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import mix
from .storage import stored

# Hashes kept per text; the standard error of a likeness is at most 1 / (2 * sqrt(64)).
SIGNATURE = 64

_MASK = (1 << 64) - 1


class Parse:
    """An incremental phrase parse: each new phrase is a known one and one more byte."""

    def __init__(self) -> None:
        self.children: dict[int, int] = {}
        self.hashes: list[int] = [0xCBF29CE484222325]
        self.node = 0

    def copy(self) -> Parse:
        other = Parse()
        other.children, other.hashes, other.node = self.children.copy(), self.hashes.copy(), self.node
        return other

    def feed(self, data: bytes) -> Parse:
        children, hashes, node = self.children, self.hashes, self.node
        get = children.get
        for byte in data:
            key = node << 8 | byte
            node = get(key, 0)
            if not node:
                children[key] = len(hashes)
                hashes.append((hashes[key >> 8] ^ byte) * 0x100000001B3 & _MASK)
        self.node = node
        return self

    def signature(self) -> np.ndarray:
        """The smallest distinct 32-bit phrase hashes in order."""
        phrases = mix(np.array(self.hashes[1:], dtype=np.uint64)) >> np.uint64(32)
        return np.unique(phrases)[:SIGNATURE].astype(np.uint32)


def fingerprint(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode("ascii")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases; two empty sets are alike."""
    union = np.union1d(a, b)[:SIGNATURE]
    if not len(union):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, common, assume_unique=True).mean())


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def compare(text: str, following: str) -> tuple:
    """Fingerprints of a text and its edited form, and how near the edited and the next text are."""
    count = len(text) // 3
    kept, insert = text[: len(text) - count], following[:count]
    start = Parse().feed(_utf8(kept))
    edited = start.copy().feed(_utf8(insert)).signature()
    own = start.feed(_utf8(text[len(text) - count :])).signature()
    digest = hashlib.sha256(_utf8(kept + insert)).hexdigest()
    return len(text), digest, own, edited


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` compared with its edited text and with the next document.

    The next document is the next in descending order of doc_id (null ids last; rows of one id by
    text), after the last the first. Texts are range-partitioned once and streamed in that order;
    only the first and the last row of each partition meet their neighbours in a second step. A null
    text counts as empty; two empty texts are alike. A lone document is its own next. An empty table
    gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    by_id = F.col("doc_id").desc_nulls_last()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    rows = rows.repartitionByRange(parts, by_id).sortWithinPartitions(by_id, "text")

    def run(batches):
        part, first, held, waiting = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            done = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                row = (None if pd.isna(doc_id) else int(doc_id), text)
                if held is None:
                    first = row
                else:
                    # the next text's own signature is made when its turn comes: one row behind
                    made = half(held, text)
                    if waiting:
                        done.append(whole_row(waiting.pop(), made[3]))
                    waiting.append(made)
                held = row
            yield frame(done)
        if first is not None:
            own = Parse().feed(_utf8(held[1])).signature()
            done = [whole_row(waiting.pop(), own)] if waiting else []
            yield frame(done, [("first", part, *first), ("last", part, *held)])

    def half(row, following):
        n, digest, own, edited = compare(row[1], following)
        return row[0], n, digest, own, edited

    def whole_row(made, next_own):
        doc_id, n, digest, own, edited = made
        return (
            doc_id, n, digest, fingerprint(own), fingerprint(edited),
            likeness(own, edited), likeness(own, next_own),
        )

    names = [c.split()[0] for c in RESULT.split(", ")]

    def frame(done, edges=()):
        out = [(*r, None, None, None) for r in done]
        out += [(doc_id, *[None] * 6, kind, part, text) for kind, part, doc_id, text in edges]
        out = pd.DataFrame(out, columns=[*names, "kind", "part", "text"])
        return out.astype({"doc_id": "Int64", "n_chars": "Int64", "part": "Int64"})

    done = stored(rows.mapInPandas(run, f"{RESULT}, kind string, part bigint, text string"), "prints")
    edges = done.where("kind is not null").select("kind", "part", "doc_id", "text")
    by_part = Window.orderBy("part")
    turn = edges.where("kind = 'first'").select("part")  # one small row per partition
    turn = turn.withColumn(
        "next_part",
        F.coalesce(
            F.lead("part").over(by_part),
            F.first("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ),
    )
    following = edges.where("kind = 'first'").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text")
    )
    met = edges.where("kind = 'last'").join(turn, "part").join(following, "next_part")

    def meet(batches):
        for batch in batches:
            pairs = zip(batch["doc_id"], batch["text"], batch["next_text"])
            out = [
                whole_row(
                    half((None if pd.isna(i) else int(i), t), n), Parse().feed(_utf8(n)).signature()
                )
                for i, t, n in pairs
            ]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "n_chars": "Int64"})

    last = met.select("doc_id", "text", "next_text").mapInPandas(meet, RESULT)
    return done.where("kind is null").select(*names).unionByName(last)
