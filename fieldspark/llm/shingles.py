"""Word shingle sets of many texts at once, as 64-bit hashes (numpy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

SEPARATORS = b" \t\n\x0b\x0c\r"
# A chunk takes some 50 bytes of memory for each of its own.
CHUNK_BYTES = 1 << 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SEPARATORS)] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, CHUNK_BYTES + 2)  # a chunk, its last separator and the end
        _powers[:] = [
            np.cumprod(np.array([1] + [b] * (size - 1), dtype=np.uint64), dtype=np.uint64)
            for b in (_BASE, _BASE_INVERSE)
        ]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    start, size, part = 0, 0, []
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if part and size + len(data) > CHUNK_BYTES:
            yield start, part
            start, size, part = i, 0, []
        part.append(data)
        size += len(data) + 1
    if part:
        yield start, part


def word_hashes(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z folded) of the texts, and where each text's words begin."""
    raw = _FOLD[np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)]
    space = _IS_SPACE[raw]
    before = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    hashes = (total[ends] - total[starts]) * inverse[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    lengths = np.fromiter((len(x) + 1 for x in part), dtype=np.int64, count=len(part))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has its whole word sequence as its one shingle; a text without words,
    or None, has the empty set.
    """
    for hashes, _ in ranked_shingle_sets(texts, width, None):
        yield hashes


def ranked_shingle_sets(
    texts: list, width: int, word_level: Callable[[np.ndarray], np.ndarray] | None
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The sets of ``shingle_sets`` with the sum of the levels of each shingle's words."""
    for _, part in _chunks(texts):
        words, bounds = word_hashes(part)
        rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            rolled = mix(rolled * np.uint64(0xFF51AFD7ED558CCD) + words[k : k + len(rolled)])
        level = None
        if word_level is not None:
            total = np.concatenate(([0], np.cumsum(word_level(words), dtype=np.int64)))
            level = total[width:] - total[:-width] if len(words) >= width else total[:0]
        for i in range(len(part)):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= width:
                own = rolled[lo : hi - width + 1]
                if level is None:
                    yield np.unique(own), None
                else:
                    hashes, first = np.unique(own, return_index=True)
                    yield hashes, level[lo + first]
            elif hi > lo:
                short = np.zeros(1, dtype=np.uint64) + np.uint64(hi - lo)
                for k in range(lo, hi):
                    short = mix(short * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + 1])
                yield short, np.zeros(1, dtype=np.int64)
            else:
                yield np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key that equal sets share."""
    total = np.add.reduce(mix(hashes + np.uint64(len(hashes)))) if len(hashes) else np.uint64(0)
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])
