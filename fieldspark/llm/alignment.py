"""Alignment of one conversation's turns with the alternating grammar (numpy, inside Spark tasks).

A conversation is a string of turn codes: its role's initial ``s``, ``u``, ``a`` or ``o`` (any other role), in
capitals where the turn is truncated, and ``x`` for a turn that has to go. The target is one of the strings
``(ua)^k`` and ``s(ua)^k``, k at least 1, or the empty one.

Wagner-Fischer cells hold the least cost of the turns from i on against the last j letters of a target. All
targets end alike, so one table of ends serves every feasible length; a second one holds the targets whose
``s`` is still to come. Costs are counted above what no edit avoids (4 a turn that has to go, 3 a truncated
turn), which leaves 1 for deleting a truncated turn. A cell is in the band of a bound t if the insertions or
deletions that its lengths force cost no more than t. The bound is doubled until a cost within it is found:
then every cheapest alignment lies in the band (Ukkonen).
"""

from __future__ import annotations

import math

import numpy as np

# The costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
FAR = 1 << 40


def _deletion(code: str) -> int:
    return 0 if code == "x" else DELETE - TRUNCATED if code.isupper() else DELETE


class _Table:
    """Banded cells of one code string, kept at every ``step``-th turn and computed again in between."""

    def __init__(self, codes: str, bound: int):
        self.codes, self.n = codes, len(codes)
        weak = np.array([c.isupper() for c in codes] + [False], dtype=np.int64)
        left = np.array([c != "x" for c in codes] + [False], dtype=np.int64)
        # turns, and truncated turns, from i on
        turns, weak = np.cumsum(left[::-1])[::-1], np.cumsum(weak[::-1])[::-1]
        cheap = DELETE - TRUNCATED
        spare = np.where(weak * cheap > bound, bound // cheap, weak + (bound - weak * cheap) // DELETE)
        # one turn more may be left where it is to match the s
        self.low = np.maximum(turns - spare - 1, 0)
        self.high = turns + bound // INSERT
        self.step = max(16, math.isqrt(self.n) + 1)
        self.marks = {self.n: self._last()}
        self.block: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        row = self.marks[self.n]
        for i in range(self.n - 1, -1, -1):
            row = self._row(i, row)
            if i % self.step == 0:
                self.marks[i] = row

    def _last(self) -> tuple[np.ndarray, np.ndarray]:
        places = np.arange(self.low[self.n], self.high[self.n] + 1)
        return INSERT * places, np.full(len(places), FAR)

    def _slice(self, cells: np.ndarray, i: int, first: int, last: int) -> np.ndarray:
        """Cells ``first`` to ``last`` of turn i, far where they are outside its band."""
        out = np.full(last - first + 1, FAR)
        a, b = max(first, self.low[i]), min(last, self.high[i])
        if a <= b:
            out[a - first : b - first + 1] = cells[a - self.low[i] : b - self.low[i] + 1]
        return out

    def _row(self, i: int, after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(cells of the ends, cells of targets with ``s`` still to come) of turn i from those of i + 1."""
        low, high, code = self.low[i], self.high[i], self.codes[i]
        places = np.arange(low, high + 1)
        deleted = _deletion(code)
        best = self._slice(after[0], i + 1, low, high) + deleted
        opening = self._slice(after[1], i + 1, low, high) + deleted
        if code != "x":
            match = self._slice(after[0], i + 1, low - 1, high - 1)
            letter = np.where(places % 2 == 0, "u", "a")
            best = np.minimum(best, match + np.where(letter == code.lower(), 0, REROLE))
        best = np.minimum.accumulate(best - INSERT * places) + INSERT * places
        if code in "sS":
            whole = (places % 2 == 0) & (places > 0)
            opening = np.where(whole, np.minimum(opening, self._slice(after[0], i + 1, low, high)), FAR)
        return np.minimum(best, FAR), np.minimum(opening, FAR)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in self.marks:
            return self.marks[i]
        if i not in self.block:
            end = min(self.n, (i // self.step + 1) * self.step)
            self.block, row = {}, self.marks[end]
            for k in range(end - 1, i - 1, -1):
                row = self.block[k] = self._row(k, row)
        return self.block[i]

    def at(self, i: int, places: np.ndarray, opening: bool = False) -> np.ndarray:
        cells = self.row(i)[1 if opening else 0]
        inside = (places >= self.low[i]) & (places <= self.high[i])
        out = np.full(len(places), FAR)
        out[inside] = cells[places[inside] - self.low[i]]
        return out

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of the part after ``s``, and the cost of each target without and with ``s``."""
        places = np.arange(self.low[0], self.high[0] + 1)
        plain, opening = self.row(0)
        return places, np.where(places % 2 == 0, plain, FAR), opening


def _backtrace(table: _Table, plain: np.ndarray, opening: np.ndarray) -> str:
    """The ASCII-least audit over all cheapest alignments with the targets of these lengths.

    All targets are traced side by side: of the edits that some cheapest alignment goes on with, the
    least is taken, and alignments without it fall out.
    """
    audit, i = [], 0
    while i < table.n or (not (plain == 0).any()):
        here = table.at(i, plain)
        if i == table.n:
            audit.append("I")
            plain = plain[here == INSERT + table.at(i, plain - 1)] - 1
            continue
        code, deleted = table.codes[i], _deletion(table.codes[i])
        gone = plain[here == deleted + table.at(i + 1, plain)]
        waits = table.at(i, opening, True)
        waiting = opening[waits == deleted + table.at(i + 1, opening, True)]
        if len(gone) or len(waiting):
            audit.append("D")
            plain, opening, i = gone, waiting, i + 1
            continue
        filled = plain[here == INSERT + table.at(i, plain - 1)]
        if len(filled):
            audit.append("I")
            plain, opening = filled - 1, opening[:0]
            continue
        matched = table.at(i + 1, plain - 1)
        same = np.where(plain % 2 == 0, "u", "a") == code.lower()
        kept = plain[same & (here == matched)] - 1
        if code in "sS":
            kept = np.union1d(kept, opening[waits == table.at(i + 1, opening)])
        audit.append("K" if len(kept) else "R")
        plain = kept if len(kept) else plain[~same & (here == REROLE + matched)] - 1
        opening, i = opening[:0], i + 1
    return "".join(audit)


def align(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that give a legal conversation; ties by the least audit."""
    sunk = DELETE * codes.count("x") + TRUNCATED * sum(c.isupper() for c in codes)
    bound = 4
    while True:
        table = _Table(codes, bound)
        places, plain, opening = table.totals()
        best = min(plain.min(initial=FAR), opening.min(initial=FAR))
        if best <= bound:
            audit = _backtrace(table, places[plain == best], places[opening == best])
            return sunk + int(best), audit
        # a cost found outside the bound is an incumbent: no band needs to be wider than it asks for
        bound = min(2 * bound, int(best))


def edits(codes: str, audit: str) -> list[str]:
    """What each turn turns into, and last what follows them all.

    ``U`` and ``A`` are inserted turns; ``k`` is the turn itself, ``u`` and ``a`` the turn in another role;
    nothing is left of a deleted turn.
    """
    out, here, expected, i = [], "", "u", 0
    for edit in audit:
        if edit == "I":
            here += expected.upper()
        elif edit == "R":
            here += expected
        elif edit == "K":
            here += "k"
        if edit in "IR" or (edit == "K" and codes[i] not in "sS"):
            expected = "a" if expected == "u" else "u"
        if edit != "I":
            out.append(here)
            here, i = "", i + 1
    return [*out, here]
