"""Conversation repair against a literal version: faults, cheapest edits, repaired texts."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import alignment, queries, repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(turns):
    """(cost, audit) over the states of the grammar; turns are (initial, must go, truncated)."""

    @lru_cache(None)
    def go(i, state, inserted):
        ways = [(0, "")] if i == len(turns) and state in ("", "a") else []
        step = lambda cost, letter, rest: ways.append((cost + rest[0], letter + rest[1])) if rest else None
        for role in "ua":
            if inserted < 3 and (state, role) in NEXT:
                step(3, "I", go(i, NEXT[state, role], inserted + 1))
        if i < len(turns):
            initial, gone, cut = turns[i]
            step(4, "D", go(i + 1, state, 0))
            for role in "sua" if not gone else "":
                if (state, role) in NEXT and role == initial:
                    step(3 * cut, "K", go(i + 1, NEXT[state, role], 0))
                elif (state, role) in NEXT and role != "s":
                    step(3 + 3 * cut, "R", go(i + 1, NEXT[state, role], 0))
        return min(ways) if ways else None

    for i in range(len(turns), 0, -1):  # from the end on, so that the recursion stays flat
        for state in ("", "s", "u", "a"):
            go(i, state, 0)
    return go(0, "", 0)


def brute(rows):
    """The contract, literally, for all conversations of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        numbers = {r[0] for r in kept} - {None}
        counts, seen, turns = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in kept:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        pairs = [a[0] + b[0] for a, b in zip(turns, turns[1:])]
        cost, audit = cheapest(tuple(turns))
        lines, state, i = [], "", 0
        for edit in audit:
            wanted = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[wanted]
            if edit == "I":
                lines.append(f"{name}:")
                state = wanted
                continue
            role, text = kept[i][1:]
            i += 1
            if edit == "K":
                lines.append(f"{role}:{text}")
                state = role[0]
            elif edit == "R":
                lines.append(f"{name}:{text}")
                state = wanted
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *counts.values(),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_query(spark, small_dir):
    rows = [tuple(r.values()) for r in pq.read_table(f"{small_dir}/conversations.parquet").to_pylist()]
    df = queries.QUERIES["op12_conversation_repair"](spark, small_dir)
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert got(df) == brute(rows)


def test_hard_rows(spark, tmp_path):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Yes.", "no", "", " \n ", None, "Why? \t", "a.b", "é!", "line\nline.", "x" * 3000, "."]
    rows = []
    for conv in [*range(150), None]:
        for _ in range(rng.randint(1, 16)):
            turn = rng.choice([None, *range(20)])
            weights = [8, 8, 2, 1, 1, 1, 1]
            rows.append((conv, turn, rng.choices(roles, weights)[0], rng.choice(texts)))
    long_one = [(-7, i, "ua"[i % 2].replace("u", "user").replace("a", "assistant"), f"t{i}.") for i in range(700)]
    rows += long_one + [(-8, 3, "user", "Same.")] * 40 + [(2**62 + 1, -(2**40), "user", "Hi."), (2**62 + 1, 2**40, "user", "Yo.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("x")).withColumn("code", F.lit(1))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = got(queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)))
    wanted = brute(rows)
    assert {k: (found[k], v) for k, v in wanted.items() if found.get(k) != v} == {}
    assert len(found) == len(wanted)


def test_empty(spark, empty_dir):
    assert queries.QUERIES["op12_conversation_repair"](spark, empty_dir).collect() == []


@pytest.mark.parametrize("letters", ["suaoSUAOx", "uuuaS", "sSxa", "UAx"])
def test_alignment(letters):
    rng = random.Random(len(letters))
    for _ in range(600):
        codes = "".join(rng.choice(letters) for _ in range(rng.randint(0, 13)))
        turns = tuple((c.lower(), c == "x", c.isupper()) for c in codes)
        assert alignment.align(codes) == cheapest(turns), codes


def test_alignment_of_a_long_conversation():
    """Cells are computed again from every step-th turn: nothing depends on where these lie."""
    rng = random.Random(3)
    codes = "".join("ua"[i % 2] if rng.random() < 0.9 else rng.choice("suaoUAx") for i in range(300))
    turns = tuple((c.lower(), c == "x", c.isupper()) for c in codes)
    assert alignment.align(codes) == cheapest(turns)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (1, 3, "tool", "Go.")]
    marked = repair.mark_faults(spark.createDataFrame(rows, SCHEMA))
    turns = repair.repaired_turns(marked, repair.align_conversations(marked)).orderBy("conv", "place", "step")
    assert [(r["role"], r["text"]) for r in turns.collect()] == [
        ("system", "Be kind."), ("user", "Hi."), ("assistant", "Go."),
    ]
    # without damage every row is a turn of the report
    report = repair.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert (report["audit"], report["cost"], report["duplicate"]) == ("KRDR", 10, 1)
