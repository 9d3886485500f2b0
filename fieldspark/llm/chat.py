"""Chat formatting with Spark expressions: turns to one training text with a loss mask, and back.

A block holds the adjacent turns of one role: ``<|im_start|>role``, a line feed, the texts with
``<|im_sep|>`` between them, ``<|im_end|>`` and a line feed. Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, so that no text can hold a control string and the original can be read back;
in a role a line feed becomes ``\\n``. The loss mask is the list of (start, length) in code points of
the assistant texts. Turns are merged by aggregates over the sorted array of a conversation's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import let

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# Turns that one aggregate step list copies; longer conversations are merged in such chunks.
CHUNK = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    """A line feed's ``\\n`` has an odd backslash; doubled ones are hidden while it is put back."""
    hidden = F.replace(role, F.lit("\\\\"), F.lit("<|\\|"))
    shown = F.replace(hidden, F.lit("\\n"), F.lit("\n"))
    return unescape(F.replace(shown, F.lit("<|\\|"), F.lit("\\\\")))


def _chunks(values: Column) -> Column:
    """A filled array as arrays of at most ``CHUNK`` elements; ``values`` is a lambda's variable."""
    last = F.floor((F.size(values) - 1) / F.lit(CHUNK)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))


def _joined(done: Column, more: Column) -> Column:
    """Two lists of blocks as one; where they meet in one role, the texts become one block."""
    last, first = F.try_element_at(done, F.lit(-1)), F.element_at(more, 1)
    both = F.struct(first["role"].alias("role"), F.concat(last["texts"], first["texts"]).alias("texts"))
    return F.when(
        last["role"] == first["role"],
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both), F.slice(more, F.lit(2), F.size(more))),
    ).otherwise(F.concat(done, more))


def merge_turns(turns: Column) -> Column:
    """Blocks (role, texts) of a sorted array of turn structs: a turn opens a block or joins the last.

    An aggregate copies what it has so far at every step, so chunks of the array are merged first
    and their block lists after that.
    """
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def block(turn: Column) -> Column:
        return F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))

    def merged(chunk: Column) -> Column:
        return F.aggregate(chunk, none, lambda done, turn: _joined(done, block(turn)))

    return let(turns, lambda t: F.aggregate(F.transform(_chunks(t), merged), none, _joined))


def _starts(lengths: Column) -> Column:
    """Where each of the lengths begins if all are laid end to end."""

    def sums(values: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("starts"))
        return F.aggregate(
            values,
            zero,
            lambda a, n: F.struct(
                (a["total"] + n).alias("total"), F.concat(a["starts"], F.array(a["total"])).alias("starts")
            ),
        )

    def moved(parts: Column) -> Column:
        offsets = sums(F.transform(parts, lambda p: p["total"]))["starts"]
        return let(
            offsets,
            lambda o: F.flatten(F.transform(parts, lambda p, i: F.transform(p["starts"], lambda s: s + F.get(o, i)))),
        )

    return let(F.transform(_chunks(lengths), sums), moved)


def _render(blocks: Column, loss_role: str) -> Column:
    """(formatted, loss) of a conversation's blocks."""

    def pieces(block: Column) -> Column:
        opening = F.concat(F.lit(START), _escape_role(block["role"]), F.lit("\n"))
        return F.transform(
            block["texts"],
            lambda text, i: F.struct(
                block["role"].alias("role"),
                F.when(i == 0, opening).otherwise(SEPARATOR).alias("head"),
                escape(text).alias("body"),
                F.when(i == F.size(block["texts"]) - 1, END).otherwise("").alias("tail"),
            ),
        )

    size = lambda c: F.length(c).cast("bigint")

    def written(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: size(p["head"]) + size(p["body"]) + size(p["tail"]))
        spans = lambda starts: F.transform(
            parts,
            lambda p, i: F.struct(
                p["role"].alias("role"), (F.get(starts, i) + size(p["head"])).alias("start"), size(p["body"]).alias("length")
            ),
        )
        loss = F.filter(let(let(lengths, _starts), spans), lambda s: s["role"] == loss_role)
        return F.struct(
            F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
            F.transform(loss, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
        )

    return let(F.flatten(F.transform(blocks, pieces)), written)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) per conversation of ``turns(conv_id, turn, role, text)``.

    Turns are ordered by turn (nulls first), then role and text. A null role or text counts as empty; rows with a
    null conv_id form one conversation; repeated rows are turns of their own. An empty table gives
    an empty result. Other columns are not looked at.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct("turn", blank("role").alias("role"), blank("text").alias("text"))
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    merged = collected.select("conv_id", merge_turns(F.col("_turns")).alias("_blocks"))
    rendered = merged.select("conv_id", _render(F.col("_blocks"), loss_role).alias("_chat"))
    return rendered.select("conv_id", "_chat.formatted", "_chat.loss")


def parse_turns(formatted: Column) -> Column:
    """The (role, text) turns that a formatted conversation was made from."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(START) + 1), F.length(block))
        cut = F.instr(inner, F.lit("\n"))
        role = F.substring(inner, F.lit(1), cut - 1)
        texts = F.split(F.substring(inner, cut + 1, F.length(inner)), r"<\|im_sep\|>", -1)
        return F.transform(
            texts, lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped; the text is cut into characters once, so long ones are linear."""
    return let(
        F.split(formatted, ""),
        lambda characters: F.array_join(
            F.transform(
                loss,
                lambda s: unescape(
                    F.array_join(F.slice(characters, (s["start"] + 1).cast("int"), s["length"].cast("int")), "")
                ),
            ),
            "",
        ),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back from the formatted conversations."""
    read = formatted.select(
        "conv_id",
        parse_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss")).alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    flat = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
