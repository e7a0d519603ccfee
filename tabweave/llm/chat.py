"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Conversations are cut in blocks of turns, so a very long one is many rows. A block's effect on the machine is a vector, the
state it ends in for each state it may begin in; vectors compose, so the state before each block follows from blocks
of blocks, and no task needs a whole conversation. Segments are rows: conversation, turn number, part, text, loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import small_batches
from tabweave.operators.folds import numbered
from tabweave.session import materialize

BLOCK_TURNS = 256
LEVELS = 3


@dataclass(frozen=True)
class Part:
    """A piece of a turn: fixed text, or the turn's role or text (escaped); ``loss`` says if training learns it."""

    text: str = ""
    field: str = ""
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Parts for each role (``""`` for any other), and the machine: state -> role -> state.

    ``start`` is the first state, ``final`` those in which a conversation may end. A role without a transition breaks the
    conversation's order. ``controls`` are strings that a text must not show: in it, ``escape`` doubles itself and splits
    them. Their first two characters are the same for all. ``reads`` finds role and text (escaped) in a formatted turn.
    """

    parts: dict[str, tuple[Part, ...]]
    moves: dict[str, dict[str, str]]
    start: str
    final: tuple[str, ...]
    controls: tuple[str, ...]
    reads: str
    escape: str = "\\"

    @property
    def opener(self) -> str:
        return self.controls[0][:2]


def _turn(loss: bool) -> tuple[Part, ...]:
    return (Part("<|im_start|>"), Part(field="role"), Part("\n"), Part(field="text", loss=loss), Part("<|im_end|>\n"))


CHATML = ChatTemplate(
    parts={"assistant": _turn(True), "": _turn(False)},
    moves={
        "begin": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    start="begin",
    final=("answered",),
    controls=("<|im_start|>", "<|im_end|>"),
    reads=r"(?s)<\|im_start\|>(?P<role>(?:[^\\\n]|\\.)*)\n(?P<text>.*)<\|im_end\|>\n",
)


def escaped(text: Column, template: ChatTemplate) -> Column:
    """A text in which no control string occurs. The escape character is doubled and put inside each opener."""
    e, o = template.escape, template.opener
    return F.replace(F.replace(text, F.lit(e), F.lit(e + e)), F.lit(o), F.lit(o[0] + e + o[1]))


def escaped_role(role: Column, template: ChatTemplate) -> Column:
    """A role is one line: the escape character also stands before each line end in it."""
    return F.replace(escaped(role, template), F.lit("\n"), F.lit(template.escape + "\n"))


def unescape(text: str, template: ChatTemplate) -> str:
    """What was escaped: an escape character goes, the one after it stays."""
    return re.sub(rf"(?s){re.escape(template.escape)}(.)", r"\1", text)


def _machine(template: ChatTemplate) -> tuple[list[str], list[str], list[int]]:
    """States (the last is broken), roles (the last is any other) and next states, row by row."""
    states = sorted({template.start, *template.moves, *(s for m in template.moves.values() for s in m.values())})
    roles = sorted({r for m in template.moves.values() for r in m})
    broken = len(states)
    table = [states.index(template.moves[s][r]) if r in template.moves.get(s, {}) else broken for s in states for r in roles]
    wide = []
    for k in range(len(states)):
        wide += table[k * len(roles) : (k + 1) * len(roles)] + [broken]
    return [*states, ""], [*roles, ""], wide + [broken] * (len(roles) + 1)


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def format_chats(turns: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """One row for each part of each turn: conv_id, block, place (of the turn in its block), part, text, loss, valid.

    Reads conv_id, turn, role and text. Turns go by number; ties go by role and text, null turns come last. A null text or role
    is empty. Every conversation is formatted; ``valid`` is whether the machine has a state after this turn. A null conv_id is
    a conversation of its own. Rows that repeat a turn are turns. Other columns are ignored.
    """
    states, roles, moves = _machine(template)
    width, count = len(roles), len(states)
    table = _numbers(moves)
    turn = F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1))
    code = F.array_position(F.array(*[F.lit(r) for r in roles[:-1]]), F.col("role"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("code", F.when(code > 0, code - 1).otherwise(width - 1).cast("int"))
    # blocks go by the number of the row in its conversation, so even equal turn numbers fill blocks of equal size
    rows = numbered(rows.withColumn("order", F.struct("conv_id", "turn", "role", "text")), "order", by="conv_id")
    block = F.floor((F.col("__row") - 1) / F.lit(BLOCK_TURNS).cast("long"))
    order = F.array_sort(F.collect_list(F.struct("__row", "role", "text", "code")))
    blocks = rows.groupBy("conv_id", block.alias("block")).agg(order.alias("turns"))

    def after(state: Column, code: Column) -> Column:
        return F.get(table, state * width + code)

    effect = F.transform(_numbers(list(range(count))), lambda s: F.aggregate("turns", s, lambda a, t: after(a, t["code"])))
    blocks = materialize(blocks.withColumn("effect", effect), "chat-blocks")
    entered = materialize(_entered(blocks.select("conv_id", "block", "effect"), states.index(template.start), LEVELS), "chat-entered")
    same = blocks["conv_id"].eqNullSafe(entered["e_conv"]) & (blocks["block"] == entered["e_block"])
    joined = blocks.join(entered, same).select("conv_id", "block", "turns", "state")
    empty = F.array().cast("array<int>")
    seen = F.aggregate("turns", F.struct(F.col("state").alias("s"), empty.alias("all")), lambda a, t: _step(a, after(a["s"], t["code"])))["all"]
    each = joined.select("conv_id", "block", F.posexplode(F.arrays_zip("turns", seen.alias("states"))).alias("place", "t"))
    each = each.select("conv_id", "block", "place", "t.turns.*", (F.col("t.states") != count - 1).alias("valid"))
    parts = None
    for role, spec in sorted(template.parts.items(), reverse=True):
        made = F.array(*[_part(p, template) for p in spec])
        parts = F.when(F.col("role") == role, made) if parts is None else parts.when(F.col("role") == role, made)
        if role == "":
            parts = made if parts is None else parts.otherwise(made)
    segments = each.select("conv_id", "block", "place", "valid", F.posexplode(parts).alias("part", "p"))
    return segments.select("conv_id", "block", "place", "part", "p.text", "p.loss", "valid")


def _step(a: Column, state: Column) -> Column:
    return F.struct(state.alias("s"), F.concat(a["all"], F.array(state)).alias("all"))


def _part(part: Part, template: ChatTemplate) -> Column:
    made = {"": F.lit(part.text), "role": escaped_role(F.col("role"), template), "text": escaped(F.col("text"), template)}
    return F.struct(made[part.field].alias("text"), F.lit(part.loss).alias("loss"))


def _entered(blocks: DataFrame, start: int, levels: int) -> DataFrame:
    """e_conv, e_block, state before each block, from the blocks' effects; ``levels`` times a group of blocks is one block."""
    group = F.floor(F.col("block") / F.lit(BLOCK_TURNS).cast("long"))
    items = F.array_sort(F.collect_list(F.struct("block", "effect")))

    def through(rows: Column, state: Column) -> Column:
        return F.aggregate(rows, state, lambda s, b: F.get(b["effect"], s))

    def before(rows: Column, state: Column) -> Column:
        begin = F.struct(state.alias("s"), F.array().cast("array<struct<block:bigint,state:int>>").alias("all"))
        return F.aggregate(
            rows, begin, lambda a, b: F.struct(F.get(b["effect"], a["s"]).alias("s"), F.concat(a["all"], F.array(F.struct(b["block"].alias("block"), a["s"].alias("state")))).alias("all"))
        )["all"]

    if levels == 0:
        whole = blocks.groupBy("conv_id").agg(items.alias("rows")).withColumn("state", F.lit(start))
    else:
        grouped = materialize(blocks.groupBy("conv_id", group.alias("upper")).agg(items.alias("rows")), "chat-groups")
        effect = F.transform(F.sequence(F.lit(0), F.size(F.col("rows")[0]["effect"]) - 1), lambda s: through(F.col("rows"), s))
        above = _entered(grouped.select("conv_id", F.col("upper").alias("block"), effect.alias("effect")), start, levels - 1)
        same = grouped["conv_id"].eqNullSafe(above["e_conv"]) & (grouped["upper"] == above["e_block"])
        whole = grouped.join(above, same).select("conv_id", "rows", "state")
    found = whole.select("conv_id", F.explode(before(F.col("rows"), F.col("state"))).alias("b"))
    return found.select(F.col("conv_id").alias("e_conv"), F.col("b.block").alias("e_block"), F.col("b.state").alias("state"))


def chat_digests(segments: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Per conversation, read back from formatted text and loss flags: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid (the order is one that the machine takes, to the end of each turn).

    A turn's parts are joined and parsed, so a text that looks like a control string would show here. Digests run over the
    text in order: the rows of a conversation pass through one task, sorted, a turn at a time; a long one takes time
    there, not memory.
    """
    small_batches(segments.sparkSession)
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
    )
    names = ("conv_id", "block", "place", "text", "loss", "valid")
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place", "part").select(*names)
    reads = re.compile(template.reads)

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        one, turn, key = None, [], None
        for part in parts:
            for conv, block, place, text, loss, ok in zip(*[part.column(x).to_pylist() for x in names], strict=True):
                if key != (conv, block, place):
                    if turn:
                        one.add("".join(turn))
                    turn, key = [], (conv, block, place)
                    if one is None or one.conv != conv:
                        if one is not None:
                            done.append(one.row())
                        one = _Read(conv, reads, template)
                turn.append(text)
                one.valid &= ok
                if loss:
                    one.learn(text)
            if len(done) >= 1000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if one is not None:
            one.add("".join(turn))
            done.append(one.row())
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return rows.mapInArrow(digest, kinds)


class _Read:
    """Running digests of one conversation."""

    def __init__(self, conv: int | None, reads: re.Pattern, template: ChatTemplate):
        self.conv, self._reads, self._template, self.valid = conv, reads, template, True
        self._turns = self._chars = self._loss_chars = 0
        self._all, self._loss = hashlib.sha256(), hashlib.sha256()

    def add(self, turn: str) -> None:
        found = self._reads.fullmatch(turn)
        if not found:
            raise ValueError("a formatted turn can't be read back")
        role, text = (unescape(found[x], self._template) for x in ("role", "text"))
        self._all.update(f"{role}\n{text}\n".encode())
        self._turns += 1
        self._chars += len(turn)

    def learn(self, text: str) -> None:
        text = unescape(text, self._template)
        self._loss.update(text.encode())
        self._loss_chars += len(text)

    def row(self) -> tuple:
        return self.conv, self._turns, self._all.hexdigest(), self._loss_chars, self._loss.hexdigest(), self._chars, self.valid
