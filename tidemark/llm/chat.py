"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Rendering successive
prefixes and comparing consecutive outputs gives each turn's span; an output that doesn't begin with
the one before shows a template that rewrites history. Two probe texts show where a turn's own text
begins inside its span, an empty one how long it is. ``format_chats`` renders every prefix, of any template.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Turns = list[tuple[str, str]]
SPANS = "array<struct<role:string,start:long,end:long,text_start:long,text_end:long,loss:boolean>>"
EXTRA = r"\### Assistant: </turn> ok"


class MarkedTurns:
    """``### Role: text </turn>`` and a line feed per turn. A backslash before \\, # and < (and : in roles) keeps control
    strings out of roles and texts, reversibly. What the leading turns of the last call gave is kept for the next one."""

    known: tuple[Turns, str] = ([], "")
    TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.S)

    @staticmethod
    def escape(text: str) -> str:
        return re.sub(r"[\\#<]", r"\\\g<0>", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def added(self, before: Turns, turn: tuple[str, str]) -> str:
        return f"### {self.escape(turn[0]).replace(':', chr(92) + ':')}: {self.escape(turn[1])} </turn>\n"

    def __call__(self, turns: Turns) -> str:
        head, said = self.known
        if turns[: len(head)] != head:
            head, said = [], ""
        upto = max(len(head), len(turns) - 1)
        if upto > len(head):
            said += "".join([self.added([], turn) for turn in turns[len(head) : upto]])
            self.known = turns[:upto], said
        return said + "".join([self.added([], turn) for turn in turns[upto:]])

    def parse(self, formatted: str) -> Turns:
        out, at = [], 0
        while at < len(formatted):
            m = self.TURN.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn at {at}")
            out.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return out


def common_prefix(a: str, b: str, known: int = 0) -> int:
    """Length of what both begin with, at least ``known``: halved until it fits, so compared at the speed of slices."""
    low, high = known, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def located_by_tails(render: Callable[[Turns], str], turns: Turns) -> tuple[str, list[tuple[int, int, int, int]]] | None:
    """Output and spans, from the tails that ``render.added`` promises; None if a rendered prefix belies them.

    Prefixes of 1, 2, 4, 8, ... turns and the whole are rendered and compared, so all renders together are about twice
    the whole one and the work is linear in the conversation.
    """
    before: Turns = []
    parts = [render(before)]
    out, at, check = [], len(parts[0]), 1
    for role, text in turns:
        now, a, b, empty = (render.added(before, (role, t)) for t in (text, "A", "B", ""))
        inner = at + common_prefix(a, b)
        out.append((at, at + len(now), inner, inner + len(now) - len(empty)))
        at += len(now)
        parts.append(now)
        before.append((role, text))
        if len(before) in (check, len(turns)):
            parts = ["".join(parts)]
            if render(before) != parts[0]:
                return None
            check *= 2
    return "".join(parts), out


def located_by_prefixes(render: Callable[[Turns], str], turns: Turns) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(whole output, span of each turn and of its text, rewritten?). Spans are (start, end, text start, text end).

    The template is a black box: every prefix is rendered and compared with the one before, and the last turn of each
    is rendered with probe texts, so the work grows with the square of the number of turns.
    """
    out, rewritten = [], False
    before = render([])
    for i, (role, _) in enumerate(turns):
        head = turns[:i]
        now = render(turns[: i + 1])
        start = len(before) if now.startswith(before) else common_prefix(before, now)
        rewritten |= start < len(before)
        a, b = render([*head, (role, "A")]), render([*head, (role, "B")])
        inner = common_prefix(a, b, start if a.startswith(before) and b.startswith(before) else 0)
        length = len(now) - len(render([*head, (role, "")]))
        out.append((start, len(now), inner, inner + length))
        before = now
    return before, out, rewritten


def locate(render: Callable[[Turns], str], turns: Turns) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """What ``located_by_prefixes`` finds, in linear time for templates that are trusted; for direct calls, ``format_chats`` doesn't use it.

    A template that only appends can say so by a method ``added(turns before, turn)``, the text that a turn adds. That is
    checked at few prefixes only: a template that rewrites and takes it back between them is not found out. Of a template
    without it, and of one whose promise fails, every prefix is rendered.
    """
    found = located_by_tails(render, turns) if hasattr(render, "added") else None
    return located_by_prefixes(render, turns) if found is None else (*found, False)


def format_chats(
    turns: DataFrame, render: Callable[[Turns], str] | None = None, loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """(conv_id, formatted, spans, rewritten), one row per conversation.

    Turns come in the order of turn, role and text, nulls first; null texts and roles count as empty;
    repeated rows are turns of their own; null conv_ids are one conversation. Rows reach a task sorted
    and are formatted one conversation at a time: a task holds one conversation, never a partition. Spans come from
    rendering every prefix, whatever the template.
    """
    render = render or MarkedTurns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size = 0

        def finish(conv, held: Turns) -> None:
            nonlocal size
            whole, spans, rewritten = located_by_prefixes(render, held)
            listed = [
                {"role": r, "start": a, "end": b, "text_start": c, "text_end": d, "loss": r in loss_roles} for (r, _), (a, b, c, d) in zip(held, spans)
            ]
            done.append((conv, whole, listed, rewritten))
            size += len(whole)

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), spans_type, pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["conv_id", "formatted", "spans", "rewritten"]
            )

        spans_type = pa.list_(
            pa.struct([("role", pa.string()), *[(c, pa.int64()) for c in ("start", "end", "text_start", "text_end")], ("loss", pa.bool_())])
        )
        conv, held, any_row = None, [], False
        for batch in batches:
            for c, role, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if any_row and c != conv:
                    finish(conv, held)
                    held = []
                    if size > 4_000_000:
                        yield flush()
                        done, size = [], 0
                conv, any_row = c, True
                held.append((role, text))
        if any_row:
            finish(conv, held)
            yield flush()

    source = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn"
    )
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id long, formatted string, spans {SPANS}, rewritten boolean")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations and their spans."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], "conv_id long, turn long, role string, text string")
    template = MarkedTurns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, formatted, spans in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                parsed = template.parse(formatted)
                said = "".join(f"{r}\n{t}\n" for r, t in parsed)
                loss = "".join(template.unescape(formatted[s["text_start"] : s["text_end"]]) for s in spans if s["loss"])
                rows.append((conv, len(parsed), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    formatted = format_chats(turns.union(extra), template)
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def registered() -> dict:
    return {"op7_chat_format": op7_chat_format}
