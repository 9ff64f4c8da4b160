"""Chat formatting by rendering successive prefixes of a conversation through a black-box template."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SENTINEL = ""

Messages = list[tuple[str, str]]


def escape(text: str) -> str:
    """Reversible: no control string can be read inside the result."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.DOTALL)


def marked_turns(messages: Messages) -> str:
    """The default template. A line break in a role is written as \\n, so that a role ends at its line's end."""
    out = []
    for role, text in messages:
        head = escape(role).replace("\n", "\\n")
        out.append(f"{OPEN}{head}\n{escape(text)}{CLOSE}\n")
    return "".join(out)


def parse_turns(formatted: str) -> Messages:
    """The messages that marked_turns() was given."""
    out, at = [], 0
    while at < len(formatted):
        end = formatted.index(CLOSE, at)
        head, _, body = formatted[at + len(OPEN) : end].partition("\n")
        out.append((re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head), unescape(body)))
        at = end + len(CLOSE) + 1
    return out


def locate(render: Callable[[Messages], str], messages: Messages) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """Renders each prefix and compares it with the one before.

    Returns the whole text, each turn's span, the span of each turn's own text inside it, and whether the template
    rewrote what it had written for earlier turns (their spans then start where the two outputs part).
    The text's span comes from rendering the same prefix with a sentinel in its place, so nothing is assumed about
    the template's marks. If earlier turns are rewritten, every text is located once more in the whole output.
    """
    before, turns, bodies, rewrites = "", [], [], False
    for k, (role, _) in enumerate(messages):
        now = render(messages[: k + 1])
        start = len(before)
        if not now.startswith(before):
            rewrites = True
            start = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
        mark = SENTINEL
        while mark in now:
            mark += SENTINEL
        probe = render([*messages[:k], (role, mark)])
        at = probe.find(mark, 0)
        turns.append((start, len(now)))
        bodies.append((at, len(now) - (len(probe) - at - len(mark))) if at >= 0 else (len(now), len(now)))
        before = now
    if rewrites:  # earlier texts may have moved: each is located again in the last rendering
        bodies = []
        for k, (role, _) in enumerate(messages):
            mark = SENTINEL
            while mark in before:
                mark += SENTINEL
            probe = render([*messages[:k], (role, mark), *messages[k + 1 :]])
            at = probe.find(mark)
            bodies.append((at, len(before) - (len(probe) - at - len(mark))) if at >= 0 else (len(before), len(before)))
    return before, turns, bodies, rewrites


SCHEMA = "conv_id bigint, formatted string, turn_spans array<struct<start:bigint,end:bigint>>, loss_spans array<struct<start:bigint,end:bigint>>, rewrites_history boolean"


def format_conversations(conversations: DataFrame, render: Callable[[Messages], str] = marked_turns, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: text, turn spans, spans under the loss mask (code points, end exclusive).

    Rows are taken by turn; equal turns by role, then text. Null turns come first, null roles and texts count as
    empty; a row without a conv_id is a conversation of its own. Repeated rows are repeated turns, an empty table gives
    an empty result, other columns are not looked at.
    A conversation is one value of the result, so it is the unit of work; conversations spread over the cluster. Each
    prefix is rendered twice, so a conversation of t turns costs t times its text.
    """

    def one(t: pa.Table) -> pa.Table:
        rows = list(zip(t["turn"].to_pylist(), t["role"].to_pylist(), t["text"].to_pylist()))
        rows = sorted((x is not None, x or 0, r or "", s or "") for x, r, s in rows)
        messages = [(r, s) for _, _, r, s in rows]
        text, turns, bodies, rewrites = locate(render, messages)
        span = lambda found: [[{"start": a, "end": b} for a, b in found]]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "conv_id": t["conv_id"].slice(0, 1),
                "formatted": pa.array([text], pa.string()),
                "turn_spans": pa.array(span(turns), kind),
                "loss_spans": pa.array(span([b for b, (r, _) in zip(bodies, messages) if r in loss_roles]), kind),
                "rewrites_history": pa.array([rewrites]),
            }
        )

    d = conversations.selectExpr("cast(conv_id AS bigint) AS conv_id", "cast(turn AS bigint) AS turn", "role", "text")
    return d.groupBy("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())).applyInArrow(one, SCHEMA)
