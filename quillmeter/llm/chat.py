r"""Chat formatting in budgeted windows: turn-aligned spans, a kept system turn, repeated history, a loss mask.

A formatted turn is ``### role: text</turn>`` and a line feed. In roles and texts a backslash comes before each
backslash and before what could be read as a control string; taking one backslash from before each character undoes it.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm import tokenizing
from quillmeter.llm.common import row_slices, shuffle_width

END = "</turn>"
_CONTROL = re.compile(r"\\|</turn>|### ")
_ROLE_CONTROL = re.compile(r"\\|</turn>|### |:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
WINDOW_SCHEMA = "conv_id long, window long, n_repeated int, text string, loss array<struct<start:int,end:int>>, n_tokens long"


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text, and where the escaped content starts and ends in it."""
    head, body = f"### {escape(role, _ROLE_CONTROL)}: ", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parsed(text: str) -> list[tuple[str, str]]:
    """The roles and texts of the turns in a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@dataclass
class Conversation:
    """The state of one conversation while its turns stream by: never more than a window and its history."""

    conv_id: int | None
    budget: int
    history_budget: int
    system: tuple | None = None
    history: deque = field(default_factory=deque)
    fresh: list = field(default_factory=list)
    tokens: int = 0  # of system turn, history and fresh turns: the prefix sum since the window began
    window: int = 0
    started: bool = False

    def add(self, role: str, text: str, n: int) -> Iterator[tuple]:
        turn = (role, text, n)
        if not self.started and role == "system":
            self.system, self.fresh, self.tokens, self.started = turn, [turn], n, True
            return
        self.started = True
        if self.tokens + n > self.budget and any(t is not self.system for t in self.fresh):
            yield self.close()
            while self.history and self.tokens + n > self.budget:  # repeated turns make way first
                self.tokens -= self.history.popleft()[2]
        self.fresh.append(turn)
        self.tokens += n

    def close(self) -> tuple:
        repeated = ([self.system] if self.system and self.window else []) + list(self.history)
        text, loss = [], []
        at = 0
        for k, (role, body, _) in enumerate(repeated + self.fresh):
            piece, a, b = formatted(role, body)
            if k >= len(repeated) and role == "assistant":
                loss.append({"start": at + a, "end": at + b})
            text.append(piece)
            at += len(piece)
        row = (self.conv_id, self.window, len(repeated), "".join(text), loss, self.tokens)
        last = [t for t in (*self.history, *self.fresh) if t is not self.system]
        self.history = deque()
        room = self.history_budget
        for t in reversed(last):
            room -= t[2]
            if room < 0:
                break
            self.history.appendleft(t)
        self.window, self.fresh = self.window + 1, []
        self.tokens = (self.system[2] if self.system else 0) + sum(t[2] for t in self.history)
        return row


def windows(turns: DataFrame, tokenizer: str, budget: int = 1024, history_budget: int = 256) -> DataFrame:
    """Training windows of conversations (conv_id, turn, role, text): one row per window, see WINDOW_SCHEMA.

    Formatted turns' tokens, marks and escapes included, are counted by the tokenizer and summed up in order; a window
    ends before the turn whose prefix sum would pass ``budget``. It starts with the conversation's system turn (if that comes first) and with the latest
    turns before it within ``history_budget``; these ``n_repeated`` turns are outside the loss, so every assistant text
    is a target in exactly one window. A turn over the budget has a window of its own.

    Rows are dealt by conversation, sorted by turn, and streamed: a task holds one window, however long a conversation
    is. A null text is empty, a null role is "", rows without conv_id are one conversation, a null turn comes first; rows
    with equal turns are ordered by role and text, and repeated rows are turns like others. Other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now = tokenizing.load(tokenizer), None
        for batch in batches:
            for part in row_slices(batch, size=1 << 20):
                rows, texts = [], part.column("text").to_pylist()
                roles = part.column("role").to_pylist()
                sizes = encoder.counts([formatted(*turn)[0] for turn in zip(roles, texts, strict=True)])
                for conv, role, text, n in zip(part.column("conv_id").to_pylist(), roles, texts, sizes, strict=True):
                    if now is None or now.conv_id != conv:
                        if now:
                            rows.append(now.close())
                        now = Conversation(conv, budget, history_budget)
                    rows += now.add(role, text, n)
                yield _rows(rows)
        if now:
            yield _rows([now.close()])

    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = own.repartition(shuffle_width(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, WINDOW_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), loss, pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in ("conv_id", "window", "n_repeated", "text", "loss", "n_tokens")])


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(made: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted windows alone: digests of its turns and of the text under the loss.

    Windows are dealt by conversation and sorted, wherever they come from; digests are carried from row to row. Other
    columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for conv, window, skip, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "n_repeated", "text", "loss")), strict=True):
                if window == 0:
                    if state:
                        out.append((now, *_ended(state)))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in parsed(text)[skip:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
                state[5] += 1
            yield _digests(out)
        if state:
            yield _digests([(now, *_ended(state))])

    own = made.select("conv_id", "window", "n_repeated", "text", "loss").repartition(shuffle_width(made.sparkSession), "conv_id")
    return own.sortWithinPartitions("conv_id", "window").mapInArrow(run, DIGEST_SCHEMA)


def _ended(state: list) -> tuple:
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in DIGEST_SCHEMA.split(", ")])
