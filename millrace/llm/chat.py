"""Chat formatting into budgeted training windows.

A conversation's turns are laid out by a template that marks turns and escapes its own control strings inside texts,
so the turns can be read back exactly. Prefix sums of the turns' tokens, counted as they are laid out, cut a
conversation into windows of whole turns within a token budget. A window after the first repeats the system turn that
opens the conversation and the last few turns before it; only the texts of assistant turns that are new in a window
are targets, so each is a target once.

Turns are dealt by conversation and sorted, and each task streams through its rows with one window in memory. A
conversation of more than chunk_chars characters is first cut into chunks, by prefix sums of characters over sorted
ranges of its turns; each chunk is dealt on its own, with the few turns before it, and begins a new window. So neither
a very long conversation nor the rows without an id stay in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import broadcast_if_small, materialize, running_sums

BUDGET = 2048
HISTORY_TURNS = 2
HISTORY_TOKENS = 512
#: Characters of a conversation, with TURN_CHARS more for each turn, that are dealt together.
CHUNK_CHARS, TURN_CHARS = 1 << 20, 16
TARGET_ROLE = "assistant"
SYSTEM_ROLE = "system"

#: The template: OPEN role COLON text CLOSE for each turn. Inside roles and texts each control string, and the escape
#: itself, has an escape before it.
OPEN, COLON, CLOSE, ESCAPE = "### ", ": ", " </turn>\n", "\\"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_CONTROL = re.compile(r"\\|###|</turn>|: ")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
#: What stands between control strings, escaped or not.
_ROLE = re.compile(r"(?:[^\\:]|\\\\|\\###|\\</turn>|\\: |:(?! ))*")
_TEXT = re.compile(r"(?:[^\\ ]|\\\\|\\###|\\</turn>|\\: | (?!</turn>\n))*")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def count_tokens(text: str) -> int:
    """Words and punctuation marks; a tokenizer's count can be given in its place."""
    return sum(1 for _ in _TOKEN.finditer(text))


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of a formatted window, start and end those of the text as it stands there."""
    at = 0
    while at < len(formatted):
        role = _ROLE.match(formatted, at + len(OPEN))
        text = _TEXT.match(formatted, role.end() + len(COLON))
        yield unescape(role[0]), unescape(text[0]), text.start(), text.end()
        at = text.end() + len(CLOSE)


@dataclass
class _Turn:
    role: str
    text: str
    tokens: int = 0
    #: Its number in the conversation, and the tokens before it in its chunk.
    number: int = 0
    before: int = 0

    @property
    def formatted(self) -> str:
        return OPEN + escape(self.role) + COLON + escape(self.text) + CLOSE


@dataclass
class _Window:
    """The turns of the window being filled: first `repeated` ones from before, then new ones."""

    turns: list[_Turn] = field(default_factory=list)
    repeated: int = 0
    repeated_tokens: int = 0

    def tokens(self, with_turn: _Turn | None = None) -> int:
        """By prefix sums; of the turns and with_turn, the next one."""
        last = with_turn or self.turns[-1]
        first = self.turns[self.repeated] if len(self.turns) > self.repeated else last
        return self.repeated_tokens + last.before + last.tokens - first.before

    def row(self, conv_id: object) -> tuple:
        at, parts, spans = 0, [], []
        for k, t in enumerate(self.turns):
            parts.append(t.formatted)
            if k >= self.repeated and t.role == TARGET_ROLE:
                start = at + len(OPEN) + len(escape(t.role)) + len(COLON)
                spans.append([start, at + len(parts[-1]) - len(CLOSE)])
            at += len(parts[-1])
        return conv_id, self.turns[self.repeated].number, len(self.turns) - self.repeated, self.repeated, self.tokens(), "".join(parts), spans


def _opened(turn: _Turn, system: _Turn | None, recent: Iterable[_Turn], budget: int, history_tokens: int) -> _Window:
    """A window that is to begin with turn: the system turn, if it fits, and the last of recent that fit, too."""
    head = [system] if system and system.tokens + turn.tokens <= budget else []
    used = sum(t.tokens for t in head)
    room = min(history_tokens, budget - turn.tokens - used)
    past: list[_Turn] = []
    for t in reversed(list(recent)):
        if t.tokens > room:
            break
        room, used = room - t.tokens, used + t.tokens
        past.insert(0, t)
    return _Window(head + past, len(head + past), used)


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)


def _cut(rows: Iterator[tuple[object, int, bool, int | None, str, str]], budget: int, history_turns: int, history_tokens: int, count: Callable[[str], int]) -> Iterator[tuple]:
    """Window rows from (conversation, chunk, known, number, role, text) rows in order. Known turns are new in the chunk
    before and come first; number is null where a conversation is one chunk."""
    now, window, system = None, _Window(), None
    recent: deque[_Turn] = deque(maxlen=history_turns)
    for conv_id, chunk, known, number, role, text in rows:
        if now is None or now[1] != chunk or not _same(now[0], conv_id):
            if window.turns:
                yield window.row(now[0])
            now, window, system, numbered, total = (conv_id, chunk), _Window(), None, 0, 0
            recent.clear()
        turn = _Turn(role, text, number=numbered if number is None else number, before=total)
        turn.tokens = max(1, count(turn.formatted))
        if known:
            if turn.number == 0 and role == SYSTEM_ROLE:
                system = turn
            else:
                recent.append(turn)
            continue
        numbered, total = numbered + 1, total + turn.tokens
        if not window.turns and turn.number:  # the first of a later chunk
            window = _opened(turn, system, (t for t in recent if t.number >= turn.number - history_turns), budget, history_tokens)
        elif len(window.turns) > window.repeated and window.tokens(turn) > budget:
            yield window.row(conv_id)
            window = _opened(turn, system, recent, budget, history_tokens)
        window.turns.append(turn)
        if turn.number == 0 and role == SYSTEM_ROLE:
            system = turn
        else:
            recent.append(turn)
    if window.turns:
        yield window.row(now[0])


WINDOW = "first_turn long, n_new int, n_repeated int, n_tokens int, formatted string, loss_spans array<array<int>>"


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), F.col("text")]


def _in_chunks(turns: DataFrame, chunk_chars: int, history_turns: int) -> DataFrame:
    """turns with _chunk, _known and _number: long conversations in chunks, with the turns that windows of a chunk may
    repeat from before it, others as they are."""
    chars = (F.length("role") + F.length("text") + TURN_CHARS).cast("long")
    long = turns.groupBy(F.col("conv_id").alias("_long")).agg(F.sum(chars).alias("_chars")).where(F.col("_chars") > chunk_chars).select("_long")
    long = materialize(long, "long")
    whole = [F.lit(0).cast("long").alias("_chunk"), F.lit(False).alias("_known"), F.lit(None).cast("long").alias("_number")]
    if long.isEmpty():
        return turns.select("*", *whole)
    long = broadcast_if_small(long)
    is_long = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = turns.join(long, is_long, "left_anti").select("*", *whole)
    numbered = running_sums(materialize(turns.join(long, is_long, "left_semi"), "turns"), _order(), {"_number": F.lit(1).cast("long"), "_before": chars}, by=("conv_id",), one_task_rows=0)
    numbered = materialize(numbered.select(*turns.columns, F.floor(F.col("_before") / chunk_chars).alias("_chunk"), F.lit(False).alias("_known"), "_number"), "numbered")
    first = numbered.groupBy(F.col("conv_id").alias("_c"), F.col("_chunk").alias("_to")).agg(F.min("_number").alias("_first")).where("_to > 0")
    wanted = F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.sequence(F.greatest(F.lit(0), F.col("_first") - history_turns), F.col("_first") - 1) if history_turns else F.array().cast("array<bigint>")))
    wanted = broadcast_if_small(materialize(first.select("_c", "_to", F.explode(wanted).alias("_n")), "wanted"))
    known = numbered.join(wanted, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_number") == F.col("_n")))
    known = known.select(*turns.columns, F.col("_to").alias("_chunk"), F.lit(True).alias("_known"), "_number")
    return short.unionByName(numbered).unionByName(known)


def format_windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    count: Callable[[str], int] = count_tokens,
    chunk_chars: int = CHUNK_CHARS,
    batch_bytes: int = 1 << 22,
) -> DataFrame:
    """One row per window of the conversations in turns (conv_id, turn, role, text; other columns are left out).

    first_turn, the number of its first new turn, tells a conversation's windows apart and orders them; n_new tells how
    many turns are new in it, n_repeated how many stand before them; n_tokens is the tokens of all as laid out;
    loss_spans are the [start, end) code points in formatted of the target texts. Every turn is new in one window. No
    window has more tokens than the budget but that of a turn which alone has more: it is never cut, and stands alone.
    The system turn is left out of a window only where it and the first new turn are above the budget together.

    conv_id is of any type that Spark groups and sorts by, and comes back as it was. Turns are in the order of turn
    (null first), then role and text; rows of equal turn numbers all stay, and so do repeated rows. Null roles and
    texts are empty. Rows without a conv_id form one conversation. No rows give no windows. A conversation of more
    than chunk_chars characters begins a window at each multiple of them.
    """
    out = T.StructType([turns.select("conv_id").schema[0], *T.StructType.fromDDL(WINDOW).fields])
    plain = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    keys = [F.col("conv_id").asc_nulls_first(), F.col("_chunk")]
    dealt = _in_chunks(plain, chunk_chars, history_turns).repartition("conv_id", "_chunk").sortWithinPartitions(*keys, ~F.col("_known"), *_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                kind[:] = [b.schema.field(0).type]
                for row in zip(*b.columns, strict=True):
                    yield tuple(x.as_py() for x in row)

        held: list[tuple] = []
        size = 0
        for row in _cut(rows(), budget, history_turns, history_tokens, count):
            held.append(row)
            size += len(row[5])
            if size > batch_bytes:
                yield _batch(held, kind[0], out)
                held, size = [], 0
        if held:
            yield _batch(held, kind[0], out)

    return dealt.select("conv_id", "_chunk", "_known", "_number", "role", "text").mapInArrow(run, out)


_ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.ArrayType(T.ArrayType(T.IntegerType())): pa.list_(pa.list_(pa.int32()))}


def _batch(rows: list[tuple], kind: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    kinds = [kind, *[_ARROW[f.dataType] for f in schema[1:]]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


@dataclass
class _Digest:
    """What is read of one conversation's windows so far."""

    conv_id: object
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])

    def add(self, formatted: str, n_repeated: int, spans: list[list[int]]) -> None:
        for role, text, _, _ in list(parse(formatted))[n_repeated:]:
            self.turns.update(f"{role}\n{text}\n".encode())
            self.counts[0] += 1
        for start, end in spans:
            target = unescape(formatted[start:end])
            self.loss.update(target.encode())
            self.counts[1] += len(target)
        self.counts[2] += len(formatted)
        self.counts[3] += 1

    def row(self) -> tuple:
        n, loss_chars, chars, windows = self.counts
        return self.conv_id, n, self.turns.hexdigest(), loss_chars, self.loss.hexdigest(), chars, windows


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from the windows of format_windows in any order: how many turns there are, the
    SHA-256 of role, newline, text, newline for each, the code points and SHA-256 of all text under the loss mask,
    and the code points of all windows. conv_id comes back as it was, null for the rows without one; no windows give no
    rows. A digest is of a whole conversation, so its windows stream through one task, one at a time."""
    out = T.StructType([windows.schema["conv_id"], *T.StructType.fromDDL(DIGEST).fields])
    dealt = windows.select("conv_id", "first_turn", "n_repeated", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "first_turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, kind = None, [], None
        for b in batches:
            kind = b.schema.field(0).type
            for row in zip(*b.columns, strict=True):
                conv_id, _, n_repeated, formatted, spans = (x.as_py() for x in row)
                if now is None or not _same(now.conv_id, conv_id):
                    if now:
                        held.append(now.row())
                    if len(held) == 10_000:
                        yield _batch(held, kind, out)
                        held = []
                    now = _Digest(conv_id)
                now.add(formatted, n_repeated, spans)
        if now:
            yield _batch([*held, now.row()], kind, out)

    return dealt.mapInArrow(run, out)
