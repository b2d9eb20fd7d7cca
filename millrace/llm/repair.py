"""Repair of conversations by cheapest edits: a backward cost-to-go DP over turn and grammar state, a greedy forward walk.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an assistant turn. Four
grammar states tell what may come next. The least cost from a turn and a state to the end is found backwards; then,
from the first turn on, of the edits that keep to that cost the one of the least letter is taken.

No conversation is held by one task while edits are found. Its turns are numbered by prefix sums over ranges and cut into
chunks of CHUNK. The costs of a chunk are a 4 x 4 matrix over the states at its ends; the chunks of a conversation are
swept backwards for the costs at their ends and forwards for the states in which they begin, one row per chunk. Within a
task, NumPy steps through all its chunks side by side. What needs a whole conversation is only its digest, which streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import SPACE, materialize, running_sums

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns of a conversation whose costs are found together.
CHUNK = 4096
#: Turns that a task steps through side by side.
BLOCK = 1 << 20
_NEVER = 1 << 40

#: States: nothing yet, after the system turn, after a user's, after an assistant's. The state after the turn that may be
#: inserted, or a turn be given the role of: a user's, but after a user's turn an assistant's.
_NEXT = np.array([2, 2, 3, 2])
#: By the initial of a kept turn (s, u, a, other) and the state before: the state after, 4 if it may not stand there.
_KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: What is left to pay behind the last turn.
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
ROLES = ("user", "assistant")
#: Of a turn, as one number: the initials inserted before it (place in _BEFORE) times 32, its edit (place in _EDITS, with
#: the initial of a new role) times 4, and its fault; edit E stands behind the last turn.
_BEFORE = ["", "u", "a", "ua", "au"]
_EDITS = ["D", "K", "Ru", "Ra", "E"]
FAULTS = ("none", "blank", "duplicate", "truncated")


def damage(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with planted faults, by the CRC of `conv_id:turn` modulo 20: 0 drops the
    row, 1 empties its text, 2 removes the text's `.`, `!` and `?`, 3 repeats the row, 4 makes it the user's. A null role
    or text, and a null in the CRC's text, are one space; null turns and ids stay. Other columns are left out."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def numbered(turns: DataFrame, one_task_rows: int | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) with `place`, from 0 in their conversation, written to the shared folder. Turns
    are in the order of turn (null first), then role and text; null roles and texts are empty; rows without a conv_id
    are one conversation. Other columns are left out."""
    plain = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    more = {} if one_task_rows is None else {"one_task_rows": one_task_rows}
    return materialize(running_sums(plain, order, {"place": F.lit(1).cast("long")}, ("conv_id",), **more), "numbered")


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, place, initial, fault) of numbered's turns, without their texts. fault is one of FAULTS: blank without a
    word, duplicate if role and text stand earlier, truncated if the last character that is no space is none of `.`, `!`
    and `?`. initial is the place of the role's among s, u and a, -1 for another."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    cut = ~F.substring(trimmed, -1, 1).isin(".", "!", "?")
    initial = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in "sua"]), F.substring("role", 1, 1)) - 1, F.lit(-1)).cast("int")
    narrow = turns.select("conv_id", "place", initial.alias("initial"), (trimmed == "").alias("_blank"), cut.alias("_cut"))
    # The first of equal turns: one row for each, counted before it is shuffled, and matched by its place.
    firsts = turns.where(trimmed != "").groupBy("conv_id", "role", F.sha2("text", 256).alias("_same")).agg(F.min("place").alias("_p"))
    firsts = firsts.select(F.col("conv_id").alias("_c"), "_p")
    met = narrow.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("_p")), "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_p").isNull(), "duplicate").when(F.col("_cut"), "truncated").otherwise("none")
    return met.select("conv_id", "place", "initial", fault.alias("fault"))


def _decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The initial, whether the turn must go, and what is paid for one that stays."""
    fault = codes >> 2
    return codes & 3, (fault == 1) | (fault == 2), np.where(fault == 3, TRUNCATED, 0)


def _insert(base: np.ndarray) -> np.ndarray:
    """Costs (..., 4 states) where turns may also be inserted first; two are never worth more than once."""
    out = base.copy()
    out[..., 2] = np.minimum(base[..., 2], INSERT + base[..., 3])
    out[..., 3] = np.minimum(base[..., 3], INSERT + base[..., 2])
    for s in (0, 1):
        out[..., s] = np.minimum(base[..., s], INSERT + out[..., 2])
    return out


class _Block:
    """Chunks side by side, the longest first."""

    def __init__(self, chunks: list[bytes]) -> None:
        self.sizes = np.array([len(c) for c in chunks])
        self.order = np.argsort(-self.sizes, kind="stable")
        self.sizes = self.sizes[self.order]
        self.steps = int(self.sizes[0]) if len(chunks) else 0
        self.codes = np.zeros((self.steps, len(chunks)), np.uint8)
        for k, at in enumerate(self.order):
            self.codes[: self.sizes[k], k] = np.frombuffer(chunks[at], np.uint8)

    def live(self, step: int) -> int:
        """How many of the chunks have a turn of this number."""
        return int(np.searchsorted(-self.sizes, -step, side="left"))

    def back(self, at_end: np.ndarray, keep: bool) -> np.ndarray:
        """at_end: costs by chunk, any number of cases and state, with which each chunk ends. Those with which it begins,
        or, if keep, the costs before each turn and at the end, by step."""
        costs = at_end[self.order].astype(np.int64)
        table = np.zeros((self.steps + 1, *costs.shape), np.int64) if keep else None
        ended = costs.copy()
        for step in range(self.steps - 1, -1, -1):
            n = self.live(step)
            if keep:
                table[step + 1, :n] = costs[:n]
            after = np.concatenate([costs[:n], np.full((*costs[:n].shape[:-1], 1), _NEVER)], axis=-1)
            initial, forced, more = _decoded(self.codes[step, :n])
            cases = (slice(None), *[None] * (costs.ndim - 2))
            stays = np.where(forced, _NEVER, more)[(*cases, None)]
            index = np.broadcast_to(_KEPT[initial][(*cases, slice(None))], costs[:n].shape)
            kept = KEEP + stays + np.take_along_axis(after, index, axis=-1)
            changed = REROLE + stays + after[..., _NEXT]
            costs[:n] = _insert(np.minimum(np.minimum(after[..., :4] + DELETE, kept), changed))
        if keep:
            table[0] = costs
            for k, size in enumerate(self.sizes):
                table[size, k] = ended[k]
            return table
        out = np.empty_like(costs)
        out[self.order] = costs
        return out

    def walk(self, table: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """table: costs by step, chunk and state, of one case. The edits, by step and chunk in the block's order, and the
        states (in the order given) that the chunks end in."""
        now, edits = state[self.order].copy(), np.zeros((self.steps, len(self.order)), np.uint8)
        for step in range(self.steps):
            n = self.live(step)
            rows, s = np.arange(n), now[:n].copy()
            here, after = table[step, :n], np.concatenate([table[step + 1, :n], np.full((n, 1), _NEVER)], axis=1)
            initial, forced, more = _decoded(self.codes[step, :n])
            before, first = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
            for turn in range(2):
                inserts = (here[rows, s] != DELETE + after[rows, s]) & (here[rows, s] == INSERT + here[rows, _NEXT[s]])
                letter = np.where(_NEXT[s] == 2, 1, 2)
                if turn == 0:
                    first = np.where(inserts, letter, 0)
                    before = first
                else:
                    before = np.where(inserts, np.where(first == 1, 3, 4), before)
                s = np.where(inserts, _NEXT[s], s)
            goes = here[rows, s] == DELETE + after[rows, s]
            kept_to = _KEPT[initial, s]
            kept = ~goes & ~forced & (here[rows, s] == KEEP + more + after[rows, kept_to])
            edits[step, :n] = before * 32 + np.where(goes, 0, np.where(kept, 1, np.where(_NEXT[s] == 2, 2, 3))) * 4 + (self.codes[step, :n] >> 2)
            now[:n] = np.where(goes, s, np.where(kept, kept_to, _NEXT[s]))
        out = np.empty_like(now)
        out[self.order] = now
        return edits, out


def _blocks(codes: list[bytes]) -> Iterator[slice]:
    """Consecutive chunks of about BLOCK turns, as they lie in the block's rectangle."""
    at = longest = 0
    for k, c in enumerate(codes):
        longest = max(longest, len(c))
        if k > at and longest * (k + 1 - at) > BLOCK:
            yield slice(at, k)
            at, longest = k, len(c)
    if at < len(codes):
        yield slice(at, len(codes))


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)


def _sweep_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks by conversation, the last first: for each the costs at its end, and the states it ends in by those it begins in."""
    conv, costs = [], _END
    for b in batches:
        ids, codes = b.column(0).to_pylist(), b.column(2).to_pylist()
        ends, exits, last = [], [], []
        for part in _blocks(codes):
            block = _Block(codes[part])
            unit = np.where(np.eye(4, dtype=bool), 0, _NEVER)
            matrix = block.back(np.broadcast_to(unit, (len(codes[part]), 4, 4)).copy(), keep=False)  # chunk, end, begin
            own = np.empty((len(codes[part]), 4), np.int64)
            for k, i in enumerate(ids[part]):
                is_last = not conv or not _same(conv[0], i)
                if is_last:
                    conv, costs = [i], _END
                own[k] = costs
                last.append(is_last)
                costs = (matrix[k] + costs[:, None]).min(axis=0)
            table = block.back(own, keep=True)
            exits.append(np.stack([block.walk(table, np.full(len(own), s))[1] for s in range(4)], axis=1))
            ends.append(own)
        if not ids:
            continue
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(x).ravel().astype(np.int64)), 4).cast(pa.list_(pa.int64())) for x in (ends, exits)]
        yield pa.RecordBatch.from_arrays([*b.columns, *lists, pa.array(last, pa.bool_())], names=[*b.schema.names, "ends", "exits", "last"])


def _sweep_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks by conversation, the first first: the edits of their turns; after the last one's, the edits behind it."""
    conv, state = [], 0
    for b in batches:
        ids, codes = b.column(0).to_pylist(), b.column(2).to_pylist()
        ends, exits = (np.array(b.column(k).to_pylist(), np.int64).reshape(-1, 4) for k in (3, 4))
        last, edits = b.column(5).to_pylist(), []
        for part in _blocks(codes):
            begins, leaves = [], []
            for k in range(part.start, part.stop):
                if not conv or not _same(conv[0], ids[k]):
                    conv, state = [ids[k]], 0
                begins.append(state)
                state = int(exits[k, state])
                leaves.append(state)
            block = _Block(codes[part])
            found, _ = block.walk(block.back(ends[part], keep=True), np.array(begins))
            place = np.argsort(block.order)
            for k, p in enumerate(place):
                own = found[: block.sizes[p], p].tobytes()
                tail = {1: _BEFORE.index("ua"), 2: _BEFORE.index("a")}.get(leaves[k]) if last[part.start + k] else None
                edits.append(own + (bytes([tail * 32 + _EDITS.index("E") * 4]) if tail else b""))
        if ids:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(edits, pa.binary())], names=["conv_id", "_chunk", "_edits"])


def cheapest_edits(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, _chunk, _edits) of the turns in faults' result: a byte for each turn of a chunk, and one more behind the
    last turn of a conversation if turns are inserted there."""
    fault = F.array_position(F.array(*[F.lit(f) for f in FAULTS]), F.col("fault")) - 1
    code = F.when(F.col("initial") >= 0, F.col("initial")).otherwise(3) + 4 * fault
    narrow = found.select("conv_id", "place", code.cast("int").alias("code"))
    held = narrow.groupBy("conv_id", F.floor(F.col("place") / chunk).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("of"))
    codes = F.unhex(F.array_join(F.transform("of", lambda x: F.lpad(F.hex(x["code"]), 2, "0")), ""))
    dealt = held.select("conv_id", "_chunk", codes.alias("codes")).repartition("conv_id")
    id_field = found.schema["conv_id"]
    middle = T.StructType([id_field, *T.StructType.fromDDL("_chunk long, codes binary, ends array<long>, exits array<long>, last boolean").fields])
    back = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.desc("_chunk")).mapInArrow(_sweep_back, middle)
    out = T.StructType([id_field, *T.StructType.fromDDL("_chunk long, _edits binary").fields])
    return back.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "_chunk").mapInArrow(_sweep_on, out)


def repair(turns: DataFrame, chunk: int = CHUNK, one_task_rows: int | None = None) -> DataFrame:
    """The turns (conv_id, turn, role, text) with the edits of least cost that give each conversation's roles the form
    `(s?(ua)+)?` of their initials; of several such sequences of edits, the one whose initials are ASCII-least.

    A row for each turn in the order of `place`: conv_id, turn, place, role and text as given, its `fault` (see
    faults), `inserted`, the initials of empty turns to be inserted before it, its `edit` (Keep, Rerole or Delete, by
    initial) and `new_role`, null for a deleted turn. Behind the last turn, a row with edit E where turns are to be
    inserted there. Keeping costs 0, a new role 3, deleting 4 and is required of blank and duplicate turns, inserting 3; a
    truncated turn that stays adds 3. `repaired` gives the new turns, `digests` one row per conversation. Rows of a
    conversation lie in one partition in order. Nulls, ties, repeated rows and other columns are as in numbered; a turn
    whose role has none of the initials is kept nowhere. No rows give none.
    """
    placed = numbered(turns, one_task_rows)
    edits = materialize(cheapest_edits(faults(placed), chunk), "edits")
    # The edits of a chunk stand before its turns: one shuffle, no join of texts.
    names = ["conv_id", "turn", "role", "text", "place"]
    rows = placed.select(*names, F.floor(F.col("place") / chunk).alias("_chunk"), F.lit(None).cast("binary").alias("_edits"))
    heads = edits.select("conv_id", *[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in names[1:]], "_chunk", "_edits")
    dealt = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "_chunk", F.col("place").asc_nulls_first())
    out = T.StructType([T.StructField(f.name, f.dataType) for f in [*[placed.schema[c] for c in names], *T.StructType.fromDDL("fault string, inserted string, edit string, new_role string").fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = b"", 0
        for b in batches:
            roles, places, chunks, heads = (b.column(k).to_pylist() for k in (2, 4, 5, 6))
            # Of each row of the result: the row it is of, the same but for one behind the last turn, and what is new.
            of, own, made = [], [], []
            for k, head in enumerate(heads):
                if head is not None:
                    now, first = head, chunks[k] * chunk
                    continue
                at = places[k] - first
                edit = _EDITS[now[at] >> 2 & 7]
                new_role = roles[k] if edit == "K" else ROLES["ua".index(edit[1])] if edit[0] == "R" else None
                of.append(k)
                own.append(k)
                made.append((places[k], FAULTS[now[at] & 3], _BEFORE[now[at] >> 5], edit[0], new_role))
                if at + 2 == len(now) and now[at + 1] >> 2 & 7 == 4:
                    of.append(k)
                    own.append(None)
                    made.append((places[k] + 1, None, _BEFORE[now[at + 1] >> 5], "E", None))
            if of:
                kept = [c.take(pa.array(of if n == "conv_id" else own, pa.int64())) for n, c in zip(names, b.columns[:5], strict=True)]
                kept[4] = pa.array([m[0] for m in made], pa.int64())
                new = [pa.array([m[k] for m in made], pa.string()) for k in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=out.names)

    return dealt.select(*names, "_chunk", "_edits").mapInArrow(run, out)


def repaired(edited: DataFrame) -> DataFrame:
    """(conv_id, place, step, role, text, turn) of the turns after repair, in the order of place and step: those that are
    inserted have an empty text and no turn. edited is of repair."""
    old = F.when(F.col("new_role").isNotNull(), F.array(F.struct(F.col("new_role").alias("role"), "text", "turn")))
    none = F.array().cast("array<string>")
    initials = F.when(F.col("inserted") == "", none).otherwise(F.split("inserted", ""))
    new = F.transform(initials, lambda i: F.struct(F.when(i == "u", ROLES[0]).otherwise(ROLES[1]).alias("role"), F.lit("").alias("text"), F.lit(None).cast(edited.schema["turn"].dataType).alias("turn")))
    return edited.select("conv_id", "place", F.posexplode(F.concat(new, F.coalesce(old, F.slice(new, 1, 0)))).alias("step", "of")).select("conv_id", "place", "step", "of.*")


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Digest:
    """What is read of one conversation so far."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.before, self.text, self.audit = conv_id, None, hashlib.sha256(), []
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal = self.cost = self.turns = self.written = 0
        self.low = self.high = None

    def write(self, role: str, text: str) -> None:
        self.text.update((("\n" if self.written else "") + role + ":" + text).encode())
        self.written += 1

    def add(self, turn: int | None, role: str | None, text: str | None, fault: str | None, inserted: str, edit: str, new_role: str | None) -> None:
        for i in inserted:
            self.write(ROLES["ua".index(i)], "")
        self.audit.append("I" * len(inserted))
        self.cost += INSERT * len(inserted)
        if edit == "E":
            return
        self.audit.append(edit)
        if new_role is not None:
            self.write(new_role, text)
        self.cost += {"D": DELETE, "K": KEEP, "R": REROLE}[edit] + (TRUNCATED if edit != "D" and fault == "truncated" else 0)
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *[self.counts[f] for f in FAULTS[1:]], self.illegal, self.cost, "".join(self.audit), self.text.hexdigest()


def digests(edited: DataFrame) -> DataFrame:
    """One row per conversation of repair's result, read as it lies: gaps, how many numbers between the least and the
    largest turn (a whole number) no turn has; the turns of each fault; illegal, the neighbours as given whose initials
    are none of su, ua and au; the least cost; audit, the initials of the edits; the SHA-256 of the repaired `role:text`,
    newline-joined. A digest is of a whole conversation: its turns stream through one task, one at a time."""
    out = T.StructType([edited.schema["conv_id"], *T.StructType.fromDDL(DIGEST).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, kind = None, [], None

        def batch() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=out.names)

        for b in batches:
            kind = b.schema.field(0).type
            for conv_id, *turn in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if now is None or not _same(now.conv_id, conv_id):
                    if now:
                        held.append(now.row())
                    now = _Digest(conv_id)
                    if len(held) == 10_000:
                        yield batch()
                        held = []
                now.add(*turn)
        if now:
            held.append(now.row())
            yield batch()

    return edited.select("conv_id", "turn", "role", "text", "fault", "inserted", "edit", "new_role").mapInArrow(run, out)
