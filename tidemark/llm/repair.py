"""Repair of conversation structure: the cheapest edits that leave an optional system turn and user-assistant pairs.

Edits are Keep, Rerole (to user or assistant), Delete and Insert (an empty user or assistant turn). Which roles may follow
is a machine of four states, so the costs of finishing from a place in a conversation are a vector of four numbers, and
what rows do to it is a 4 x 4 matrix under (min, +). A conversation is cut into blocks of about the square root of the
longest one's rows. Tasks make each block's matrix on their own; a backward pass over those gives the vector behind each
block, and only these checkpoints are stored. A forward walk then recomputes one block's vectors at a time and follows
the edits that are tight (their cost plus the rest is the least cost), the ASCII-least initial first.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import prepared, stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Blocks hold 2 to this power rows at least.
MIN_BITS = 6

FAULTS = ("", "truncated", "blank", "duplicate")
SPACE = " \t\n\x0b\x0c\r"

# States: 0 nothing yet, 1 behind a system turn, 2 behind a user turn, 3 behind a pair. Kept turns move by their initial;
# a turn that may take any of the two roles takes the one that can follow.
_INITIALS = ("", "s", "u", "a")
_KEPT = ({}, {0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3})
_NEXT = (2, 2, 3, 2)
_SAID = ("user", "user", "assistant", "user")
_LEGAL = {(1, 2), (2, 3), (3, 2)}
_FINAL = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 50


def before(kind: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs ahead of a row, by state, from those behind it. A kind is 4 x fault + initial."""
    fault, initial = divmod(kind, 4)
    cost = [DELETE + c for c in after]
    if fault < 2:
        extra = TRUNCATED * fault
        for state, to in _KEPT[initial].items():
            cost[state] = min(cost[state], extra + after[to])
        for state, to in enumerate(_NEXT):
            cost[state] = min(cost[state], REROLE + extra + after[to])
    cost[2], cost[3] = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    cost[0], cost[1] = min(cost[0], INSERT + cost[2]), min(cost[1], INSERT + cost[2])
    return tuple(cost)


def _step(kind: int) -> np.ndarray:
    """The matrix of a row: cost from a state ahead of it to one behind it."""
    ends = [before(kind, tuple(0 if s == end else _FAR for s in range(4))) for end in range(4)]
    return np.minimum(np.array(ends, np.int64).T, _FAR)


#: Matrices by kind; the last one, for places behind a block's end, changes nothing.
_STEPS = np.stack([*(_step(k) for k in range(16)), np.where(np.eye(4, dtype=bool), 0, _FAR)])


def matrices(blocks: list[list[int]]) -> np.ndarray:
    """The matrix of each block of kinds, all blocks at once, from their last rows to their first."""
    longest = max(map(len, blocks), default=0)
    kinds = np.full((len(blocks), longest), len(_STEPS) - 1)
    for i, b in enumerate(blocks):
        kinds[i, : len(b)] = b
    out = np.broadcast_to(_STEPS[-1], (len(blocks), 4, 4))
    for at in reversed(range(longest)):
        out = np.minimum((_STEPS[kinds[:, at]][:, :, :, None] + out[:, None, :, :]).min(axis=2), _FAR)
    return out


def walk(kinds: list[int], after: tuple[int, ...], state: int) -> Iterator[tuple[str, int | None, int]]:
    """Cheapest edits of a block from ``state``: ``(initial, row or None, state behind it)``, ASCII-least of equals."""
    costs = [after]
    for kind in reversed(kinds):
        costs.append(before(kind, costs[-1]))
    costs.reverse()
    at = 0
    while at < len(kinds):
        fault, initial = divmod(kinds[at], 4)
        here, behind, extra = costs[at][state], costs[at + 1], TRUNCATED * fault
        if here == DELETE + behind[state]:
            yield "D", at, state
            at += 1
        elif here == INSERT + costs[at][_NEXT[state]]:
            state = _NEXT[state]
            yield "I", None, state
        else:
            kept = _KEPT[initial].get(state)
            edit = "K" if kept is not None and here == extra + behind[kept] else "R"
            state = kept if edit == "K" else _NEXT[state]
            yield edit, at, state
            at += 1


def finish(state: int) -> Iterator[tuple[str, int | None, int]]:
    """Inserts behind the last row."""
    while _FINAL[state]:
        state = _NEXT[state]
        yield "I", None, state


def damaged(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults put in by crc32(`conv_id:turn`) % 20; nulls there and in role and text
    count as one space: 0 drops a row, 1 empties its text, 2 removes `.!?`, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("draw"),
    )
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.where("draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


_ORDER = ["conv_id", "turn", "role", "h1", "h2"]


def _keyed(turns: DataFrame) -> DataFrame:
    """Rows with two hashes that stand for (conversation, role, text); rows that tie in all of `_ORDER` are equal."""
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    return rows.select(
        "*", F.xxhash64("conv_id", "role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role", "conv_id").alias("h2")
    )


def _kind(fault: Column) -> Column:
    initial = F.left(F.col("role"), F.lit(1))
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    return (fault * 4 + code).cast("int")


def _blocks(keyed: DataFrame, min_bits: int) -> DataFrame:
    """``(start, conv_id, kinds, turn, role, h1, h2)``: the kinds of each block's rows, and where its first one stands.

    Narrow rows are sorted over the whole table and numbered; a row's equals are found by an aggregate, so a conversation
    of any length is shared among tasks. No text is shuffled.
    """
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(said == "", 2).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    narrow = keyed.select(*_ORDER, fault.alias("fault")).repartitionByRange("conv_id", "turn", "role", "h1")
    narrow = narrow.sortWithinPartitions(*_ORDER).withColumn("place", F.monotonically_increasing_id())
    narrow = stored(narrow, "turns")
    longest = narrow.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    bits = max(min_bits, (max(0, longest - 1).bit_length() + 1) // 2)
    first = narrow.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = narrow.join(stored(first, "repeated-turns"), ["h1", "h2"], "left")
    # Of the faults of a row the first counts: blank, duplicate, truncated.
    own = F.when((F.col("fault") < 2) & (F.col("place") > F.col("first")), 3).otherwise(F.col("fault"))
    rows = rows.select(*_ORDER, "place", _kind(own).alias("kind"))
    of = rows.groupBy("conv_id", F.shiftright("place", bits).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "kind"))).alias("rows"),
        F.min_by(F.struct(*_ORDER[1:]), "place").alias("key"),
    )
    start, kinds = F.col("rows")[0]["place"], F.transform("rows", lambda x: x["kind"])
    return stored(of.select(start.alias("start"), "conv_id", kinds.alias("kinds"), "key.*"), "blocks")


def _checkpoints(blocks: DataFrame) -> DataFrame:
    """``(start, after)``: the cost vector behind each block."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = matrices(b.column("kinds").to_pylist()).reshape(b.num_rows, 16)
                yield b.select(["conv_id", "start"]).append_column("m", pa.array(made.tolist(), pa.list_(pa.int64())))

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, after = object(), _FINAL
        for b in batches:
            found = []
            for conv_id, m in zip(b.column("conv_id").to_pylist(), b.column("m").to_pylist(), strict=True):
                conv, after = conv_id, after if conv_id == conv else _FINAL
                found.append(after)
                after = tuple(min(m[4 * s + e] + after[e] for e in range(4)) for s in range(4))
            yield b.select(["start"]).append_column("after", pa.array(found, pa.list_(pa.int64())))

    made = blocks.select("conv_id", "start", "kinds").mapInArrow(product, "conv_id long, start long, m array<long>")
    dealt = made.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("start"))
    return stored(dealt.mapInArrow(backward, "start long, after array<long>"), "checkpoints")


def _dealt(turns: DataFrame, ids: DataFrame, min_bits: int) -> DataFrame:
    """All a task needs to walk its conversations, in order: an opening row each, and blocks ahead of their rows."""
    keyed = _keyed(turns)
    blocks = _blocks(keyed, min_bits)
    blocks = blocks.join(_checkpoints(blocks), "start")
    none = {n: F.lit(None).cast(t).alias(n) for n, t in dict(blocks.dtypes, text="string").items()}
    ids = ids.select(F.col("conv_id").cast("long")).distinct()
    opening = ids.select("conv_id", *(none[n] for n in [*_ORDER[1:], "start", "kinds", "after", "text"]), F.lit(0).alias("tag"))
    heads = blocks.select(*_ORDER, "start", "kinds", "after", none["text"], F.lit(1).alias("tag"))
    rows = keyed.select(*_ORDER, none["start"], none["kinds"], none["after"], "text", F.lit(2).alias("tag"))
    # Rows equal to the first one of a block may stand behind its head before it begins: heads wait in a queue.
    whole = opening.unionByName(heads).unionByName(rows).repartition("conv_id").sortWithinPartitions(*_ORDER, "tag", "start")
    return whole.select("conv_id", "tag", "turn", "role", "text", "kinds", "after")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Edits of each batch's conversations: ``(conv_id, edit, role, text, turn, kind)``, edit None where one begins."""
    conv_id, state, heads, block = None, 0, deque(), []
    begun = False

    def inserted(to: int) -> tuple:
        return conv_id, "I", "assistant" if to == 3 else "user", "", None, None

    for b in batches:
        out: list[tuple] = []
        columns = (b.column(n).to_pylist() for n in ("conv_id", "tag", "turn", "role", "text", "kinds", "after"))
        for now, tag, turn, role, text, kinds, after in zip(*columns, strict=True):
            if not begun or now != conv_id:
                out += [inserted(to) for _, _, to in finish(state)]
                conv_id, state, begun = now, 0, True
                out.append((conv_id, None, None, None, None, None))
            if tag == 1:
                heads.append((kinds, tuple(after)))
            elif tag == 2:
                block.append((turn, role, text))
                if len(block) == len(heads[0][0]):
                    kinds, after = heads.popleft()
                    for edit, at, to in walk(kinds, after, state):
                        if at is None:
                            out.append(inserted(to))
                        else:
                            turn, role, text = block[at]
                            out.append((conv_id, edit, _SAID[state] if edit == "R" else role, text, turn, kinds[at]))
                        state = to
                    block = []
        yield out
    yield [inserted(to) for _, _, to in finish(state)]


def _mapped(dealt: DataFrame, made: Callable[[Iterator[list[tuple]]], Iterator[list[tuple]]], spec: dict[str, pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in made(_walked(batches)):
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, spec.values(), strict=True)], list(spec))

    return dealt.mapInArrow(run, ", ".join(f"{n} {'long' if t == pa.int64() else t}" for n, t in spec.items()))


def edits(turns: DataFrame, min_bits: int = MIN_BITS) -> DataFrame:
    """``(conv_id, n, edit, role, text, turn, fault)``: the cheapest edits of ``turns(conv_id, turn, role, text, ...)``.

    ``n`` counts a conversation's edits from 1; the repaired conversation is the rows whose edit is not D, in that order,
    and holds an optional system turn and user-assistant pairs. Turns go by turn (null first), role, and a hash of the
    text; a null role or text counts as one space, and only a role's first letter matters. Repeated rows are duplicates.
    A row is blank without a character that is no white space, a duplicate if role and text occur earlier, truncated if
    it does not end in one of `.!?`; blank rows and duplicates are deleted. Rows with a null conv_id form a conversation.
    Other columns are not read. An empty table gives an empty result.
    """

    def numbered(walked: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        n = 0
        for rows in walked:
            out = []
            for conv_id, edit, role, text, turn, kind in rows:
                n = 0 if edit is None else n + 1
                if edit:
                    out.append((conv_id, n, edit, role, text, turn, None if kind is None else FAULTS[kind // 4] or None))
            yield out

    prepared(turns.sparkSession)
    spec = {n: pa.int64() if n in ("conv_id", "n", "turn") else pa.string() for n in ("conv_id", "n", "edit", "role", "text", "turn", "fault")}
    return _mapped(_dealt(turns, turns, min_bits), numbered, spec)


class _Report:
    """Counts and digests of one conversation, fed edit by edit."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.audit, self.sha, self.lines = conv_id, [], hashlib.sha256(), 0
        self.faults, self.illegal, self.cost, self.last = [0] * 4, 0, 0, None
        self.turns: tuple | None = None

    def add(self, edit: str, role: str, text: str, turn: int | None, kind: int | None) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1
        self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit]
        if kind is None:
            return
        fault, initial = divmod(kind, 4)
        self.faults[fault] += 1
        self.cost += TRUNCATED if fault == 1 and edit != "D" else 0
        self.illegal += self.last is not None and (self.last, initial) not in _LEGAL
        self.last = initial
        if turn is not None:
            low, high, n = self.turns or (turn, turn, 1)
            self.turns = low, turn, n + (turn != high)

    def row(self) -> tuple:
        low, high, n = self.turns or (0, 0, 1)
        gaps = min(high - low + 1 - n, (1 << 63) - 1)
        _, truncated, blank, duplicate = self.faults
        return (
            self.conv_id, gaps, blank, duplicate, truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()
        )


def report(turns: DataFrame, ids: DataFrame, min_bits: int = MIN_BITS) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for each of ``ids(conv_id)``.

    The same walk as `edits`, folded while it streams by: counts of faulty rows, of turn numbers that are missing, and of
    neighbours whose roles may not meet; the least cost, the initials of its edits, and a digest of `role:text` lines. A
    conversation without rows has zeros and empty strings. Rows of ``turns`` are as there; all conv_ids should be in ``ids``.
    """

    def folded(walked: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        now = None
        for rows in walked:
            out = []
            for conv_id, edit, *rest in rows:
                if edit is None:
                    out += [now.row()] if now else []
                    now = _Report(conv_id)
                else:
                    now.add(edit, *rest)
            yield out
        yield [now.row()] if now else []

    prepared(turns.sparkSession)
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    spec = {n: pa.int64() for n in names} | {"audit": pa.string(), "repaired_sha256": pa.string()}
    return _mapped(_dealt(turns, ids, min_bits), folded, spec)
