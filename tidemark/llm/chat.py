"""Chat formatting by columnar byte assembly, and reading the formatted text back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import utf8

#: What stands before and after the text of a turn, by role. Other roles are written out.
TEMPLATE = {
    "system": ("<<SYS>> ", " <</SYS>>"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s> ", " </s>"),
}
OTHER = ("<<ROLE>> ", " <<SAYS>> ", " <</ROLE>>")
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<<SAYS>>", "<</ROLE>>")
TRAINED_ROLE = "assistant"

_CONTROL = "|".join(map(re.escape, CONTROLS))
_ESCAPE = re.compile(rf"(\\*)({_CONTROL})".encode())
_UNESCAPE = re.compile(rf"\\(\\*)({_CONTROL})".encode())
_TURN = re.compile(
    b"|".join(
        rb"%s(?P<%s>.*?)%s" % (re.escape(a.encode()), role.encode(), re.escape(b.encode()))
        for role, (a, b) in TEMPLATE.items()
    )
    + rb"|%s(?P<role>.*?)%s(?P<other>.*?)%s" % tuple(re.escape(x.encode()) for x in OTHER),
    re.DOTALL,
)


def escape(text: bytes) -> bytes:
    """One backslash more before every control string. The closing ones of the template follow a space, no backslash."""
    return _ESCAPE.sub(rb"\\\1\2", text) if b"<" in text or b"[" in text else text


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1\2", text) if b"\\" in text else text


def assemble(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Interleave string columns into one buffer: row after row, in a row column after column.

    A column is its bytes and its offsets (rows + 1). Returns the bytes, the offsets of the rows, and for each column
    where its strings start.
    """
    lengths = np.array([np.diff(offsets) for _, offsets in parts])
    ends = np.cumsum(lengths.T.ravel()).reshape(lengths.T.shape)
    starts = ends - lengths.T
    rows = np.concatenate([[0], ends[:, -1]]) if len(ends) else np.zeros(1, np.int64)
    out = np.empty(int(rows[-1]), np.uint8)
    for column, (data, offsets) in enumerate(parts):
        n = lengths[column]
        # Where each byte goes: its own place, moved by as much as its string is moved.
        to = np.repeat(starts[:, column] - offsets[:-1], n) + np.arange(offsets[0], offsets[-1])
        out[to] = data[offsets[0] : offsets[-1]]
    return out, rows, [starts[:, c] for c in range(len(parts))]


def _column(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(strings) + 1, np.int64)
    np.cumsum([len(s) for s in strings], out=offsets[1:])
    return np.frombuffer(b"".join(strings), np.uint8), offsets


def _headers(roles: list[bytes | None]) -> tuple[list[bytes], list[bytes]]:
    before, after = [], []
    known = {role.encode(): (a.encode(), b.encode()) for role, (a, b) in TEMPLATE.items()}
    for role in roles:
        role = role or b""
        a, b = known.get(role) or (OTHER[0].encode() + escape(role) + OTHER[1].encode(), OTHER[2].encode())
        before.append(a)
        after.append(b)
    return before, after


def formatted(turns: DataFrame) -> DataFrame:
    """``(conv_id, segment, text, loss array<struct<start int, bytes int>>)`` from ``turns(conv_id, turn, role, text, ...)``.

    A conversation is the concatenation of its segments in order of ``segment``; most have one. ``loss`` marks the bytes
    of a segment that are trained on: the texts of assistant turns. Rows are sorted over the whole table, so a
    conversation of any length is shared out among tasks, and each batch is written into one buffer.

    Turns go by turn (null first), then role and text. Null text and null role count as empty; an empty or unknown role
    is written out. Rows with a null conv_id form one conversation. Repeated rows are repeated turns. Other columns are
    not read. An empty table gives an empty result.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for number, b in enumerate(batches):
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py() if part is None else part
            ids, roles = b.column("conv_id").to_pylist(), utf8(b.column("role"))
            texts = [escape(t) if t else b"" for t in utf8(b.column("text"))]
            before, after = _headers(roles)
            content = _column(texts)
            data, rows, starts = assemble([_column(before), content, _column(after)])
            first = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            offsets = rows[first]
            loss, sizes = [], np.diff(content[1]).tolist()
            for lo, hi, base in zip(first, first[1:], offsets.tolist(), strict=False):
                at = starts[1][lo:hi].tolist()
                loss.append(
                    [{"start": at[i - lo] - base, "bytes": sizes[i]} for i in range(lo, hi) if roles[i] == TRAINED_ROLE.encode()]
                )
            made = [
                pa.array([ids[i] for i in first[:-1]], pa.int64()),
                pa.array([(part << 32) + number] * (len(first) - 1), pa.int64()),
                pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)),
                pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("bytes", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(made, ["conv_id", "segment", "text", "loss"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "role", "text", F.spark_partition_id().cast("long").alias("part"))
    return dealt.mapInArrow(write, "conv_id long, segment long, text string, loss array<struct<start:int,bytes:int>>")


def parse(text: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of a formatted segment."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn starts at byte {at}")
        at = m.end()
        role = m.lastgroup
        if role == "other":
            out.append((unescape(m["role"]), unescape(m["other"])))
        else:
            out.append((role.encode(), unescape(m[role])))
    return out


class _Digest:
    """Digests of one conversation, fed segment by segment; the text itself is not kept."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: bytes, marks: list[dict]) -> None:
        for role, said in parse(text):
            self.turns += 1
            self.all.update(b"%s\n%s\n" % (role, said))
        for m in marks:
            said = unescape(text[m["start"] : m["start"] + m["bytes"]])
            self.loss_chars += len(said.decode())
            self.loss.update(said)
        self.chars += len(text.decode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(segments: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from `formatted`.

    A digest needs a conversation's segments in order; they stream through a task, which keeps hash states only.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for b in batches:
            done = []
            marks = b.column("loss").to_pylist()
            for conv_id, text, loss in zip(b.column("conv_id").to_pylist(), utf8(b.column("text")), marks, strict=True):
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now else []
                    now = _Digest(conv_id)
                now.add(text, loss)
            if done:
                yield batch(done)
        if now:
            yield batch([now.row()])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
