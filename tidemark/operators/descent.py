"""Iterative fits that leave a training log: mini-batch descent over many machines.

Samples are dealt into a fixed number of shards, each in a hashed order. In an epoch every shard starts
from the same weights and takes one step per mini-batch of its own; the shards' weights are then averaged
by their samples, and the validation loss of the mean is measured. Fits end when that loss has not
improved for a while, and keep the weights that were best.

Neighbouring windows share all their rows but one, so samples are checkpointed as runs of windows, a row
of values stored once. An epoch cuts the windows of a range of places from the runs, deals them to the
shards, and drops them before it goes on to the next range: windows that lie on disk take a fixed multiple
of the room of the runs. Where all fit at once they are dealt once, for all epochs.

A shard's range is dealt in pieces, consecutive ranges of its order, so that no task sorts more than a
piece. Jobs read the pieces in order, one of every shard at a time, and each hands its shards' weights
on to the next. What reaches the driver is one row of weights per shard and piece; results do not
depend on executors, ranges or pieces, only on the number of shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager, nullcontext
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.session import materialise, pinned, released

#: Fixed values of Adam: decay of both running means, and what keeps its quotient finite.
ADAM = (0.9, 0.999, 1e-7)
#: Samples of a shard that one task sorts, about.
PIECE_ROWS = 1 << 19
#: Bytes of samples in one stored row.
BLOCK_BYTES = 256 << 10
#: Sorted samples that a task reads at a time.
READ_ROWS = 1 << 12
#: Bytes of windows that a task cuts before it deals them.
DEALT_BYTES = 32 << 20
#: Windows on disk at a time take at most so many times the bytes of the runs, or so many bytes.
RUNS_ROOM, LEAST_ROOM = 2, 512 << 20


@dataclass(frozen=True)
class Descent:
    """How to fit: ``loss`` is mse or log_cosh, ``optimiser`` sgd or adam."""

    loss: str = "log_cosh"
    optimiser: str = "adam"
    rate: float = 0.001
    batch: int = 32
    epochs: int = 100
    patience: int = 15
    shards: int = 16


@dataclass
class Weights:
    """Weights (inputs + 1, targets), the intercept last, and the optimiser's means and steps."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    steps: int = 0

    @classmethod
    def zeros(cls, inputs: int, targets: int) -> Weights:
        return cls(*(np.zeros((inputs + 1, targets)) for _ in range(3)))

    def moved(self, gradient: np.ndarray, how: Descent) -> Weights:
        if how.optimiser == "sgd":
            return replace(self, w=self.w - how.rate * gradient, steps=self.steps + 1)
        b1, b2, tiny = ADAM
        t = self.steps + 1
        m, v = b1 * self.m + (1 - b1) * gradient, b2 * self.v + (1 - b2) * gradient**2
        step = how.rate * (m / (1 - b1**t)) / (np.sqrt(v / (1 - b2**t)) + tiny)
        return Weights(self.w - step, m, v, t)


def losses(error: np.ndarray, loss: str) -> np.ndarray:
    """Each error's loss."""
    if loss == "mse":
        return error**2
    size = np.abs(error)
    return size + np.log1p(np.exp(-2 * size)) - np.log(2.0)


def slopes(error: np.ndarray, loss: str) -> np.ndarray:
    return 2 * error if loss == "mse" else np.tanh(error)


def _sums(error: np.ndarray, loss: str) -> np.ndarray:
    """The samples' losses and squared errors, added up."""
    return np.array([losses(error, loss).mean(axis=1).sum(), (error**2).mean(axis=1).sum()])


class _Pass:
    """One shard's epoch, fed with samples in order: rows of inputs, a one and targets."""

    def __init__(self, start: Weights, how: Descent):
        self.start, self.now, self.how = start, start, how
        self.left = np.zeros((0, sum(start.w.shape)))
        self.n = 0
        self.sums = np.zeros(2)

    def add(self, rows: np.ndarray) -> None:
        rows = np.vstack([self.left, rows]) if len(self.left) else rows
        self.left = rows[self._steps(rows, len(rows) - len(rows) % self.how.batch) :]

    def _steps(self, rows: np.ndarray, stop: int) -> int:
        k = len(self.start.w)
        errors = np.empty((stop, rows.shape[1] - k))
        for lo in range(0, stop, self.how.batch):
            hi = min(lo + self.how.batch, stop)
            x = rows[lo:hi, :k]
            error = x @ self.now.w - rows[lo:hi, k:]
            errors[lo:hi] = error
            self.now = self.now.moved(x.T @ slopes(error, self.how.loss) / error.size, self.how)
        self.n += stop
        self.sums += _sums(errors, self.how.loss)
        return stop

    def done(self) -> _Pass:
        if len(self.left):
            self.left = self.left[self._steps(self.left, len(self.left)) :]
        return self

    def state(self) -> tuple:
        """Count, sums, weights, and the samples that wait for a whole batch."""
        weights = np.concatenate([s.ravel() for s in (self.now.w, self.now.m, self.now.v)])
        return self.n, self.now.steps, self.sums.tolist(), weights, self.left.ravel()

    @classmethod
    def resumed(cls, start: Weights, how: Descent, row: Row) -> _Pass:
        out = cls(start, how)
        out.now = Weights(*np.reshape(row.state, (3, *start.w.shape)), steps=row.steps)
        out.left = np.reshape(row.left, (-1, sum(start.w.shape)))
        out.n, out.sums = row.n, np.array(row.sums)
        return out


_RUNS = "inputs int, targets int, width int, n int, held int, bytes long, values binary, y binary, place binary, shard binary, marks binary"
#: What a sample's mark says: its window shares no row with the one before; it is held out.
FRESH, HELD_OUT = 1, 2


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples as runs of windows. A window that continues the one before adds its last row of values, another all rows."""
    for b in batches:
        for c in ("x", "y"):
            values = b.column(c).flatten()
            if values.null_count:
                # A row is left out if there are more nulls up to its end than up to its start.
                nulls = np.append(0, values.is_null().to_numpy(zero_copy_only=False).cumsum())
                ends = np.append(0, pc.list_value_length(b.column(c)).to_numpy().cumsum())
                b = b.filter(pa.array(np.diff(nulls[ends]) == 0))
        if not b.num_rows:
            continue
        x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("x", "y"))
        k, span = x.shape[1], max(1, b.column("span")[0].as_py())
        width = k // span if k % span == 0 else k
        place, shard = (b.column(c).to_numpy() for c in ("place", "shard"))
        held = b.column("is_validation").to_numpy(zero_copy_only=False).astype(bool)
        fresh = np.ones(len(x), bool)
        if width < k:
            # Equal to the bit, so that the windows come back as they were.
            bits = np.ascontiguousarray(x).view(np.int64)
            fresh[1:] = (bits[1:, :-width] != bits[:-1, width:]).any(axis=1)
        blocks, step = [], max(1, BLOCK_BYTES // ((width + y.shape[1]) * 8 + 13))
        for lo in range(0, len(x), step):
            some, new = x[lo : lo + step], fresh[lo : lo + step]
            new[0] = True
            ends = np.where(new, k, width).cumsum()
            values = np.empty(ends[-1])
            values[ends[:, None] + np.arange(-width, 0)] = some[:, -width:]
            values[ends[new, None] + np.arange(-k, 0)] = some[new]
            out = held[lo : lo + step]
            marks = (new * FRESH + out * HELD_OUT).astype(np.uint8)
            parts = values, y[lo : lo + step], place[lo : lo + step], shard[lo : lo + step], marks
            parts = [np.ascontiguousarray(p).tobytes() for p in parts]
            blocks.append((k, y.shape[1], width, len(some), int(out.sum()), sum(map(len, parts)), *parts))
        ints = [pa.int32()] * 5 + [pa.int64()]
        columns = zip(zip(*blocks, strict=True), [*ints, *[pa.binary()] * 5], strict=True)
        names = [c.split()[0] for c in _RUNS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)


def _stored(samples: DataFrame, shards: int) -> DataFrame:
    """The samples without a null as checkpointed runs of windows, with the shards and places that they are dealt by."""
    rows = samples.select(
        F.flatten("X").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"), F.size("X").alias("span"),
        F.pmod(F.xxhash64("series_id", "dt"), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64(F.lit(1), "series_id", "dt").alias("place"), F.coalesce("is_validation", F.lit(True)).alias("is_validation"),
    )
    whole = F.col("x").isNotNull() & F.col("y").isNotNull()
    return materialise(rows.filter(whole).mapInArrow(_runs, _RUNS), keep_shuffles=False)


class _Block:
    """A stored row of runs."""

    def __init__(self, b: pa.RecordBatch, i: int):
        raw = lambda c, kind: np.frombuffer(b.column(c)[i].as_buffer(), kind)
        self.k, targets, width = (b.column(c)[i].as_py() for c in ("inputs", "targets", "width"))
        self.place, self.shard, marks = raw("place", np.int64), raw("shard", np.int32), raw("marks", np.uint8)
        self.y = raw("y", np.float64).reshape(-1, targets)
        self.held_out = marks & HELD_OUT != 0
        self.first = np.where(marks & FRESH, self.k, width).cumsum() - self.k
        self.values = raw("values", np.float64)

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        """Inputs, a one and targets of samples."""
        out = np.empty((len(wanted), self.k + 1 + self.y.shape[1]))
        out[:, : self.k] = np.lib.stride_tricks.sliding_window_view(self.values, self.k)[self.first[wanted]]
        out[:, self.k] = 1
        out[:, self.k + 1 :] = self.y[wanted]
        return out


def _blocks(b: pa.RecordBatch) -> Iterator[_Block]:
    return (_Block(b, i) for i in range(b.num_rows))


def _sharded(samples: DataFrame, shards: int, pieces: int, some: range | None = None, held_out: bool = True) -> DataFrame:
    """Samples, or runs of them, dealt into shards and pieces: piece ``some[i]`` of shard ``s`` is partition ``i * shards + s``.
    They come unsorted, in blocks of rows of doubles (inputs, a one, targets), with their places."""
    stored = samples if "marks" in samples.columns else _stored(samples, shards)
    some = range(pieces) if some is None else some

    def cut(held: list, k: int, targets: int) -> pa.RecordBatch:
        rows, place, part = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(part, kind="stable")
        step = max(1, BLOCK_BYTES // rows[0].nbytes)
        together = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
        blocks = [at[lo : lo + step] for at in together for lo in range(0, len(at), step)]
        ints = [[part[at[0]] for at in blocks], [k] * len(blocks), [targets] * len(blocks)]
        raw = [[c[at].tobytes() for at in blocks] for c in (place, rows)]
        arrays = [*(pa.array(c, pa.int32()) for c in ints), *(pa.array(c, pa.binary()) for c in raw)]
        return pa.RecordBatch.from_arrays(arrays, ["part", "inputs", "targets", "place", "block"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shape = [], 0, ()
        for b in batches:
            for block in _blocks(b):
                # Equal ranges of a hash hold about as many samples; 2^32 of them, counted up from the smallest place.
                piece = ((block.place >> 32) + (1 << 31)) * pieces >> 32
                wanted = (piece >= some.start) & (piece < some.stop)
                at = np.flatnonzero(wanted if held_out else wanted & ~block.held_out)
                if len(at):
                    held.append((block.rows(at), block.place[at], (piece[at] - some.start) * shards + block.shard[at]))
                    size, shape = size + held[-1][0].nbytes, (block.k, block.y.shape[1])
                if size >= DEALT_BYTES:
                    yield cut(held, *shape)
                    held, size = [], 0
        if held:
            yield cut(held, *shape)

    dealt = stored.mapInArrow(deal, "part int, inputs int, targets int, place binary, block binary")
    return dealt.repartitionById(shards * len(some), "part")


@contextmanager
def _dealt(stored: DataFrame, how: Descent, pieces: int, some: range) -> Iterator[DataFrame]:
    """The training samples of some pieces, on disk until the block ends."""
    rows = pinned(_sharded(stored, how.shards, pieces, some, held_out=False))
    try:
        yield rows
    finally:
        released(rows)


_SPEC = "shard int, n long, steps long, sums array<double>, state array<double>, left array<double>"
_FIELDS = ("shard", "n", "steps", "sums", "state", "left")


def _order(place: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples by their places, those of one place by their values, however they came."""
    order = np.argsort(place, kind="stable")
    same = np.diff(place[order]) == 0
    if same.any():
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        at = order[tied]
        order[tied] = at[np.lexsort((*rows[at].T[::-1], place[at]))]
    return order


def _piece(rows: DataFrame, i: int, start: Weights, how: Descent, before: dict[int, Row]) -> list[Row]:
    """The next piece of every shard, from where the one before ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place, flat = None, bytearray(), bytearray()
        for b in batches:
            for j in range(b.num_rows):
                shard = b.column("part")[j].as_py() % how.shards
                place += b.column("place")[j].as_buffer()
                flat += b.column("block")[j].as_buffer()
        if shard is None:
            return
        rows = np.frombuffer(flat).reshape(-1, sum(start.w.shape))
        order = _order(np.frombuffer(place, np.int64), rows)
        work = _Pass.resumed(start, how, before[shard]) if shard in before else _Pass(start, how)
        for lo in range(0, len(order), READ_ROWS):
            work.add(rows[order[lo : lo + READ_ROWS]])
        cols = [pa.array([v], t) for v, t in zip((shard, *work.state()), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, list(_FIELDS))

    wide = pa.list_(pa.float64())
    kinds = [pa.int32(), pa.int64(), pa.int64(), wide, wide, wide]
    # Only the tasks of this piece run.
    wanted = range(i * how.shards, (i + 1) * how.shards)
    return rows.sparkSession.sparkContext.runJob(rows.mapInArrow(run, _SPEC).rdd, list, list(wanted))


def _ended(found: dict[int, Row], start: Weights, how: Descent) -> list[Row]:
    """One row a shard: its samples, sums of losses, and the weights it ends with; its last samples may fall short of a batch."""
    ends = [(s, *_Pass.resumed(start, how, found[s]).done().state()) for s in sorted(found)]
    return [Row(*_FIELDS)(*end) for end in ends]


def _held_out(stored: DataFrame, w: np.ndarray, loss: str) -> list[float | None]:
    """Mean loss and squared error of the held-out samples."""
    k = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(2)
        for b in batches:
            for block in _blocks(b):
                rows = block.rows(np.flatnonzero(block.held_out))
                n, sums = n + len(rows), sums + _sums(rows[:, :k] @ w - rows[:, k:], loss)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()])], ["n", "sums"])

    found = stored.filter("held > 0").mapInArrow(run, "n long, sums array<double>").collect()
    return (np.sum([r.sums for r in found], axis=0) / sum(r.n for r in found)).tolist() if found else [None, None]


def averaged(found: list, start: Weights) -> Weights:
    """The shards' weights and optimiser means, averaged by their training samples."""
    found = [r for r in found if r.n]
    if not found:
        return start
    share = np.array([r.n for r in found], float)
    state = np.average([r.state for r in found], axis=0, weights=share).reshape(3, *start.w.shape)
    return Weights(*state, steps=max(r.steps for r in found))


@dataclass
class Fit:
    """A fit's log, one row an epoch, and the weights of its best epoch."""

    log: list[tuple] = field(default_factory=list)
    best: Weights | None = None
    best_epoch: int = -1
    stopped: bool = False


def fit_epochs(samples: DataFrame, how: Descent = Descent(), features: int | None = None) -> Fit:
    """Fits a linear readout of the windows by mini-batch descent, from zero weights.

    ``samples(series_id, dt, X, y, is_validation, ...)`` pool all series; null windows and samples with a
    null are left out. The fit ends after ``epochs``, or when the validation loss has not fallen for
    ``patience`` epochs; without validation samples it watches the training loss. Its log has
    ``(epoch, loss, mse, val_loss, val_mse)``, training losses being means over the epoch's batches and
    validation losses those of the weights the epoch ends with. Equal losses are no improvement.
    """
    stored = _stored(samples, how.shards)
    size = stored.agg(
        F.sum(F.col("n") - F.col("held")).alias("n"), F.sum("bytes").alias("bytes"),
        F.max("inputs").alias("x"), F.max("targets").alias("y"),
    ).first()
    out = Fit()
    if not size.n:
        return out
    room = max(RUNS_ROOM * size.bytes, LEAST_ROOM)
    ranges = -(-size.n * (size.x + size.y + 2) * 8 // room)
    pieces = max(ranges, -(-size.n // (how.shards * PIECE_ROWS)))
    some = [range(i * pieces // ranges, (i + 1) * pieces // ranges) for i in range(ranges)]
    state, best_loss = Weights.zeros(size.x, size.y), np.inf
    with ExitStack() as kept:
        whole = kept.enter_context(_dealt(stored, how, pieces, some[0])) if ranges == 1 else None
        for epoch in range(how.epochs):
            found: dict[int, Row] = {}
            for part in some:
                with _dealt(stored, how, pieces, part) if whole is None else nullcontext(whole) as rows:
                    for i in range(len(part)):
                        found |= {r.shard: r for r in _piece(rows, i, state, how, found)}
            ends = _ended(found, state, how)
            train = (np.sum([r.sums for r in ends], axis=0) / sum(r.n for r in ends)).tolist()
            state = averaged(ends, state)
            val = _held_out(stored, state.w, how.loss)
            out.log.append((epoch, *train, *val))
            watched = train[0] if val[0] is None else val[0]
            if watched < best_loss:
                best_loss, out.best, out.best_epoch = watched, state, epoch
            if epoch - out.best_epoch >= how.patience:
                out.stopped = True
                break
    return out


def log_table(spark, fits: dict[str, Fit], series_id: str = "all") -> DataFrame:
    """Logs of named fits as a training log table: ``series_id, model, epoch, loss, mse, val_loss, val_mse``."""
    rows = [(series_id, name, *row) for name, f in fits.items() for row in f.log]
    schema = "series_id string, model string, epoch int, loss double, mse double, val_loss double, val_mse double"
    return spark.createDataFrame(rows, schema)


def model_table(spark, fit: Fit) -> DataFrame:
    """The best weights as a one-row model for :func:`gram.score` without keys."""
    w = fit.best.w
    return spark.createDataFrame([(w[:-1].T.tolist(), w[-1].tolist())], "coef array<array<double>>, intercept array<double>")
