"""Least squares from Gram matrices: one regression per series, fold or whole table, from one pass.

What a linear fit needs of its samples is their count, their means and the centred products of
inputs and targets. These moments merge: two sets of samples give the moments of their union
exactly as rows would, without cancellation. So every task reduces its rows to one small row per
group, groups merge after one narrow shuffle, and all that follows (fits, penalties, folds, held-out
errors) is arithmetic on those rows, in batches of equal-sized matrices.

A sample is the flattened input window and its targets, ``z``; moments are ``n``, ``mean`` and ``m2``,
the upper triangle of the centred product, row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemark.config import GRID_FOLDS, TRAIN_RATIO, ForecastSpec
from tidemark.operators.scaling import chronological_split, fit_scale, from_scaled
from tidemark.operators.sequences import contiguous_folds, spec_sequences
from tidemark.plans import PLAIN, Layout

#: Groups whose moments a task keeps open; with more, it writes out what it has and merging does the rest.
MAX_OPEN = 512
#: Bytes of square matrices that a task makes of its moments at a time; a fit needs about ten times as many.
WORK_BYTES = 8 << 20

State = tuple[int, np.ndarray, np.ndarray]


def merge(a: State | None, b: State) -> State:
    """Moments of the union of two sets of samples (n, mean, centred products)."""
    if a is None or not a[0]:
        return b
    if not b[0]:
        return a
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * (b[0] / n))


def _moments(z: np.ndarray) -> State:
    mean = z.mean(axis=0)
    centred = z - mean
    return len(z), mean, centred.T @ centred


def _upper(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def _square(m2: np.ndarray) -> np.ndarray:
    """Full matrices (groups, d, d) from upper triangles (groups, d (d + 1) / 2)."""
    d = int((np.sqrt(8 * m2.shape[1] + 1) - 1) / 2)
    i, j = _upper(d)
    out = np.empty((len(m2), d, d))
    out[:, i, j] = m2
    out[:, j, i] = m2
    return out


def _key_fields(df: DataFrame, by: Sequence[str]) -> list[StructField]:
    return [df.schema[c] for c in by]


def _moment_schema(df: DataFrame, by: Sequence[str]) -> StructType:
    wide = ArrayType(DoubleType())
    return StructType([*_key_fields(df, by), StructField("n", LongType()), StructField("mean", wide), StructField("m2", wide)])


def _rows_of(open_: dict[tuple, State], by: Sequence[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    keys = list(open_)
    cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)]
    states = list(open_.values())
    wide = pa.list_(pa.float64())
    cols += [
        pa.array([s[0] for s in states], pa.int64()),
        pa.array([s[1] for s in states], wide),
        pa.array([s[2][_upper(len(s[1]))] for s in states], wide),
    ]
    return pa.RecordBatch.from_arrays(cols, [*by, "n", "mean", "m2"])


def _groups(batch: pa.RecordBatch, by: Sequence[str]) -> list[tuple[tuple, np.ndarray]]:
    """Row numbers of each different key of a batch."""
    if not by:
        return [((), np.arange(batch.num_rows))]
    code = np.zeros(batch.num_rows, np.int64)
    for c in by:
        part = batch.column(c).dictionary_encode(null_encoding="encode")
        code = code * len(part.dictionary) + part.indices.to_numpy()
        code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    values = [batch.column(c) for c in by]
    return [(tuple(v[int(rows[0])].as_py() for v in values), rows) for rows in np.split(order, cuts)]


def _folded(
    by: Sequence[str], kinds: list[pa.DataType], read: Callable[[pa.RecordBatch, np.ndarray], State | None]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows reduced to one state per group, or to several if too many groups are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, State] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, rows in _groups(batch, by):
                state = read(batch, rows)
                if state is not None:
                    open_[key] = merge(open_.get(key), state)
                if len(open_) > MAX_OPEN:
                    # Rows come sorted where they can, so most of these groups are complete.
                    yield _rows_of(open_, by, kinds)
                    open_ = {}
        if open_:
            yield _rows_of(open_, by, kinds)

    return run


def gram(samples: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """``(*by, n, mean, m2)``: the moments of ``samples(*by, X, y, ...)`` per group.

    ``X`` is the input window (rows x features), ``y`` the targets. Samples with a missing or
    non-finite value do not count; groups without any give no row. Without ``by`` all samples are
    one group. One pass and one shuffle, of a row per group and task; a group may hold any share
    of the samples.
    """
    narrow = samples.select(*by, F.concat(F.flatten("X"), "y").cast("array<double>").alias("z"))
    schema = _moment_schema(narrow, by)
    kinds = _arrow_kinds(narrow, by)

    def read(batch: pa.RecordBatch, rows: np.ndarray) -> State | None:
        part = batch.column("z").take(pa.array(rows))
        part = part.filter(part.is_valid())
        if not len(part):
            return None
        z = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
        z = z[np.isfinite(z).all(axis=1)]
        return _moments(z) if len(z) else None

    return merged(narrow.mapInArrow(_folded(by, kinds, read), schema), by)


def _arrow_kinds(df: DataFrame, by: Sequence[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in _key_fields(df, by)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of moments cut so that the matrices of each fit ``WORK_BYTES``, however many rows Spark puts in one."""
    for batch in batches:
        if batch.num_rows:
            # The longest triangle of the batch, doubled, is about its largest matrix.
            ends = batch.column("m2").offsets.to_numpy()
            size = 16 * max(1, int(np.diff(ends).max()))
            step = max(1, WORK_BYTES // size)
            for lo in range(0, batch.num_rows, step):
                yield batch.slice(lo, step)


def _states(batch: pa.RecordBatch) -> Iterator[State]:
    for n, mean, m2 in zip(batch.column("n").to_pylist(), batch.column("mean"), batch.column("m2"), strict=True):
        full = _square(m2.values.to_numpy()[None])[0]
        yield n, mean.values.to_numpy(), full


def merged(moments: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Moments of several parts of a group as one row. Parts are merged in a fixed order, so that a
    rerun gives the same digits."""
    schema = _moment_schema(moments, by)
    kinds = _arrow_kinds(moments, by)

    def read(batch: pa.RecordBatch, rows: np.ndarray) -> State | None:
        state = None
        for part in _states(batch.take(pa.array(rows))):
            state = merge(state, part)
        return state

    dealt = moments.select(*schema.names)
    dealt = dealt.repartition(*[F.col(c) for c in by]) if by else dealt.repartition(1)
    return dealt.sortWithinPartitions(*by, "n", "mean").mapInArrow(_one_per_group(by, kinds, read), schema)


def _one_per_group(by, kinds, read):
    """As `_folded`, for rows sorted by group: a group is written once, when the next one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in _slices(batches):
            done: dict[tuple, State] = {}
            found = sorted(_groups(batch, by), key=lambda g: g[1][0])
            for now, rows in found:
                if state is not None and now != key:
                    done[key] = state
                    state = None
                key, state = now, merge(state, read(batch, rows))
            if done:
                yield _rows_of(done, by, kinds)
        if state is not None:
            yield _rows_of({key: state}, by, kinds)

    return run


# --- fits on batches of moments --------------------------------------------------------------


class Problem:
    """Standardised normal equations of several groups with the same shape.

    Inputs without variance have coefficient 0. Penalties follow Spark ML's linear regression:
    they act on standardised inputs, and their strength is divided by the target's deviation.
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, m2: np.ndarray, n_targets: int):
        k = m2.shape[1] - n_targets
        cov = m2 / n[:, None, None]
        self.mean_x, self.mean_y = mean[:, :k], mean[:, k:]
        var = np.einsum("gii->gi", cov)
        # What rounding leaves of a constant column is no variance.
        flat = var[:, :k] <= 1e-20 * (1 + self.mean_x**2)
        self.flat = flat
        self.sd_x = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var[:, :k])))
        sd_y = np.sqrt(np.maximum(var[:, k:], 0))
        self.sd_y = np.where(sd_y > 0, sd_y, 1.0)
        live = (~flat).astype(float)
        self.r = cov[:, :k, :k] / (self.sd_x[:, :, None] * self.sd_x[:, None, :]) * (live[:, :, None] * live[:, None, :])
        self.c = cov[:, :k, k:] / (self.sd_x[:, :, None] * self.sd_y[:, None, :]) * live[:, :, None]

    def ridge(self, penalty: float) -> np.ndarray:
        """Standardised coefficients (groups, inputs, targets) of an L2 penalty, by Cholesky.

        Without a penalty, groups whose inputs are dependent get the solution of least norm.
        """
        out = np.zeros_like(self.c)
        eye = np.eye(self.r.shape[1])
        for t in range(self.c.shape[2]):
            a = self.r + (penalty / self.sd_y[:, t])[:, None, None] * eye + self.flat[:, :, None] * eye
            out[:, :, t] = _solve(a, self.c[:, :, t])
        return out

    def elastic_net(self, penalty: float, share: float, max_iter: int = 10_000, tol: float = 1e-10) -> np.ndarray:
        """Coordinate descent on the correlations of all groups at once; ``share`` is the L1 part."""
        if share == 0.0 or penalty == 0.0:
            return self.ridge(penalty)
        out = np.zeros_like(self.c)
        k = self.r.shape[1]
        rows = np.ascontiguousarray(self.r.transpose(1, 0, 2))  # R is symmetric
        diags = np.ascontiguousarray(np.einsum("gii->ig", self.r))
        for t in range(self.c.shape[2]):
            strength = penalty / self.sd_y[:, t]
            l1, l2 = strength * share, strength * (1 - share)
            divisors = np.where(diags + l2 > 0, diags + l2, 1.0)
            b, slope = np.zeros(self.c.shape[:2]), self.c[:, :, t].copy()  # slope = c - R b
            for _ in range(max_iter):
                moved = 0.0
                for j in range(k):
                    raw = slope[:, j] + diags[j] * b[:, j]
                    new = np.sign(raw) * np.maximum(np.abs(raw) - l1, 0) / divisors[j]
                    step = new - b[:, j]
                    if step.any():
                        slope -= rows[j] * step[:, None]
                        b[:, j] = new
                        moved = max(moved, float(np.abs(step).max()))
                if moved < tol:
                    break
            out[:, :, t] = b
        return out

    def unscaled(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (groups, inputs, targets) and intercepts (groups, targets) in the data's own units."""
        coef = b * self.sd_y[:, None, :] / self.sd_x[:, :, None]
        return coef, self.mean_y - np.einsum("gk,gkt->gt", self.mean_x, coef)


def _solve(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Solutions of symmetric systems. Cholesky's pivots tell which are too close to singular for it; those go by
    eigenvalues, dropping directions that rounding cannot tell from zero."""
    out = np.empty_like(c)
    try:
        low = np.linalg.cholesky(a)
        safe = np.einsum("gii->gi", low).min(axis=1) > 1e-6
    except np.linalg.LinAlgError:
        low, safe = np.zeros_like(a), np.zeros(len(a), bool)
        for g in range(len(a)):
            try:
                low[g] = np.linalg.cholesky(a[g])
                safe[g] = np.diag(low[g]).min() > 1e-6
            except np.linalg.LinAlgError:
                pass
    if safe.any():
        forward = np.linalg.solve(low[safe], c[safe][:, :, None])
        out[safe] = np.linalg.solve(low[safe].transpose(0, 2, 1), forward)[:, :, 0]
    for g in np.flatnonzero(~safe):
        value, vector = np.linalg.eigh(a[g])
        kept = value > 1e-12 * max(float(value[-1]), 1e-300)
        out[g] = vector[:, kept] @ ((vector[:, kept].T @ c[g]) / value[kept])
    return out


def held_out_mse(n: np.ndarray, mean: np.ndarray, m2: np.ndarray, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Mean squared error (groups, targets) of given fits on the samples that the moments stand for."""
    k = coef.shape[1]
    xx, xy = m2[:, :k, :k], m2[:, :k, k:]
    yy = np.einsum("gtt->gt", m2[:, k:, k:])
    centred = yy - 2 * np.einsum("gkt,gkt->gt", coef, xy) + np.einsum("gkt,gkl,glt->gt", coef, xx, coef)
    off = mean[:, k:] - intercept - np.einsum("gk,gkt->gt", mean[:, :k], coef)
    return np.maximum(centred, 0) / n[:, None] + off**2


def _by_size(batch: pa.RecordBatch, n_targets: int | str) -> Iterator[tuple[pa.RecordBatch, int, tuple]]:
    """Rows of a batch with matrices and targets of one size each: the rows, their targets, (n, mean, m2)."""
    sizes = np.array([len(m) for m in batch.column("mean")])
    targets = batch.column(n_targets).to_numpy() if isinstance(n_targets, str) else np.full(len(sizes), n_targets)
    for d, h in sorted(set(zip(sizes.tolist(), targets.tolist(), strict=True))):
        rows = np.flatnonzero((sizes == d) & (targets == h))
        part = batch.take(pa.array(rows))
        mean = part.column("mean").flatten().to_numpy().reshape(len(rows), d)
        m2 = part.column("m2").flatten().to_numpy().reshape(len(rows), -1)
        yield part, h, (part.column("n").to_numpy().astype(float), mean, _square(m2))


_MODEL = "coef array<array<double>>, intercept array<double>"


def fit(moments: DataFrame, n_targets: int | str = 1, penalty: float = 0.0, share: float = 0.0) -> DataFrame:
    """``(keys..., n, coef, intercept)``: a linear fit of each target for each group of moments.

    ``coef`` has one array of input weights per target; ``n_targets`` is their number or a key column
    that holds it. A group needs two samples; with fewer samples than inputs and no penalty the
    weights of least norm are taken.
    """
    by = [c for c in moments.columns if c not in ("n", "mean", "m2")]
    names = [*by, "n", "coef", "intercept"]
    wide = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for part, targets, state in _by_size(batch, n_targets):
                problem = Problem(*state, targets)
                coef, intercept = problem.unscaled(problem.elastic_net(penalty, share))
                made = [pa.array(coef.transpose(0, 2, 1).tolist(), pa.list_(wide)), pa.array(intercept.tolist(), wide)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*by, "n"]), *made], names)

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _key_fields(moments, by))
    return moments.filter("n > 1").mapInArrow(run, f"{keys + ', ' if keys else ''}n long, {_MODEL}")


def stand_ins(moments: DataFrame, n_targets: int = 1) -> DataFrame:
    """``(keys..., x, y, weight)``: a few weighted samples with the same moments as all that the moments stand for.

    Least squares, penalties on standardised inputs and mean squared errors depend on samples through their moments
    alone, so an estimator of that kind gets the same model from these, whatever passes it makes. There is a pair for
    each direction in which the samples spread, at equal distances from the mean, and one at the mean if they do not.
    """
    by = [c for c in moments.columns if c not in ("n", "mean", "m2")]
    names = [*by, "x", "y", "weight"]
    wide = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for i, (n, mean, m2) in enumerate(_states(batch)):
                value, vector = np.linalg.eigh(m2)
                spread = (vector * np.sqrt(np.maximum(value, 0)))[:, value > 0].T
                pairs = len(spread)
                away = spread * np.sqrt(pairs / n)
                z = np.vstack([mean + away, mean - away]) if pairs else mean[None]
                k = len(mean) - n_targets
                keys = [pa.array([batch.column(c)[i].as_py()] * len(z), batch.schema.field(c).type) for c in by]
                made = [pa.array(z[:, :k].tolist(), wide), pa.array(z[:, k:].tolist(), wide), pa.array([n / len(z)] * len(z))]
                yield pa.RecordBatch.from_arrays([*keys, *made], names)

    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in _key_fields(moments, by))
    return moments.mapInArrow(run, f"{keys}x array<double>, y array<double>, weight double")


def predicted(window: Column, coef: Column, intercept: Column) -> Column:
    """A fit's prediction for a window ``X``."""
    terms = F.zip_with(F.flatten(window), coef, lambda x, c: x * c)
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) + intercept


def score(
    samples: DataFrame, models: DataFrame, name: str | Column, by: Sequence[str] = ("series_id",), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Forecasts of every sample by its group's fit, one row per target: the long forecast table.

    ``models`` has one row per group of ``by``; without ``by`` it is the one fit of all samples. Group
    keys and ``keep`` stay in the result.
    """
    keep = (*[c for c in by if c != "series_id"], *keep)
    name = F.lit(name) if isinstance(name, str) else name
    fitted = models.select(*by, "coef", "intercept")
    # A single row with an aggregate's size: the pooled fit.
    joined = samples.join(fitted, list(by)) if by else samples.join(F.broadcast(fitted.limit(1)))
    at = F.posexplode("coef").alias("_h", "_c")
    rows = joined.select("series_id", "X", "y", "y_dt", "intercept", *keep, at)
    return rows.select(
        "series_id",
        *keep,
        F.get("y_dt", "_h").alias("dt"),
        name.alias("model"),
        (F.col("_h") + 1).alias("horizon"),
        F.get("y", "_h").cast("double").alias("y_true"),
        predicted(F.col("X"), F.col("_c"), F.get("intercept", "_h")).alias("y_pred"),
    )


# --- forecasters ---------------------------------------------------------------------------


def split_samples(
    split: DataFrame, spec: ForecastSpec, *, warm_start: bool = False, keep: tuple[str, ...] = (), layout: Layout = PLAIN
) -> DataFrame:
    """Samples of split rows with ``is_train`` (all targets before the split) and ``is_test``
    (inputs after it too; with ``warm_start`` only the targets), cut in one pass over the rows."""
    rows = spec_sequences(split, spec, layout, ("split_at", *keep))
    first = F.col("sample")  # row number of the first input row
    target = first + spec.n_inputs
    return rows.withColumns(
        {
            "is_train": target + (spec.n_predictions - 1) <= F.col("split_at"),
            "is_test": (target if warm_start else first) > F.col("split_at"),
        }
    )


def lag_regression(
    bars: DataFrame,
    spec: ForecastSpec,
    *,
    by: Sequence[str] = ("series_id",),
    penalty: float = 0.0,
    share: float = 0.0,
    ratio: float = TRAIN_RATIO,
    fit_on: str = "all",
    warm_start: bool = False,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Test-period forecasts of a registered window shape, in prices, from a fit per series.

    Every series gets its own weights from its training windows (``by=()`` pools them). Windows are
    cut once, moments merge per series, and forecasts are a join of each test window with its
    series' weights. Series with fewer than two training samples give no forecasts.
    """
    back = ("close_scale", "close_offset")
    scaled = fit_scale(bars, fit_on=fit_on, ratio=ratio, keep=("close",), layout=layout)
    split = chronological_split(scaled, ratio, layout)
    samples = split_samples(split, spec, warm_start=warm_start, keep=back, layout=layout)
    models = fit(gram(samples.filter("is_train"), by), spec.n_predictions, penalty, share)
    scored = score(samples.filter("is_test"), models, spec.key, by, back)
    return scored.withColumns({c: from_scaled(F.col(c), "close") for c in ("y_true", "y_pred")}).drop(*back)


def ar_p(
    bars: DataFrame,
    p: int,
    horizons: int = 1,
    *,
    ratio: float = TRAIN_RATIO,
    warm_start: bool = False,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Test-period forecasts of the close from its ``p`` predecessors, least squares per series."""
    spec = ForecastSpec(f"ar{p}", p, horizons, 1, close_only=True)
    split = chronological_split(bars.select("series_id", "dt", "close"), ratio, layout)
    samples = split_samples(split, spec, warm_start=warm_start, layout=layout)
    return score(samples.filter("is_test"), fit(gram(samples.filter("is_train")), horizons), spec.key)


# --- grid search -----------------------------------------------------------------------------


def grid(
    fold_moments: DataFrame,
    by: Sequence[str] = ("series_id",),
    reg_params: Sequence[float] = (1e-6, 1e-3),
    elastic_net: Sequence[float] = (0.0, 0.5, 1.0),
    n_targets: int = 1,
) -> DataFrame:
    """``(*by, param_reg, param_elastic_net, mean_test_score, is_best, coef, intercept)``: every cell of
    a cross-validated elastic net, and each cell's refit on all folds.

    ``fold_moments(*by, fold, n, mean, m2)`` holds a row per group and fold. The training moments of a
    fold are those of all other folds, merged from both sides, so nothing is subtracted; a held-out
    error is read off the fold's own moments. The score is minus the error, averaged over folds and
    targets; ``is_best`` marks the best cell of a group, the smallest parameters on ties. No job runs
    per cell. Groups with one fold, or a fold or the rest of it with fewer than two samples, give no rows.
    """
    cells = [(float(r), float(e)) for r in reg_params for e in elastic_net]
    by = list(by)
    names = [*by, "param_reg", "param_elastic_net", "mean_test_score", "is_best", "coef", "intercept"]
    kinds = _arrow_kinds(fold_moments, by)
    wide = pa.list_(pa.float64())

    def table(found: list[tuple]) -> pa.RecordBatch:
        types = [*kinds, pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(wide), wide]
        cols = zip(*found, strict=True) if found else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def searched(key: tuple, folds: list[State]) -> list[tuple]:
        def joined(parts: list[State]) -> State:
            out: State | None = None
            for p in parts:
                out = merge(out, p)
            return out

        if len(folds) < 2:
            return []
        rest = [joined([p for j, p in enumerate(folds) if j != i]) for i in range(len(folds))]
        if min(s[0] for s in (*rest, *folds)) < 2:
            return []
        stack = lambda states: (np.array([float(s[0]) for s in states]), *(np.stack([s[i] for s in states]) for i in (1, 2)))
        # The refit is searched along with the folds' fits.
        problem, test = Problem(*stack([*rest, joined(folds)]), n_targets), stack(folds)
        scores, refits = [], []
        for penalty, share in cells:
            coef, intercept = problem.unscaled(problem.elastic_net(penalty, share))
            scores.append(-float(held_out_mse(*test, coef[:-1], intercept[:-1]).mean()))
            refits.append((coef[-1], intercept[-1]))
        best = min(range(len(cells)), key=lambda c: (-scores[c], cells[c]))
        return [
            (*key, *cells[c], scores[c], c == best, refits[c][0].T.tolist(), refits[c][1].tolist()) for c in range(len(cells))
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, folds = None, []
        for batch in _slices(batches):
            found = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            for now, state in zip(keys, _states(batch), strict=True):
                if now != key and folds:
                    found += searched(key, folds)
                    folds = []
                key = now
                folds.append(state)
            if found:
                yield table(found)
        if folds:
            yield table(searched(key, folds))

    dealt = fold_moments.repartition(*[F.col(c) for c in by]) if by else fold_moments.repartition(1)
    dealt = dealt.sortWithinPartitions(*by, "fold").select(*by, "n", "mean", "m2")
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in _key_fields(fold_moments, by))
    spec = f"{keys}param_reg double, param_elastic_net double, mean_test_score double, is_best boolean, {_MODEL}"
    return dealt.mapInArrow(run, spec)


def grid_search(
    samples: DataFrame,
    by: Sequence[str] = ("series_id",),
    reg_params: Sequence[float] = (1e-6, 1e-3),
    elastic_net: Sequence[float] = (0.0, 0.5, 1.0),
    *,
    folds: int = GRID_FOLDS,
    n_targets: int = 1,
) -> DataFrame:
    """Cross-validated grid with contiguous folds over samples, from one pass over them.

    ``by=()`` pools all series, as a single model would be searched. See `grid` for the result.
    """
    dealt = contiguous_folds(samples, folds)
    return grid(gram(dealt, (*by, "fold")), by, reg_params, elastic_net, n_targets)


def refit_forecasts(
    bars: DataFrame,
    spec: ForecastSpec,
    reg_params: Sequence[float] = (1e-6, 1e-3),
    elastic_net: Sequence[float] = (0.0, 0.5, 1.0),
    *,
    by: Sequence[str] = ("series_id",),
    folds: int = GRID_FOLDS,
    ratio: float = TRAIN_RATIO,
    warm_start: bool = False,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Test-period forecasts, in prices, of the grid's best cell after its refit on all training samples.

    The search, the refit and the scores are one job: folds are cut from the training samples' places,
    and the refit's moments are those of all folds together.
    """
    back = ("close_scale", "close_offset")
    scaled = fit_scale(bars, ratio=ratio, keep=("close",), layout=layout)
    split = chronological_split(scaled, ratio, layout)
    samples = split_samples(split, spec, warm_start=warm_start, keep=back, layout=layout)
    train = samples.filter("is_train").withColumn("samples", F.col("split_at") - spec.n_predictions + 1 - spec.n_inputs)
    cells = grid_search(train, by, reg_params, elastic_net, folds=folds, n_targets=spec.n_predictions)
    scored = score(samples.filter("is_test"), cells.filter("is_best"), spec.key, by, back)
    return scored.withColumns({c: from_scaled(F.col(c), "close") for c in ("y_true", "y_pred")}).drop(*back)
