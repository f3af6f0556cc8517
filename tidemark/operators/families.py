"""Model families: fixed feature maps of the input window, with a linear readout per series.

A registered window shape also names a family. Recurrent ones run the window through a state that
leaks towards what the newest row drives it to; the convolutional one slides random kernels over
the window and keeps each one's largest response and the share of positive ones. Neither map is
trained: its weights follow from a seed, so any task on any machine applies the same one to whole
batches of windows. What is trained is the readout, ridge least squares on the mapped features
(:mod:`gram`), which sees the newest row too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import REGISTRY, TRAIN_RATIO, ForecastSpec
from tidemark.operators.gram import fit, gram, score
from tidemark.operators.scaling import chronological_split, fit_scale, from_scaled
from tidemark.plans import PLAIN, Layout, over_series
from tidemark.schema import FEATURES

#: Windows that are mapped together.
BATCH = 8192


@dataclass(frozen=True)
class Family:
    """A feature map. ``leaks`` are the slowest and the fastest unit's share of news per row."""

    kind: str  # "state" or "kernels"
    units: int
    leaks: tuple[float, float] = (1.0, 1.0)
    layers: int = 1
    seed: int = 1


# Gated networks keep slow units beside fast ones, plain recurrent ones do not.
FAMILIES = {
    "lstm_exp": Family("state", 32, (0.1, 1.0), seed=11),
    "lstm_grid": Family("state", 48, (0.1, 1.0), seed=12),
    "rnn_single": Family("state", 24, seed=13),
    "rnn_multi": Family("state", 32, seed=14),
    "rnn_grid": Family("state", 48, seed=15),
    "cnn": Family("kernels", 32, seed=16),
    "deep": Family("state", 24, (0.1, 1.0), layers=2, seed=17),
}


@cache
def _state_weights(family: Family, inputs: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(input weights, recurrent weights, leaks) of each layer. Recurrent weights have a spectral radius of 0.9."""
    rng, out = np.random.default_rng([family.seed, inputs]), []
    for _ in range(family.layers):
        into = rng.uniform(-1, 1, (inputs, family.units)) / np.sqrt(inputs)
        within = rng.normal(size=(family.units, family.units))
        within *= 0.9 / np.abs(np.linalg.eigvals(within)).max()
        leaks = np.geomspace(*family.leaks, family.units)
        out.append((into, within, leaks))
        inputs = family.units
    return out


def _states(family: Family, x: np.ndarray) -> np.ndarray:
    """Last states (windows, layers x units) after windows x of (windows, rows, inputs), from rest."""
    weights = _state_weights(family, x.shape[2])
    states = [np.zeros((len(x), family.units)) for _ in weights]
    for t in range(x.shape[1]):
        drive = x[:, t]
        for i, (into, within, leaks) in enumerate(weights):
            states[i] = (1 - leaks) * states[i] + leaks * np.tanh(drive @ into + states[i] @ within)
            drive = states[i]
    return np.hstack(states)


@cache
def _kernels(family: Family, inputs: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dilation, weights (3 x inputs, units), biases) of the kernels of each dilation; weights have mean zero."""
    rng, out = np.random.default_rng([family.seed, inputs]), []
    for dilation, units in ((1, family.units - family.units // 2), (2, family.units // 2)):
        w = rng.normal(size=(3 * inputs, units))
        out.append((dilation, w - w.mean(axis=0), rng.uniform(-0.5, 0.5, units)))
    return out


def _responses(family: Family, x: np.ndarray) -> np.ndarray:
    """Largest response and share of positive ones (windows, 2 x units) of kernels slid over windows."""
    n, rows, inputs = x.shape
    found = []
    for dilation, w, bias in _kernels(family, inputs):
        places = rows - 2 * dilation
        if places < 1:
            found.append(np.zeros((n, 2 * w.shape[1])))
            continue
        cut = np.stack([x[:, i * dilation : i * dilation + places] for i in range(3)], axis=2)
        response = cut.reshape(n, places, 3 * inputs) @ w + bias
        found.append(np.hstack([response.max(axis=1), (response > 0).mean(axis=1)]))
    return np.hstack(found)


def mapped(family: Family, x: np.ndarray) -> np.ndarray:
    """Features of windows (windows, rows, inputs): the family's, then the newest row."""
    made = _states(family, x) if family.kind == "state" else _responses(family, x)
    return np.hstack([made, x[:, -1]])


def with_family_features(samples: DataFrame, spec: str | Column = "spec") -> DataFrame:
    """``samples`` with ``X`` replaced by one row of features of the family that ``spec`` names.

    ``spec`` is a column of registry keys, or one key for all. Samples without a family, or with a
    missing value in the window, keep no window (null X).
    """
    name = F.lit(spec) if isinstance(spec, str) and spec in FAMILIES else (F.col(spec) if isinstance(spec, str) else spec)
    rows = samples.withColumn("X", F.col("X").cast("array<array<double>>")).withColumn("_family", name)
    kept = [c for c in rows.columns if c not in ("X", "_family")]
    wide = pa.list_(pa.list_(pa.float64()))

    def features(names: list, windows: pa.ListArray) -> list:
        out: list = [None] * len(names)
        sizes = windows.value_lengths().fill_null(0).to_numpy()
        shapes: dict[tuple, list[int]] = {}
        for i, (key, n) in enumerate(zip(names, sizes.tolist(), strict=True)):
            if key in FAMILIES and n:
                shapes.setdefault((key, n), []).append(i)
        for (key, n), at in shapes.items():
            rows = windows.take(pa.array(at)).flatten()
            if rows.null_count:
                whole = rows.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n).all(axis=1)
                at = [i for i, w in zip(at, whole.tolist(), strict=True) if w]
                rows = windows.take(pa.array(at, pa.int64())).flatten()
            if not at:
                continue
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(at), n, -1)
            for i, row in zip(at, mapped(FAMILIES[key], x), strict=True):
                out[i] = [row] if np.isfinite(row).all() else None
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                made = pa.array(features(part.column("_family").to_pylist(), part.column("X")), wide)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made], [*kept, "X"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.select(*kept, "X", "_family").mapInArrow(run, f"{fields}, X array<array<double>>")


def shared_samples(
    rows: DataFrame, specs: Sequence[ForecastSpec], keep: tuple[str, ...] = (), layout: Layout = PLAIN
) -> DataFrame:
    """The samples of several window shapes from one window over rows that hold ``rn`` and ``n``.

    One longest window is cut per row and each shape is a slice of it: its newest rows and leading
    features. Columns as `sequences` has them, with ``spec`` (the shape's key) in front; one shuffle,
    whatever the number of shapes.
    """
    longest, ahead = max(s.n_inputs for s in specs), max(s.n_predictions for s in specs)
    narrow = rows.select("series_id", "dt", "rn", "n", *dict.fromkeys((*FEATURES, *keep)))

    def cut(df: DataFrame, w) -> DataFrame:
        df = df.withColumn("_row", F.array(*FEATURES))
        lead = lambda c: [F.col(c), *[F.lead(c, i).over(w) for i in range(1, ahead)]]
        return df.select(
            *df.columns,
            F.array(*[F.lag("_row", i).over(w) for i in range(longest, 0, -1)]).alias("_w"),
            F.array(*lead("close")).alias("_y"),
            F.array(*lead("dt")).alias("_y_dt"),
        )

    windows = over_series(narrow, cut, layout, before=longest, after=ahead - 1)
    close = FEATURES.index("close")

    def shape(s: ForecastSpec) -> Column:
        newest = F.slice("_w", longest - s.n_inputs + 1, s.n_inputs)
        if s.close_only:
            x = F.transform(newest, lambda r: F.array(r[close]))
        else:
            x = newest if s.n_features == len(FEATURES) else F.transform(newest, lambda r: F.slice(r, 1, s.n_features))
        samples = F.col("n") - s.n_predictions + 1 - s.n_inputs
        sample = F.col("rn") - s.n_inputs
        made = F.struct(
            F.lit(s.key).alias("spec"), x.alias("X"), F.slice("_y", 1, s.n_predictions).alias("y"),
            F.slice("_y_dt", 1, s.n_predictions).alias("y_dt"), sample.alias("sample"), samples.alias("samples"),
        )
        return F.when((sample >= 1) & (sample <= samples), made)

    each = F.explode(F.array_compact(F.array(*[shape(s) for s in specs])))
    return windows.select("series_id", "dt", *keep, each.alias("_s")).select("_s.spec", "series_id", "dt", *(
        F.col(f"_s.{c}") for c in ("X", "y", "y_dt", "sample", "samples")
    ), *keep)


def family_forecasts(
    bars: DataFrame,
    specs: Sequence[ForecastSpec] = tuple(REGISTRY.values()),
    *,
    penalty: float = 1e-4,
    ratio: float = TRAIN_RATIO,
    warm_start: bool = False,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Test-period forecasts, in prices, of several registered forecasters, each with its own family.

    All windows come from one pass over the bars; readouts are fitted per series and forecaster from
    merged moments. ``model`` is the registry key; forecasters of several targets have several horizons.
    """
    back = ("close_scale", "close_offset")
    keep = ("split_at", *back)
    split = chronological_split(fit_scale(bars, ratio=ratio, keep=("close",), layout=layout), ratio, layout)
    samples = shared_samples(split, specs, keep, layout)
    inputs = F.create_map(*[F.lit(x) for s in specs for x in (s.key, s.n_inputs)])[F.col("spec")]
    targets = F.size("y")
    first, target = F.col("sample"), F.col("sample") + inputs
    samples = samples.withColumns(
        {
            "n_targets": targets,
            "is_train": target + (targets - 1) <= F.col("split_at"),
            "is_test": (target if warm_start else first) > F.col("split_at"),
        }
    )
    ready = with_family_features(samples.filter("is_train or is_test"))
    by = ("series_id", "spec")
    models = fit(gram(ready.filter("is_train"), (*by, "n_targets")), "n_targets", penalty)
    scored = score(ready.filter("is_test"), models, F.col("spec"), by, back)
    return scored.withColumns({c: from_scaled(F.col(c), "close") for c in ("y_true", "y_pred")}).drop("spec", *back)
