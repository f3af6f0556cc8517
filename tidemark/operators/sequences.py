"""Sliding input windows with multi-step targets, and splits of the samples."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import GRID_FOLDS, VALIDATION_RATIO, ForecastSpec
from tidemark.plans import PLAIN, Layout, number_rows, over_series
from tidemark.schema import FEATURES


def input_features(n_features: int, close_only: bool = False) -> tuple[str, ...]:
    """The first ``n_features`` features, or just the close."""
    return ("close",) if close_only else FEATURES[:n_features]


def sequences(
    bars: DataFrame,
    n_inputs: int = 10,
    n_predictions: int = 1,
    n_features: int = len(FEATURES),
    *,
    close_only: bool = False,
    single_precision: bool = False,
    keep: tuple[str, ...] = (),
    layout: Layout = PLAIN,
) -> DataFrame:
    """One sample per row that has ``n_inputs`` rows before it and ``n_predictions`` targets.

    Columns: ``series_id``, ``dt`` (first target's date), ``X`` (n_inputs x features), ``y``
    and ``y_dt`` (targets and their dates), ``sample`` (1-based), ``samples`` and the columns
    named in ``keep``. A series of n rows yields ``n - n_predictions + 1 - n_inputs`` samples.
    """
    feats = input_features(n_features, close_only)
    # Only what the windows hold travels through the shuffle.
    narrow = bars.select("series_id", "dt", *dict.fromkeys((*feats, "close", *keep)))
    numbered = number_rows(narrow, layout)

    def cut(df: DataFrame, w) -> DataFrame:
        # The row is built once; every lag then shares it instead of building its own.
        df = df.withColumn("_row", F.array(*feats))
        past = [F.lag("_row", i).over(w) for i in range(n_inputs, 0, -1)]
        ahead = lambda c: [F.col(c), *[F.lead(c, i).over(w) for i in range(1, n_predictions)]]
        return df.select(
            *df.columns,
            F.array(*past).alias("X", metadata={"shape": [n_inputs, len(feats)]}),
            F.array(*ahead("close")).alias("y"),
            F.array(*ahead("dt")).alias("y_dt"),
        )

    windows = over_series(numbered, cut, layout, before=n_inputs, after=n_predictions - 1)
    out = windows.withColumns(
        {
            "sample": F.col("rn") - n_inputs,
            "samples": F.col("n") - n_predictions + 1 - n_inputs,
        }
    ).filter((F.col("sample") >= 1) & (F.col("sample") <= F.col("samples")))
    if single_precision:
        out = out.withColumns(
            {"X": F.col("X").cast("array<array<float>>"), "y": F.col("y").cast("array<float>")}
        )
    return out.select("series_id", "dt", "X", "y", "y_dt", "sample", "samples", *keep)


def spec_sequences(
    bars: DataFrame, spec: ForecastSpec, layout: Layout = PLAIN, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The samples a registered forecaster needs."""
    return sequences(
        bars,
        spec.n_inputs,
        spec.n_predictions,
        spec.n_features,
        close_only=spec.close_only,
        keep=keep,
        layout=layout,
    )


def prepared_tables(
    scaled: DataFrame, specs: list[ForecastSpec], layout: Layout = PLAIN
) -> dict[tuple, DataFrame]:
    """One sample table per distinct window shape; specs of the same shape share it."""
    out: dict[tuple, DataFrame] = {}
    for s in specs:
        shape = (s.n_inputs, s.n_predictions, s.n_features, s.close_only)
        if shape not in out:
            out[shape] = spec_sequences(scaled, s, layout)
    return out


def with_features(seq: DataFrame) -> DataFrame:
    """Adds ``features``: the input window as one Spark ML vector.

    Its size is declared in the column's metadata when the window shape is known; an estimator
    would otherwise run a job of its own to look at one row.
    """
    shape = seq.schema["X"].metadata.get("shape")
    vector = array_to_vector(F.flatten("X"))
    if shape is None:
        return seq.withColumn("features", vector)
    size = {"ml_attr": {"num_attrs": shape[0] * shape[1]}}
    return seq.select("*", vector.alias("features", metadata=size))


def tail_validation(seq: DataFrame, ratio: float = VALIDATION_RATIO) -> DataFrame:
    """Adds ``is_validation``: the last ``ratio`` of each series' samples."""
    kept = F.floor(F.col("samples") * F.lit(1.0 - ratio))
    return seq.withColumn("is_validation", F.col("sample") > kept)


def contiguous_folds(seq: DataFrame, k: int = GRID_FOLDS) -> DataFrame:
    """Adds ``fold`` in [0, k): unshuffled equal blocks, the first ``samples % k`` one longer.

    Computed from the sample's position, so it needs no further window or shuffle.
    """
    at, size, extra = F.col("sample") - 1, F.floor(F.col("samples") / k), F.col("samples") % k
    head = extra * (size + 1)
    fold = F.when(at < head, F.floor(at / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(at - head, size))
    )
    return seq.withColumn("fold", fold.cast("int"))


def latest_window(
    bars: DataFrame, n_inputs: int = 7, n_features: int = len(FEATURES)
) -> DataFrame:
    """The last ``n_inputs`` rows of each series as one input window, oldest first.

    The rank filter is applied before the shuffle too, so only ``n_inputs`` rows per series
    and task move. Series that are too short have no window.
    """
    newest = Window.partitionBy("series_id").orderBy(F.desc("dt"))
    row = F.struct("dt", F.array(*FEATURES[:n_features]).alias("x"))
    return (
        bars.withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= n_inputs)
        .groupBy("series_id")
        .agg(F.sort_array(F.collect_list(row)).alias("_rows"), F.max("dt").alias("dt"))
        .filter(F.size("_rows") == n_inputs)
        .select("series_id", "dt", F.col("_rows.x").alias("X"))
    )
