"""Per-series min-max scaling and the chronological train / test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TRAIN_RATIO
from tidemark.plans import PLAIN, Layout, number_rows
from tidemark.schema import FEATURES


def chronological_split(
    bars: DataFrame, ratio: float = TRAIN_RATIO, layout: Layout = PLAIN
) -> DataFrame:
    """Adds position ``rn``, length ``n``, ``split_at`` (training rows) and ``is_train``.

    The boundary is the half-even rounding of ``n * ratio``.
    """
    return (
        number_rows(bars, layout)
        .withColumn("split_at", F.bround(F.col("n") * F.lit(ratio)).cast("bigint"))
        .withColumn("is_train", F.col("rn") <= F.col("split_at"))
    )


def split_summary(split: DataFrame) -> DataFrame:
    """Per series: first test date, training and test row counts."""
    return split.groupBy("series_id").agg(
        F.min(F.when(~F.col("is_train"), F.col("dt"))).alias("split_date"),
        F.count_if("is_train").alias("n_train"),
        F.count_if(~F.col("is_train")).alias("n_test"),
    )


def fit_minmax(
    bars: DataFrame,
    features: tuple[str, ...] = FEATURES,
    *,
    fit_on: str = "all",
    ratio: float = TRAIN_RATIO,
    layout: Layout = PLAIN,
) -> DataFrame:
    """One row per series with ``<f>_min, <f>_max, <f>_scale, <f>_offset`` for each feature.

    ``fit_on="all"`` uses every row; ``"train"`` only the training rows, so that nothing of
    the test period leaks into the scale. A constant column gets scale 1, so it maps to 0.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    if fit_on == "train":
        bars = chronological_split(bars, ratio, layout).filter("is_train")
    ranges = bars.groupBy("series_id").agg(
        *[F.min(f).alias(f"{f}_min") for f in features],
        *[F.max(f).alias(f"{f}_max") for f in features],
    )
    return _add_scale(ranges, features)


def _add_scale(ranges: DataFrame, features: tuple[str, ...]) -> DataFrame:
    spread = {f: F.col(f"{f}_max") - F.col(f"{f}_min") for f in features}
    scale = {f: 1 / F.when(spread[f] == 0, F.lit(1.0)).otherwise(spread[f]) for f in features}
    return ranges.withColumns({f"{f}_scale": scale[f] for f in features}).withColumns(
        {f"{f}_offset": -F.col(f"{f}_min") * F.col(f"{f}_scale") for f in features}
    )


def fit_scale(
    bars: DataFrame,
    features: tuple[str, ...] = FEATURES,
    *,
    fit_on: str = "all",
    ratio: float = TRAIN_RATIO,
    keep: tuple[str, ...] = (),
    layout: Layout = PLAIN,
) -> DataFrame:
    """:func:`fit_minmax` and :func:`scale` in one step.

    In the plain layout the ranges are a window over the series: the input is computed once,
    nothing is joined, and later windows over the series need no further shuffle. In the
    chunked layout the parameters are aggregated and joined back. ``keep`` names features
    whose ``<f>_scale`` and ``<f>_offset`` stay on the rows.
    """
    extra = [f"{f}_{part}" for f in keep for part in ("scale", "offset")]
    if layout.chunked:
        params = fit_minmax(bars, features, fit_on=fit_on, ratio=ratio, layout=layout)
        return scale(bars, params, features, keep=keep)
    source = chronological_split(bars, ratio, layout) if fit_on == "train" else bars
    used = {f: F.when(F.col("is_train"), F.col(f)) if fit_on == "train" else F.col(f) for f in features}
    w = Window.partitionBy(*layout.keys)
    ranged = source.withColumns(
        {f"{f}_min": F.min(used[f]).over(w) for f in features}
        | {f"{f}_max": F.max(used[f]).over(w) for f in features}
    )
    scaled = _add_scale(ranged, features).withColumns({f: to_scaled(F.col(f), f) for f in features})
    return scaled.select(*bars.columns, *extra)


def params_by_feature(params: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The scaling parameters in long form, one row per (series, feature)."""
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"{f}_min").alias("data_min"),
            F.col(f"{f}_max").alias("data_max"),
            F.col(f"{f}_scale").alias("scale"),
            F.col(f"{f}_offset").alias("offset"),
        )
        for f in features
    ]
    return params.select("series_id", F.inline(F.array(*rows)))


def to_scaled(value: Column, feature: str) -> Column:
    return value * F.col(f"{feature}_scale") + F.col(f"{feature}_offset")


def from_scaled(value: Column, feature: str) -> Column:
    return (value - F.col(f"{feature}_offset")) / F.col(f"{feature}_scale")


def _with_params(df: DataFrame, params: DataFrame, features: tuple[str, ...]) -> DataFrame:
    # No broadcast hint: there is one parameter row per series, so the table grows with the
    # data. Spark broadcasts it below its size threshold and otherwise joins on the series,
    # splitting a hot one.
    names = [f"{f}_{part}" for f in features for part in ("scale", "offset")]
    return df.join(params.select("series_id", *names), "series_id")


def scale(
    bars: DataFrame,
    params: DataFrame,
    features: tuple[str, ...] = FEATURES,
    *,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Features mapped to their scaled space by given parameters; other columns are kept."""
    extra = [f"{f}_{part}" for f in keep for part in ("scale", "offset")]
    joined = _with_params(bars, params, features)
    return joined.withColumns({f: to_scaled(F.col(f), f) for f in features}).select(
        *bars.columns, *extra
    )


def unscale(
    df: DataFrame, params: DataFrame, columns: dict[str, str] | tuple[str, ...] = FEATURES
) -> DataFrame:
    """Inverse of :func:`scale`. ``columns`` maps a column to the feature whose scale it is in."""
    if not isinstance(columns, dict):
        columns = {c: c for c in columns}
    features = tuple(dict.fromkeys(columns.values()))
    joined = _with_params(df, params, features)
    return joined.withColumns(
        {c: from_scaled(F.col(c), f) for c, f in columns.items()}
    ).select(*df.columns)
