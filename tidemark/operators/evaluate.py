"""Forecast evaluation over ``series_id, dt, model, horizon, y_true, y_pred``.

Plain statistics are partial aggregates per (series, model, horizon). Statistics that compare
a row with its group (bands, bins) join the aggregate back instead of buffering the group in
a window, so one large group is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import (
    BAND_Z,
    CORRIDOR,
    CURVE_POINTS,
    CURVE_SIGMAS,
    GOOD_FIT_MAPE,
    HISTOGRAM_BINS,
    ROLLING_ERROR_SPAN,
)
from tidemark.functions import corrected_kurtosis, corrected_skewness, log_cosh, relative_error
from tidemark.operators.scaling import to_scaled
from tidemark.plans import PLAIN, Layout, over_series, rolling_moments

KEYS = ("series_id", "model", "horizon")


def error() -> Column:
    """Truth minus forecast."""
    return F.col("y_true") - F.col("y_pred")



def _by_group(layout: Layout) -> Layout:
    return layout.keyed(*KEYS)


def metrics(fc: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """MSE, RMSE and MAPE (percent)."""
    mse = F.avg(error() * error())
    return fc.groupBy(*keys).agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (F.avg(relative_error(F.col("y_true"), F.col("y_pred"))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    )


def mean_log_cosh(fc: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return fc.groupBy(*keys).agg(F.avg(log_cosh(error())).alias("log_cosh"))


def residuals(fc: DataFrame) -> DataFrame:
    """Adds ``residual`` = truth - forecast."""
    return fc.withColumn("residual", error())


def residual_bias(fc: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean residual and the one-sigma levels (population deviation) around zero."""
    sigma = F.stddev_pop(error())
    return fc.groupBy(*keys).agg(
        F.avg(error()).alias("bias"), sigma.alias("sigma"), (-sigma).alias("minus_sigma")
    )


def extremes(fc: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Largest overshoot; last truth, forecast, error and its side; peak absolute error with
    its first date and the forecast there."""
    out = fc.groupBy(*keys).agg(
        F.max(-error()).alias("max_overshoot"),
        F.max_by("y_true", "dt").alias("last_true"),
        F.max_by("y_pred", "dt").alias("last_pred"),
        F.max(F.abs(error())).alias("peak_error"),
        F.min_by(F.struct("dt", "y_pred"), F.struct(-F.abs(error()), F.col("dt"))).alias("_peak"),
    )
    last = F.col("last_true") - F.col("last_pred")
    return out.withColumns(
        {
            "last_error": last,
            "last_side": F.when(last > 0, F.lit("under")).otherwise(F.lit("over")),
            "peak_date": F.col("_peak.dt"),
            "peak_pred": F.col("_peak.y_pred"),
        }
    ).drop("_peak")


def hit_bands(
    fc: DataFrame, bands: tuple[float, ...] = (1.0, 5.0), keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Percent of forecasts whose error is strictly within each band (percent of the truth)."""
    off = F.abs(F.try_divide(error(), F.col("y_true"))) * 100
    shares = [
        (F.avg(F.coalesce((off < b), F.lit(False)).cast("double")) * 100).alias(f"within_{b:g}pct")
        for b in bands
    ]
    return fc.groupBy(*keys).agg(*shares)


def directional_accuracy(fc: DataFrame, layout: Layout = PLAIN) -> DataFrame:
    """Percent of steps on which truth and forecast move the same way."""

    def steps(df: DataFrame, w) -> DataFrame:
        up_true = F.signum(F.col("y_true") - F.lag("y_true").over(w))
        up_pred = F.signum(F.col("y_pred") - F.lag("y_pred").over(w))
        return df.withColumn("_same", (up_true == up_pred).cast("double"))

    return (
        over_series(fc, steps, _by_group(layout), before=1)
        .groupBy(*KEYS)
        .agg((F.avg("_same") * 100).alias("directional_accuracy"))
    )


def rolling_rmse(
    fc: DataFrame, span: int = ROLLING_ERROR_SPAN, layout: Layout = PLAIN
) -> DataFrame:
    """Adds ``rolling_rmse`` over the last ``span`` forecasts, NULL until they exist."""

    grouped = _by_group(layout)

    def compute(df: DataFrame, w) -> DataFrame:
        df = rolling_moments(df.withColumn("_sq", error() * error()), w, "_sq", (span,), grouped)
        full = F.col(f"_n{span}") == span
        df = df.withColumn("rolling_rmse", F.when(full, F.sqrt(F.col(f"_mean{span}"))))
        return df.drop("_sq", *[f"{c}{span}" for c in ("_n", "_mean", "_m2")])

    return over_series(fc, compute, grouped, before=span - 1)


def rolling_rmse_mean(rolled: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return rolled.groupBy(*keys).agg(F.avg("rolling_rmse").alias("mean_rolling_rmse"))


def prediction_band(fc: DataFrame, z: float = BAND_Z, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``lower`` and ``upper``: forecast -/+ z population deviations of the residual."""
    spread = fc.groupBy(*keys).agg(F.stddev_pop(error()).alias("_sd"))
    return (
        fc.join(spread, list(keys))
        .withColumn("lower", F.col("y_pred") - z * F.col("_sd"))
        .withColumn("upper", F.col("y_pred") + z * F.col("_sd"))
        .drop("_sd")
    )


def residual_moments(fc: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis of the residual."""
    return fc.groupBy(*keys).agg(
        corrected_skewness(error()).alias("skewness"), corrected_kurtosis(error()).alias("kurtosis")
    )


def _bin_of(e: Column, bins: int) -> Column:
    width = F.col("_max") - F.col("_min")
    at = F.floor(F.try_divide(e - F.col("_min"), width) * bins)
    # A group of equal values has no width; the histogram convention puts it in one bin.
    return F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(bins // 2)).cast("int")


def residual_histogram(
    fc: DataFrame, bins: int = HISTOGRAM_BINS, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Equal-width bins on [min, max] per group, empty ones included."""
    e = fc.select(*keys, error().alias("_e"))
    ends = e.groupBy(*keys).agg(F.min("_e").alias("_min"), F.max("_e").alias("_max"))
    counted = (
        e.join(ends, list(keys))
        .withColumn("bin", _bin_of(F.col("_e"), bins))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    flat = F.col("_max") == F.col("_min")
    start = F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min"))
    step = F.when(flat, F.lit(1.0)).otherwise(F.col("_max") - F.col("_min")) / bins
    return frame.join(counted, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (start + F.col("bin") * step).alias("bin_start"),
        (start + (F.col("bin") + 1) * step).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def normal_curve(
    fc: DataFrame,
    points: int = CURVE_POINTS,
    sigmas: float = CURVE_SIGMAS,
    bins: int = HISTOGRAM_BINS,
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Normal density fitted to the residual over mean -/+ ``sigmas`` deviations, scaled to the
    histogram's counts."""
    fit = fc.groupBy(*keys).agg(
        F.avg(error()).alias("mu"),
        F.stddev_pop(error()).alias("sigma"),
        F.count(F.lit(1)).alias("_n"),
        (F.max(error()) - F.min(error())).alias("_range"),
    )
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    x = F.col("mu") + F.col("sigma") * (-sigmas + F.col("point") * (2 * sigmas / (points - 1)))
    z = F.try_divide(F.col("x") - F.col("mu"), F.col("sigma"))
    density = F.try_divide(F.exp(-0.5 * z * z), F.col("sigma") * F.sqrt(2 * F.pi()))
    return (
        fit.withColumn("point", steps)
        .withColumn("x", x)
        .withColumn("density", density * F.col("_n") * F.col("_range") / bins)
        .select(*keys, "point", "x", "density")
    )


def corridor(fc: DataFrame, share: float = CORRIDOR) -> DataFrame:
    """Adds ``floor`` and ``ceiling``: the truth -/+ a share of itself, and ``inside``."""
    return (
        fc.withColumn("floor", F.col("y_true") * (1 - share))
        .withColumn("ceiling", F.col("y_true") * (1 + share))
        .withColumn("inside", F.col("y_pred").between(F.col("floor"), F.col("ceiling")))
    )


def common_dates(fc: DataFrame) -> DataFrame:
    """Forecasts on dates every model of the series and horizon covers.

    Models with longer windows start later; comparing them needs the same days.
    """
    group = ["series_id", "horizon"]
    expected = fc.groupBy(*group).agg(F.count_distinct("model").alias("_all"))
    # One row per model and day, so counting a day's rows counts its models.
    same_day = Window.partitionBy(*group, "dt")
    counted = fc.withColumn("_here", F.count(F.lit(1)).over(same_day))
    return counted.join(expected, group).filter("_here = _all").drop("_here", "_all")


def scorecard(
    fc: DataFrame, keys: tuple[str, ...] = ("series_id", "horizon"), digits: int = 6
) -> DataFrame:
    """One row per model: metrics rounded to ``digits``, RMSE rank, best / worst marks, fit label, and the
    ratio of the worst RMSE to the best. Sort by ``mape`` for display.

    The windows run over the few scorecard rows of a group, not over forecasts.
    """
    rounded = metrics(fc, (*keys, "model")).select(
        *keys, "model", *[F.round(c, digits).alias(c) for c in ("mse", "rmse", "mape")]
    )
    group = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, "rmse"))
    rank = F.rank().over(group.orderBy("rmse"))
    marks = {}
    for c in ("mse", "rmse", "mape"):
        marks[f"{c}_is_min"] = F.col(c) == F.min(c).over(group)
        marks[f"{c}_is_max"] = F.col(c) == F.max(c).over(group)
    return (
        rounded.withColumn("rmse_rank", F.floor(rank + (ties - 1) / 2).cast("int"))
        .withColumns(marks)
        .withColumn("worst_over_best", F.try_divide(F.max("rmse").over(group), F.min("rmse").over(group)))
        .withColumn("fit", F.when(F.col("mape") > GOOD_FIT_MAPE, F.lit("trend only")).otherwise(F.lit("close")))
    )


def best_and_worst(card: DataFrame, keys: tuple[str, ...] = ("series_id", "horizon")) -> DataFrame:
    """Model names with the lowest and highest RMSE and their rows' metrics."""
    row = F.struct("model", "mse", "rmse", "mape")
    return (
        card.groupBy(*keys)
        .agg(
            F.min_by(row, F.struct("rmse", "model")).alias("best"),
            F.max_by(row, F.struct("rmse", "model")).alias("worst"),
        )
        .select(
            *keys,
            *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("best", "worst") for c in ("model", "rmse", "mape")],
        )
        .withColumn("worst_over_best", F.try_divide(F.col("worst_rmse"), F.col("best_rmse")))
    )


def sorted_by_mape(card: DataFrame) -> DataFrame:
    return card.orderBy("mape")


def scaled_mse(fc: DataFrame, params: DataFrame, keys: tuple[str, ...] = ("model", "horizon")) -> DataFrame:
    """Test MSE per model in the scaled space of the close, rounded to 8 decimals."""
    scaled = fc.join(params.select("series_id", "close_scale", "close_offset"), "series_id")
    e = to_scaled(F.col("y_true"), "close") - to_scaled(F.col("y_pred"), "close")
    return scaled.groupBy(*keys).agg(F.round(F.avg(e * e), 8).alias("mse"))
