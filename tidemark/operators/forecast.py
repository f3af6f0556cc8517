"""Forecasters over many series: closed-form one-lag models and Spark ML lag-window models.

Every forecaster ends in the same long table:
``series_id, dt, model, horizon, y_true, y_pred`` with ``dt`` the date being predicted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TRAIN_RATIO, ForecastSpec
from tidemark.functions import change_pct
from tidemark.operators.gram import gram, stand_ins
from tidemark.operators.scaling import chronological_split, fit_scale, from_scaled, scale, unscale
from tidemark.operators.sequences import latest_window, spec_sequences, with_features
from tidemark.plans import PLAIN, Layout, over_series
from tidemark.session import materialise


def lag_pairs(
    bars: DataFrame,
    horizons: Sequence[int] = (1,),
    *,
    ratio: float = TRAIN_RATIO,
    warm_start: bool = False,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Adds to the split rows ``x<h>``: the close h rows earlier, from which horizon h is
    predicted. By default a test row does not look back into the training rows, so the first
    h test rows have no input; ``warm_start`` lets it."""
    split = chronological_split(bars.select("series_id", "dt", "close"), ratio, layout)

    def compute(df: DataFrame, w) -> DataFrame:
        out = {}
        for h in horizons:
            past = F.lag("close", h).over(w)
            if not warm_start:
                past = F.when(F.lag("is_train", h).over(w) == F.col("is_train"), past)
            out[f"x{h}"] = past
        return df.withColumns(out)

    return over_series(split, compute, layout, before=max(horizons))


def one_lag_forecasts(
    bars: DataFrame,
    horizons: Sequence[int] = (1,),
    *,
    ratio: float = TRAIN_RATIO,
    warm_start: bool = False,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Test-period forecasts of the persistence (``naive``) and ``ar1`` models.

    ``ar1`` is least squares of the close on the close h rows earlier, fitted per series and
    horizon on the training rows. In the plain layout the fit is a window over the series, so
    the rows are computed once and not joined; chunked, it is an aggregate joined back.
    """
    pairs = lag_pairs(bars, horizons, ratio=ratio, warm_start=warm_start, layout=layout)
    train = F.col("is_train")
    y = F.when(train, F.col("close"))
    fits = {}
    for h in horizons:
        fits[f"_b{h}"] = F.regr_slope(y, F.col(f"x{h}"))
        fits[f"_a{h}"] = F.regr_intercept(y, F.col(f"x{h}"))
    if layout.chunked:
        fitted = pairs.groupBy("series_id").agg(*[c.alias(k) for k, c in fits.items()])
        tests = pairs.filter(~train).join(fitted, "series_id")
    else:
        w = Window.partitionBy(*layout.keys)
        tests = pairs.withColumns({k: c.over(w) for k, c in fits.items()}).filter(~train)
    rows = []
    for h in horizons:
        x = F.col(f"x{h}")
        for model, pred in (("naive", x), ("ar1", F.col(f"_a{h}") + F.col(f"_b{h}") * x)):
            rows.append(
                F.struct(
                    F.lit(model).alias("model"),
                    F.lit(h).alias("horizon"),
                    F.col("close").alias("y_true"),
                    pred.alias("y_pred"),
                )
            )
    return tests.select("series_id", "dt", F.inline(F.array(*rows))).filter(
        F.col("y_pred").isNotNull()
    )


def default_estimator() -> LinearRegression:
    """Deterministic least squares with a trace of ridge against collinear lags."""
    return LinearRegression(regParam=1e-6, solver="normal", standardization=True)


def solves_normal_equations(estimator: Estimator) -> bool:
    """Whether a fit depends on unweighted samples through their moments alone."""
    return (
        type(estimator) is LinearRegression
        and estimator.getLoss() == "squaredError"
        and estimator.getSolver() != "l-bfgs"
        and not estimator.isSet("weightCol")
        and (estimator.getFeaturesCol(), estimator.getLabelCol()) == ("features", "label")
    )


def moment_samples(samples: DataFrame, by: Sequence[str] = (), n_targets: int = 1) -> DataFrame:
    """``(*by, features, y, weight)``: weighted samples that least squares cannot tell from ``samples``, which are
    read once for them."""
    few = materialise(stand_ins(gram(samples, by), n_targets))
    return few.select(*by, array_to_vector("x").alias("features"), "y", "weight")


def fit_horizons(ready: DataFrame, n_predictions: int, estimator: Estimator) -> list[PipelineModel]:
    """One model per horizon from ``ready(features, y)``, weighted where there is a column ``weight``."""
    from pyspark.ml import Pipeline

    kept = ["features"]
    if "weight" in ready.columns:
        estimator = estimator.copy({estimator.weightCol: "weight"})
        kept.append("weight")
    models = []
    for h in range(n_predictions):
        labelled = ready.select(*kept, F.col("y")[h].alias("label"))
        models.append(Pipeline(stages=[estimator.copy()]).fit(labelled))
    return models


def fit_forecaster(
    samples: DataFrame, n_predictions: int = 1, estimator: Estimator | None = None
) -> list[PipelineModel]:
    """One model per horizon (direct multi-step), pooled over all series.

    ``samples`` come from :func:`sequences` on scaled bars. A linear regression by normal equations
    needs their moments only: they are read once for all horizons, samples with a missing value are
    left out, and the fits run on the few weighted samples that have the same moments (so a model's
    training summary counts those). Any other estimator passes over the samples themselves.
    """
    estimator = estimator or default_estimator()
    few = solves_normal_equations(estimator)
    ready = moment_samples(samples, n_targets=n_predictions) if few else with_features(samples)
    return fit_horizons(ready, n_predictions, estimator)


def score(
    samples: DataFrame, models: Sequence[PipelineModel], name: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Scaled-space forecasts of every sample, one row per horizon."""
    scored = with_features(samples).select("series_id", "y", "y_dt", "features", *keep)
    for h, model in enumerate(models):
        # Each horizon's output is renamed before the next model writes its own.
        scored = model.transform(scored).withColumnRenamed("prediction", f"_p{h}")
    rows = [
        F.struct(
            F.col("y_dt")[h].alias("dt"),
            F.lit(name).alias("model"),
            F.lit(h + 1).alias("horizon"),
            F.col("y")[h].cast("double").alias("y_true"),
            F.col(f"_p{h}").alias("y_pred"),
        )
        for h in range(len(models))
    ]
    return scored.select("series_id", *keep, F.inline(F.array(*rows)))


def to_prices(forecasts: DataFrame, params: DataFrame) -> DataFrame:
    """Forecasts back in the price space of the close."""
    return unscale(forecasts, params, {"y_true": "close", "y_pred": "close"})


def test_slice(split: DataFrame, n_inputs: int, warm_start: bool = False) -> DataFrame:
    """Test rows; with ``warm_start`` also the last ``n_inputs`` training rows as run-up."""
    first = F.col("split_at") - (n_inputs if warm_start else 0)
    return split.filter(F.col("rn") > first)


def train_and_score(
    bars: DataFrame,
    spec: ForecastSpec,
    params: DataFrame | None = None,
    *,
    estimator: Estimator | None = None,
    ratio: float = TRAIN_RATIO,
    fit_on: str = "all",
    warm_start: bool = False,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Fits a registered shape on the training rows and forecasts the test rows, in prices.

    Scaling parameters are fitted here unless given. The close's parameters travel with the
    rows, so going back to prices is arithmetic, not a join. An estimator passes over its
    input several times, so the split rows, narrow and not yet cut into windows, are
    checkpointed once instead of being derived from the source on every pass.
    """
    back = ("close_scale", "close_offset")
    if params is None:
        scaled = fit_scale(bars, fit_on=fit_on, ratio=ratio, keep=("close",), layout=layout)
    else:
        scaled = scale(bars, params, keep=("close",))
    split = materialise(chronological_split(scaled, ratio, layout))
    models = fit_forecaster(
        spec_sequences(split.filter("is_train"), spec, layout), spec.n_predictions, estimator
    )
    held_out = test_slice(split, spec.n_inputs, warm_start)
    scored = score(spec_sequences(held_out, spec, layout, back), models, spec.key, back)
    return scored.withColumns(
        {c: from_scaled(F.col(c), "close") for c in ("y_true", "y_pred")}
    ).drop(*back)


def live_forecast(
    bars: DataFrame, params: DataFrame, models: Sequence[PipelineModel], spec: ForecastSpec
) -> DataFrame:
    """Next rows of every series from its latest window: price and percent change against the
    latest close, one row per horizon."""
    windows = latest_window(scale(bars, params), spec.n_inputs, spec.n_features)
    scored = with_features(windows)
    for h, model in enumerate(models):
        scored = model.transform(scored).withColumnRenamed("prediction", f"_p{h}")
    rows = [
        F.struct(F.lit(h + 1).alias("horizon"), F.col(f"_p{h}").alias("forecast"))
        for h in range(len(models))
    ]
    ahead = unscale(
        scored.select("series_id", "dt", F.inline(F.array(*rows))), params, {"forecast": "close"}
    )
    latest = bars.groupBy("series_id").agg(F.max_by("close", "dt").alias("latest_close"))
    return ahead.join(latest, "series_id").withColumn(
        "change", change_pct(F.col("forecast"), F.col("latest_close"))
    )
