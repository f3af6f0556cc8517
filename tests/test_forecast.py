import datetime as dt

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from tests.helpers import bars_of, close_to, ordered, random_bars, to_spark
from tidemark.config import REGISTRY, ForecastSpec
from tidemark.operators import forecast as fo
from tidemark.operators import scaling as sc
from tidemark.operators import sequences as sq
from tidemark.operators import tuning as tu
from tidemark.sources import load_model, load_or_fit, save_model

def _exact():
    return LinearRegression(regParam=0.0, solver="normal")


def _ar(n, a, b, x0=1.0):
    out = [x0]
    for _ in range(n - 1):
        out.append(a + b * out[-1])
    return out


def test_ar1_recovers_its_coefficients(spark):
    bars = bars_of(spark, {"p": _ar(60, 2.0, 0.9), "q": _ar(60, -1.0, 0.8, 30.0)})
    got = fo.one_lag_forecasts(bars).filter("model = 'ar1'").collect()
    assert got and all(abs(r.y_true - r.y_pred) < 1e-6 for r in got)


def test_persistence_repeats_the_last_close(spark):
    bars = bars_of(spark, {"a": [float(i) for i in range(20)]})
    got = fo.one_lag_forecasts(bars, (1, 2)).filter("model = 'naive'").collect()
    assert {(r.horizon, r.y_true - r.y_pred) for r in got} == {(1, 1.0), (2, 2.0)}


def test_test_rows_do_not_look_into_training_unless_warm(spark):
    bars = bars_of(spark, {"a": [float(i) for i in range(20)]})
    cold = fo.one_lag_forecasts(bars, (2,)).filter("model = 'naive'")
    warm = fo.one_lag_forecasts(bars, (2,), warm_start=True).filter("model = 'naive'")
    assert (cold.count(), warm.count()) == (2, 4)
    assert cold.agg(F.min("dt")).first()[0] == dt.date(2020, 1, 1) + dt.timedelta(days=18)


def test_lag_window_model_recovers_a_known_process(spark):
    rng = np.random.default_rng(0)
    series = {}
    for s in "abc":
        x = [1.0, 2.0]
        for _ in range(200):
            x.append(0.5 + 0.6 * x[-1] - 0.3 * x[-2] + rng.normal(0, 0.5))
        series[s] = [round(v, 6) for v in x]
    bars = bars_of(spark, series)
    samples = sq.sequences(bars, 2, 1, 1, close_only=True)
    noise_free = samples.withColumn("y", F.array(0.5 + 0.6 * F.col("X")[1][0] - 0.3 * F.col("X")[0][0]))
    model = fo.fit_forecaster(noise_free, 1, _exact())[0].stages[-1]
    close_to(model.coefficients.toArray(), [-0.3, 0.6], 1e-6)
    assert model.intercept == pytest.approx(0.5, abs=1e-6)


def test_two_step_scores_each_horizon_on_its_own_date(spark):
    bars = bars_of(spark, {"a": [float(i) for i in range(50)], "b": [float(3 * i) for i in range(50)]})
    spec = ForecastSpec("two", 7, 2, 4)
    est = LinearRegression(regParam=1e-9, solver="normal")
    out = fo.train_and_score(bars, spec, estimator=est)
    rows = out.collect()
    assert {r.horizon for r in rows} == {1, 2} and {r.model for r in rows} == {"two"}
    # ten test rows: starts at rows 47..48, so 2 samples per series
    assert len(rows) == 2 * 2 * 2
    truth = {(r.series_id, r.dt): r.close for r in bars.collect()}
    assert all(abs(truth[(r.series_id, r.dt)] - r.y_true) < 1e-9 for r in rows)
    assert max(abs(r.y_true - r.y_pred) for r in rows) < 1e-2
    warm = fo.train_and_score(bars, spec, estimator=est, warm_start=True)
    assert warm.filter("series_id = 'a' and horizon = 1").count() == 9


def test_given_parameters_equal_fitted_ones(spark):
    bars = to_spark(spark, random_bars(6, {"a": 120, "b": 90}))
    spec = ForecastSpec("s", 5, 1, 3)
    own = ordered(fo.train_and_score(bars, spec))
    given = ordered(fo.train_and_score(bars, spec, sc.fit_minmax(bars)))
    close_to(own["y_pred"], given["y_pred"], 1e-6)


def test_estimator_is_a_parameter(spark):
    bars = to_spark(spark, random_bars(6, {"a": 80}))
    out = fo.train_and_score(bars, ForecastSpec("gbt", 3, 1, 2), estimator=GBTRegressor(maxIter=2, maxDepth=2, seed=1))
    assert out.count() == 16 - 3


def test_live_forecast_continues_a_line(spark):
    bars = bars_of(spark, {"a": [float(10 + i) for i in range(60)], "short": [1.0, 2.0]})
    spec = ForecastSpec("two", 7, 2, 4)
    params = sc.fit_minmax(bars)
    est = LinearRegression(regParam=1e-9, solver="normal")
    models = fo.fit_forecaster(sq.spec_sequences(sc.scale(bars, params), spec), 2, est)
    got = ordered(fo.live_forecast(bars, params, models, spec), "horizon")
    assert got["series_id"].tolist() == ["a", "a"]
    close_to(got["forecast"], [70.0, 71.0], 1e-3)
    close_to(got["change"], [(70 - 69) / 69 * 100, (71 - 69) / 69 * 100], 1e-3)


def test_models_are_stored_and_not_refitted(spark, tmp_path):
    bars = to_spark(spark, random_bars(6, {"a": 60}))
    samples = sq.sequences(sc.fit_scale(bars), 3, 1, 2)
    path, fits = str(tmp_path / "model"), []

    def fit():
        fits.append(1)
        return fo.fit_forecaster(samples, 1)[0]

    first = load_or_fit(path, fit)
    save_model(first, path)
    again = load_or_fit(path, fit)
    assert len(fits) == 1
    close_to(again.stages[-1].coefficients.toArray(), load_model(path).stages[-1].coefficients.toArray())
    scored = fo.score(samples, [again], "m").count()
    assert scored == 57


def _samples(spark, n=240, inputs=3, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, 2, inputs))
    y = x.reshape(n, -1) @ rng.normal(size=(2 * inputs, 2)) + rng.normal(0, 0.1, (n, 2))
    rows = [("a", i + 1, n, x[i].tolist(), y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, sample long, samples long, X array<array<double>>, y array<double>")


def _counted(df):
    """The same rows, and how many of them all jobs together have read."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_normal_equations_read_the_samples_once_for_all_horizons(spark, share):
    df = _samples(spark)
    lr = LinearRegression(regParam=1e-3, elasticNetParam=share, tol=1e-12, solver="normal")
    rows, seen = _counted(df)
    models = fo.fit_forecaster(rows, 2, lr)
    assert seen.value == 240
    for h, model in enumerate(models):
        want = lr.fit(sq.with_features(df).withColumn("label", F.col("y")[h]))
        close_to(model.stages[0].coefficients.toArray(), want.coefficients.toArray(), 1e-8)
        close_to(np.array([model.stages[0].intercept]), np.array([want.intercept]), 1e-8)


def test_stand_ins_of_flat_and_single_samples(spark):
    df = _samples(spark, 5).withColumn("X", F.transform("X", lambda r: F.transform(r, lambda v: v * 0 + 2)))
    flat = df.withColumn("y", F.array(F.lit(1.5))).withColumn("k", F.when(F.col("sample") < 5, 0).otherwise(1))
    got = {r.k: r for r in fo.moment_samples(flat, ("k",)).collect()}
    assert {k: (r.weight, r.y, r.features.toArray().tolist()) for k, r in got.items()} == {
        0: (4.0, [1.5], [2.0] * 6), 1: (1.0, [1.5], [2.0] * 6),
    }


def test_other_estimators_pass_over_the_samples(spark):
    for lr in (LinearRegression(solver="l-bfgs"), LinearRegression(loss="huber"), LinearRegression(weightCol="w")):
        assert not fo.solves_normal_equations(lr)


def test_grid_and_sweep_read_a_windows_rows_once(spark, monkeypatch):
    df = _samples(spark)
    rows, seen = _counted(df)
    scores = tu.cross_validated_grid(rows, (1e-6, 1e-2), (0.0, 0.5))[0].collect()
    assert seen.value == 240
    ready = sq.contiguous_folds(sq.with_features(df)).withColumn("label", F.col("y")[0])
    for r in scores:
        lr, errors = LinearRegression(maxIter=20, tol=1e-6, regParam=r.param_reg, elasticNetParam=r.param_elastic_net), []
        for fold in range(2):
            scored = lr.fit(ready.filter(F.col("fold") != fold)).transform(ready.filter(F.col("fold") == fold))
            errors.append(scored.agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0])
        assert r.mean_test_score == pytest.approx(-np.mean(errors), rel=1e-6)
    reads = []

    def counted_sequences(*args, **options):
        out, seen = _counted(sq.sequences(*args, **options))
        reads.append(seen)
        return out

    scaled = sc.fit_scale(to_spark(spark, random_bars(4, {"a": 60, "b": 45})))
    monkeypatch.setattr(tu, "sequences", counted_sequences)
    got = {r.inputs: r.val_loss for r in tu.sweep_lookbacks(scaled, (2, 3)).collect()}
    assert [s.value for s in reads] == [sum(r.n - k for r in scaled.groupBy("series_id").agg(F.count("dt").alias("n")).collect()) for k in (2, 3)]
    monkeypatch.setattr(tu, "solves_normal_equations", lambda estimator: False)
    want = {r.inputs: r.val_loss for r in tu.sweep_lookbacks(scaled, (2, 3)).collect()}
    assert got == pytest.approx(want, rel=1e-8)
