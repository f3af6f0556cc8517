import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tests.helpers import close_to
from tidemark.operators import evaluate as ev

SCHEMA = "series_id string, dt date, model string, horizon int, y_true double, y_pred double"


def _rows(name, truth, pred, model="m", start=dt.date(2020, 1, 1)):
    return [(name, start + dt.timedelta(days=i), model, 1, float(a), float(b)) for i, (a, b) in enumerate(zip(truth, pred))]


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(8)
    data = {}
    for i in range(20):
        n = int(rng.integers(5, 120))
        truth = 50 + rng.normal(0, 5, n).cumsum()
        data[f"g{i:02d}"] = (truth, truth + rng.gamma(2, 2, n) - 3)
    rows = [r for k, (a, b) in data.items() for r in _rows(k, a, b)]
    return data, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def _one(df):
    return {r.series_id: r for r in df.collect()}


def test_errors_and_moments_match_numpy(groups):
    data, fc = groups
    m, lc, mo = _one(ev.metrics(fc)), _one(ev.mean_log_cosh(fc)), _one(ev.residual_moments(fc))
    b, hb, d = _one(ev.residual_bias(fc)), _one(ev.hit_bands(fc)), _one(ev.directional_accuracy(fc))
    for k, (a, p) in data.items():
        e = a - p
        close_to([m[k].mse, m[k].rmse], [np.mean(e**2), np.sqrt(np.mean(e**2))])
        assert m[k].mape == pytest.approx(np.mean(np.abs(e / (np.abs(a) + 1e-8))) * 100)
        assert lc[k].log_cosh == pytest.approx(np.mean(np.log(np.cosh(e))))
        close_to([mo[k].skewness, mo[k].kurtosis], [pd.Series(e).skew(), pd.Series(e).kurt()], 1e-8)
        close_to([b[k].bias, b[k].sigma, b[k].minus_sigma], [e.mean(), e.std(), -e.std()])
        off = np.abs(e / a) * 100
        close_to([hb[k].within_1pct, hb[k].within_5pct], [(off < 1).mean() * 100, (off < 5).mean() * 100])
        same = np.sign(np.diff(a)) == np.sign(np.diff(p))
        assert d[k].directional_accuracy == pytest.approx(same.mean() * 100)


def test_log_cosh_survives_large_errors(spark):
    fc = spark.createDataFrame(_rows("a", [1e6], [0.0]), SCHEMA)
    assert ev.mean_log_cosh(fc).first().log_cosh == pytest.approx(1e6 - np.log(2))


def test_extremes(spark):
    fc = spark.createDataFrame(_rows("a", [10, 10, 10, 10], [12, 5, 15, 11]), SCHEMA)
    r = ev.extremes(fc).first()
    assert (r.max_overshoot, r.last_true, r.last_pred, r.last_error, r.last_side) == (5.0, 10.0, 11.0, -1.0, "over")
    assert (r.peak_error, r.peak_date, r.peak_pred) == (5.0, dt.date(2020, 1, 2), 5.0)  # first of the tie


def test_rolling_rmse_band_and_corridor(groups):
    data, fc = groups
    roll = ev.rolling_rmse(fc).toPandas().sort_values(["series_id", "dt"])
    band = ev.prediction_band(fc).toPandas().sort_values(["series_id", "dt"])
    cor = ev.corridor(fc).toPandas().sort_values(["series_id", "dt"])
    mean = _one(ev.rolling_rmse_mean(ev.rolling_rmse(fc)))
    for k, (a, p) in data.items():
        want = np.sqrt(pd.Series((a - p) ** 2).rolling(30).mean())
        close_to(roll[roll["series_id"] == k]["rolling_rmse"], want, 1e-7)
        close_to([np.nan if mean[k].mean_rolling_rmse is None else mean[k].mean_rolling_rmse], [want.mean()], 1e-7)
        mine = band[band["series_id"] == k]
        close_to(mine["upper"], p + 1.96 * (a - p).std())
        close_to(mine["lower"], p - 1.96 * (a - p).std())
        near = cor[cor["series_id"] == k]
        assert near["inside"].tolist() == ((p >= a * 0.95) & (p <= a * 1.05)).tolist()


def test_histogram_and_curve(groups):
    data, fc = groups
    hist = ev.residual_histogram(fc).toPandas().sort_values(["series_id", "bin"])
    curve = ev.normal_curve(fc).toPandas().sort_values(["series_id", "point"])
    for k, (a, p) in data.items():
        e = a - p
        mine = hist[hist["series_id"] == k]
        counts, edges = np.histogram(e, 40)
        assert mine["n"].sum() == len(e) and len(mine) == 40
        close_to(mine["bin_start"], edges[:-1], 1e-9)
        assert np.abs(mine["n"].to_numpy() - counts).sum() <= 2  # an edge value may sit in either bin
        c = curve[curve["series_id"] == k]
        x = np.linspace(e.mean() - 4 * e.std(), e.mean() + 4 * e.std(), 200)
        y = np.exp(-0.5 * ((x - e.mean()) / e.std()) ** 2) / (e.std() * np.sqrt(2 * np.pi)) * len(e) * (e.max() - e.min()) / 40
        close_to(c["x"], x, 1e-8)
        close_to(c["density"], y, 1e-6)


def test_histogram_of_equal_errors(spark):
    hist = ev.residual_histogram(spark.createDataFrame(_rows("a", [3, 3], [1, 1]), SCHEMA)).collect()
    assert sum(r.n for r in hist) == 2 and len(hist) == 40


def test_scorecard_ranks_marks_and_orders(spark):
    rows = []
    for model, err in (("good", 1.0), ("tie1", 2.0), ("tie2", 2.0), ("bad", 4.0)):
        rows += _rows("s", [100.0] * 3, [100.0 + err] * 3, model)
    fc = spark.createDataFrame(rows, SCHEMA)
    card = {r.model: r for r in ev.scorecard(fc).collect()}
    assert {m: r.rmse_rank for m, r in card.items()} == {"good": 1, "tie1": 2, "tie2": 2, "bad": 4}
    assert card["good"].rmse_is_min and card["bad"].rmse_is_max and not card["tie1"].rmse_is_min
    assert card["bad"].worst_over_best == pytest.approx(4.0)
    assert card["good"].fit == "close" and card["bad"].fit == "trend only"
    assert [r.model for r in ev.sorted_by_mape(ev.scorecard(fc)).collect()][::3] == ["good", "bad"]
    ends = ev.best_and_worst(ev.scorecard(fc)).first()
    assert (ends.best_model, ends.worst_model, ends.worst_over_best) == ("good", "bad", 4.0)


def test_models_are_compared_on_common_dates(spark):
    rows = _rows("s", [1, 2, 3, 4], [1, 2, 3, 4], "long") + _rows("s", [3, 4], [3, 4], "short", dt.date(2020, 1, 3))
    out = ev.common_dates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.model, r.dt.day) for r in out) == [("long", 3), ("long", 4), ("short", 3), ("short", 4)]


def test_scaled_mse(spark):
    fc = spark.createDataFrame(_rows("a", [10, 20], [12, 20]), SCHEMA)
    params = spark.createDataFrame([("a", 0.1, -0.5)], "series_id string, close_scale double, close_offset double")
    assert ev.scaled_mse(fc, params).first().mse == pytest.approx(0.02)
