import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import bars_of, close_to, ordered, random_bars, to_spark
from tidemark.config import REGISTRY
from tidemark.operators import scaling as sc
from tidemark.operators import sequences as sq
from tidemark.schema import FEATURES


@pytest.fixture(scope="module")
def data(spark):
    pdf = random_bars(4, {"a": 61, "b": 12, "c": 10, "d": 1}).sort_values(["series_id", "dt"]).reset_index(drop=True)
    return pdf, to_spark(spark, pdf).cache()


def test_scaling_inverts_and_stays_in_range(data):
    pdf, bars = data
    params = sc.fit_minmax(bars)
    scaled = sc.scale(bars, params)
    got = ordered(scaled)
    assert got[list(FEATURES)].min().min() >= -1e-12 and got[list(FEATURES)].max().max() <= 1 + 1e-12
    close_to(ordered(sc.unscale(scaled, params))[list(FEATURES)], pdf[list(FEATURES)], 1e-9)
    close_to(ordered(sc.fit_scale(bars))[list(FEATURES)], got[list(FEATURES)], 1e-12)
    assert sc.params_by_feature(params).count() == 4 * len(FEATURES)


def test_constant_column_scales_to_zero(spark):
    bars = bars_of(spark, {"a": [5.0, 5.0, 5.0]})
    row = sc.params_by_feature(sc.fit_minmax(bars)).filter("feature = 'close'").first()
    assert row.scale == 1.0
    assert {r.close for r in sc.fit_scale(bars).collect()} == {0.0}


def test_train_only_scaler_ignores_the_test_rows(spark):
    bars = bars_of(spark, {"a": [1.0, 2.0, 3.0, 4.0, 100.0]})
    assert sc.fit_minmax(bars).first().close_max == 100.0
    assert sc.fit_minmax(bars, fit_on="train").first().close_max == 4.0
    assert max(r.close for r in sc.fit_scale(bars, fit_on="train").collect()) == pytest.approx(99 / 3)
    with pytest.raises(ValueError):
        sc.fit_minmax(bars, fit_on="test")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 10, 61])
@pytest.mark.parametrize("ratio", [0.8, 0.5, 0.7])
def test_split_rounds_half_to_even(spark, n, ratio):
    split = sc.chronological_split(bars_of(spark, {"a": [1.0] * n}), ratio)
    r = sc.split_summary(split).first()
    assert (r.n_train, r.n_test) == (round(n * ratio), n - round(n * ratio))


@pytest.mark.parametrize("shape", [(10, 1, 6, False), (7, 2, 6, False), (10, 1, 5, False), (10, 1, 1, True), (3, 4, 1, False)])
def test_windows_match_slices(data, shape):
    pdf, bars = data
    n_in, n_pred, n_feat, close_only = shape
    got = ordered(sq.sequences(bars, n_in, n_pred, n_feat, close_only=close_only))
    feats = ["close"] if close_only else list(FEATURES[:n_feat])
    at = 0
    for _, g in pdf.groupby("series_id"):
        x, y = g[feats].to_numpy(), g["close"].to_numpy()
        count = max(len(g) - n_pred + 1 - n_in, 0)
        for i in range(n_in, n_in + count):
            row = got.iloc[at]
            close_to(np.array([list(v) for v in row["X"]]), x[i - n_in : i])
            close_to(row["y"], y[i : i + n_pred])
            assert list(row["y_dt"]) == list(g["dt"].iloc[i : i + n_pred]) and row["samples"] == count
            at += 1
    assert at == len(got)


def test_single_precision(data):
    _, bars = data
    types = dict(sq.sequences(bars, 3, 1, 2, single_precision=True).dtypes)
    assert types["X"] == "array<array<float>>" and types["y"] == "array<float>"


@pytest.mark.parametrize("ratio", [0.2, 0.3])
def test_tail_validation(data, ratio):
    pdf, bars = data
    got = ordered(sq.tail_validation(sq.sequences(bars, 5, 1, 1), ratio))
    for _, g in got.groupby("series_id"):
        cut = int(math.floor(len(g) * (1 - ratio)))
        assert g["is_validation"].tolist() == [i >= cut for i in range(len(g))]


@pytest.mark.parametrize("k", [2, 3, 5, 70])
def test_folds_are_contiguous_and_balanced(data, k):
    _, bars = data
    got = ordered(sq.contiguous_folds(sq.sequences(bars, 5, 1, 1), k))
    for _, g in got.groupby("series_id"):
        sizes = [len(g) // k + (1 if f < len(g) % k else 0) for f in range(k)]
        assert g["fold"].tolist() == [f for f, size in enumerate(sizes) for _ in range(size)]


def test_latest_window_is_the_tail_in_order(data):
    pdf, bars = data
    got = {r.series_id: r for r in sq.latest_window(bars, 7, 3).collect()}
    assert set(got) == {"a", "b", "c"}  # d is too short
    for s, r in got.items():
        tail = pdf[pdf["series_id"] == s].tail(7)
        close_to(np.array(r.X), tail[list(FEATURES[:3])])
        assert r.dt == tail["dt"].iloc[-1]


def test_registered_shapes(data):
    _, bars = data
    shapes = [(s.n_inputs, s.n_predictions, s.n_features) for s in REGISTRY.values()]
    assert shapes == [(10, 1, 6), (15, 1, 6), (10, 1, 1), (10, 1, 5), (15, 1, 6), (10, 1, 6), (7, 2, 6)]
    tables = sq.prepared_tables(bars, list(REGISTRY.values()))
    assert len(tables) == 5
    wide = sq.with_features(tables[(15, 1, 6, False)]).first()
    assert wide.features.size == 15 * 6
