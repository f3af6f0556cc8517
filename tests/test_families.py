import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import bars_of, close_to, ordered, random_bars, to_spark
from tidemark.config import REGISTRY
from tidemark.operators import families as fam
from tidemark.operators import sequences as sq
from tidemark.operators.evaluate import common_dates, scorecard
from tidemark.operators.scaling import fit_scale
from tidemark.plans import Layout, number_rows

SPECS = list(REGISTRY.values())


@pytest.fixture(scope="module")
def bars(spark):
    return to_spark(spark, random_bars(5, {"a": 300, "b": 120, "c": 16, "d": 9})).cache()


@pytest.mark.parametrize("chunk", [None, 50])
def test_shared_samples_are_those_of_each_shape(bars, chunk):
    layout = Layout(chunk_rows=chunk)
    scaled = fit_scale(bars)
    shared = fam.shared_samples(number_rows(scaled, layout), SPECS, layout=layout).cache()
    for s in SPECS:
        got = shared.filter(F.col("spec") == s.key).drop("spec")
        want = sq.spec_sequences(scaled, s)
        assert got.columns == want.columns and got.count() == want.count() > 0
        assert got.exceptAll(want).isEmpty()


def test_all_shapes_share_one_shuffle(bars):
    rows = number_rows(bars)
    plan = fam.shared_samples(rows, SPECS)._jdf.queryExecution().executedPlan().toString()
    alone = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == alone.count("Exchange hashpartitioning") == 1


def test_states_forget_and_depend_on_order():
    family = fam.FAMILIES["lstm_exp"]
    x = np.random.default_rng(0).uniform(size=(7, 10, 6))
    made = fam.mapped(family, x)
    assert made.shape == (7, family.units + 6)
    close_to(made[:, -6:], x[:, -1])
    # One window at a time, unit by unit, is the same as the batch.
    into, within, leaks = fam._state_weights(family, 6)[0]
    for n in range(7):
        h = np.zeros(family.units)
        for t in range(10):
            h = np.array([(1 - leaks[u]) * h[u] + leaks[u] * np.tanh(x[n, t] @ into[:, u] + h @ within[:, u]) for u in range(family.units)])
        close_to(made[n, : family.units], h)
    assert not np.allclose(fam.mapped(family, x[:, ::-1])[:, : family.units], made[:, : family.units])
    assert fam.mapped(fam.FAMILIES["deep"], x).shape == (7, 2 * 24 + 6)


def test_kernels_keep_the_largest_response_and_the_positive_share():
    family = fam.FAMILIES["cnn"]
    x = np.random.default_rng(0).uniform(size=(4, 10, 6))
    made = fam.mapped(family, x)
    at = 0
    for dilation, w, bias in fam._kernels(family, 6):
        for u in range(w.shape[1]):
            r = np.array([[np.concatenate([x[n, p], x[n, p + dilation], x[n, p + 2 * dilation]]) @ w[:, u] + bias[u] for p in range(10 - 2 * dilation)] for n in range(4)])
            close_to(made[:, at + u], r.max(1))
            close_to(made[:, at + w.shape[1] + u], (r > 0).mean(1))
        at += 2 * w.shape[1]
    assert fam.mapped(family, x[:, :2]).shape == made.shape  # shorter than a kernel: no response


def test_samples_without_a_family_or_with_a_gap_have_no_features(spark):
    rows = [("a", [[1.0] * 6] * 10, "cnn"), ("b", [[1.0] * 6] * 9 + [[None] * 6], "cnn"), ("c", [[1.0] * 6] * 10, "other"), ("d", None, "cnn"), ("e", [[1.0] * 6] * 9 + [None], "cnn")]
    df = spark.createDataFrame(rows, "series_id string, X array<array<double>>, spec string")
    got = {r.series_id: r.X for r in fam.with_family_features(df).collect()}
    assert len(got["a"][0]) == 2 * 32 + 6 and [got[k] for k in "bcde"] == [None] * 4


def test_chunked_equals_plain_and_every_family_forecasts(bars):
    plain = ordered(fam.family_forecasts(bars.filter("series_id < 'c'")), "series_id", "model", "horizon", "dt")
    chunked = ordered(fam.family_forecasts(bars.filter("series_id < 'c'"), layout=Layout(chunk_rows=40)), "series_id", "model", "horizon", "dt")
    assert set(plain.model) == set(REGISTRY) and set(plain[plain.horizon == 2].model) == {"deep"}
    assert (plain[["series_id", "model", "dt"]] == chunked[["series_id", "model", "dt"]]).all().all()
    close_to(plain.y_pred, chunked.y_pred, 1e-6)
    assert np.isfinite(plain.y_pred).all()


def test_a_learnable_series_is_learnt_by_all_seven(spark):
    t = np.arange(600)
    wave = bars_of(spark, {"w": (100 + 20 * np.sin(t / 7) + 5 * np.sin(t / 3)).tolist()})
    card = scorecard(common_dates(fam.family_forecasts(wave).filter("horizon = 1"))).collect()
    assert len(card) == 7 and {r.rmse_rank for r in card} <= set(range(1, 8))
    naive = np.sqrt(np.mean(np.diff(100 + 20 * np.sin(t / 7) + 5 * np.sin(t / 3)) ** 2))
    assert all(r.rmse < naive for r in card)
