import numpy as np
import pandas as pd
import pytest

from tests.helpers import bars_of, close_to, ordered, random_bars, to_spark
from tidemark.operators import indicators as ind


@pytest.fixture(scope="module")
def many(spark):
    """Fifty random series of mixed length, some shorter than the frames."""
    lengths = {f"s{i:02d}": n for i, n in enumerate(np.random.default_rng(5).integers(1, 330, 50))}
    pdf = random_bars(11, lengths).sort_values(["series_id", "dt"]).reset_index(drop=True)
    return pdf, to_spark(spark, pdf).cache()


def _by(pdf, fn):
    return pdf.groupby("series_id", group_keys=False)["close"].transform(fn)


def test_moving_averages_match_pandas(many):
    pdf, bars = many
    got = ordered(ind.moving_averages(bars))
    for k in (50, 200):
        close_to(got[f"ma{k}"], _by(pdf, lambda s: s.rolling(k).mean()), 1e-9)
    loose = ordered(ind.moving_averages(bars, decimals=None))
    close_to(loose["ma50"], got["ma50"], 1e-9)


def test_drawdown_matches_pandas_and_is_never_positive(many):
    pdf, bars = many
    got = ordered(ind.drawdown(bars))
    high = _by(pdf, lambda s: s.cummax())
    close_to(got["running_high"], high)
    close_to(got["drawdown"], (pdf["close"] - high) / high * 100)
    assert (got["drawdown"] <= 0).all()


def test_volatility_matches_pandas(many):
    pdf, bars = many
    got = ordered(ind.realised_volatility(bars))
    lr = _by(pdf, lambda s: np.log(s / s.shift(1)))
    close_to(got["log_return"], lr, 1e-12)
    for k in (30, 252):
        want = lr.groupby(pdf["series_id"]).transform(lambda s: s.rolling(k).std()) * np.sqrt(252) * 100
        close_to(got[f"rvol{k}"], want, 1e-7)
    summary = ordered(ind.volatility_summary(ind.realised_volatility(bars)), "series_id")
    vol = lr.groupby(pdf["series_id"]).transform(lambda s: s.rolling(30).std()) * np.sqrt(252) * 100
    close_to(summary["mean_vol"], vol.groupby(pdf["series_id"]).mean(), 1e-7)
    close_to(summary["current_vol"], vol.groupby(pdf["series_id"]).apply(lambda s: s.dropna().iloc[-1] if s.notna().any() else np.nan), 1e-7)


def test_golden_crosses_match_pandas(many):
    pdf, bars = many
    want = []
    for s, g in pdf.groupby("series_id"):
        m = pd.DataFrame({"dt": g["dt"], "a": g["close"].rolling(5).mean(), "b": g["close"].rolling(20).mean()}).dropna()
        hits = m[(m["a"].shift(1) < m["b"].shift(1)) & (m["a"] >= m["b"])]
        want += [(s, d) for d in hits.tail(2)["dt"]]
    got = ordered(ind.most_recent(ind.golden_crosses(bars, (5, 20))))
    assert list(zip(got["series_id"], got["dt"])) == want


def test_quantile_and_row_at_fraction(many):
    pdf, bars = many
    got = ordered(ind.price_quantile(bars), "series_id")
    close_to(got["close_quantile"], pdf.groupby("series_id")["close"].quantile(0.7))
    at = ordered(ind.row_at_fraction(bars))
    want = pdf.groupby("series_id").apply(lambda g: g["dt"].iloc[int(len(g) * 0.15)])
    assert at["dt"].tolist() == want.tolist()
    approx = ordered(ind.price_quantile(bars, exact=False), "series_id")
    assert len(approx) == 50


def test_frames_are_null_until_full(spark):
    got = ordered(ind.moving_averages(bars_of(spark, {"exact": [1.0, 2.0, 3.0], "short": [1.0, 2.0]}), (3,)))
    exact = got[got["series_id"] == "exact"]["ma3"].tolist()
    assert np.isnan(exact[:2]).all() and exact[2] == 2.0
    assert got[got["series_id"] == "short"]["ma3"].isna().all()


def test_zero_and_constant_prices(spark):
    got = ordered(ind.log_returns(bars_of(spark, {"z": [1.0, 0.0, 2.0], "c": [5.0, 5.0]})))
    z = got[got["series_id"] == "z"]["log_return"]
    assert z.isna().all()  # no predecessor, ln(0), division by zero
    assert got[got["series_id"] == "c"]["log_return"].tolist()[1] == 0.0
    down = ordered(ind.drawdown(bars_of(spark, {"z": [0.0, 0.0]})))
    assert down["drawdown"].isna().all()


def test_series_do_not_leak_into_each_other(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [100.0, 90.0, 80.0, 70.0]
    both = ordered(ind.moving_averages(bars_of(spark, {"a": a, "b": b}), (2,)))
    alone = ordered(ind.moving_averages(bars_of(spark, {"a": a}), (2,)))
    close_to(both[both["series_id"] == "a"]["ma2"], alone["ma2"])


def test_day_direction_counts_unchanged_as_up(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 1.0)], "open double, close double")
    assert [r.direction for r in ind.day_direction(df).collect()] == ["up", "up", "down"]
