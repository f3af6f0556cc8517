"""The chunked layout must give exactly what the plain one gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import ordered, random_bars, to_spark
from tidemark.operators import evaluate as ev
from tidemark.operators import forecast as fo
from tidemark.operators import indicators as ind
from tidemark.operators import returns as ret
from tidemark.operators import scaling as sc
from tidemark.operators import sequences as sq
from tidemark.operators import training as tr
from tidemark.operators import tuning as tu
from tidemark.plans import PLAIN, Layout, layout_for, number_rows, over_series, quantile, rolling_moments

LENGTHS = {"hot": 1500, "small": 40, "one": 1, "edge": 300, "mid": 301}


@pytest.fixture(scope="module")
def bars(spark):
    return to_spark(spark, random_bars(3, LENGTHS)).cache()


JOBS = {
    "number": lambda b, l: number_rows(b, l),
    "means": lambda b, l: ind.moving_averages(b, (5, 200), layout=l),
    "plain_means": lambda b, l: ind.moving_averages(b, (5, 20), decimals=None, layout=l),
    "lagged": lambda b, l: ind.lagged_means(b, (5, 30), layout=l),
    "drawdown": lambda b, l: ind.drawdown(b, l),
    "vol": lambda b, l: ind.realised_volatility(b, (10, 60), layout=l),
    "cross": lambda b, l: ind.golden_crosses(b, (5, 20), layout=l),
    "quantile": lambda b, l: ind.price_quantile(b, layout=l),
    "median": lambda b, l: ind.price_quantile(b, 0.5, layout=l),
    "low_end": lambda b, l: ind.price_quantile(b, 0.0, layout=l),
    "high_end": lambda b, l: ind.price_quantile(b, 1.0, layout=l),
    "fraction": lambda b, l: ind.row_at_fraction(b, layout=l),
    "growth": lambda b, l: ret.growth(b, layout=l),
    "prev": lambda b, l: ret.previous_close(b, l),
    "split": lambda b, l: sc.chronological_split(b, layout=l),
    "scale": lambda b, l: sc.fit_scale(b, layout=l),
    "scale_train": lambda b, l: sc.fit_scale(b, fit_on="train", layout=l),
    "samples": lambda b, l: sq.contiguous_folds(sq.tail_validation(sq.sequences(b, 7, 2, 3, layout=l)), 3),
    "one_lag": lambda b, l: fo.one_lag_forecasts(b, (1, 2), layout=l),
    "warm": lambda b, l: fo.one_lag_forecasts(b, (1,), warm_start=True, layout=l),
    "pairs": lambda b, l: tr.training_pairs(b, layout=l),
    "grid": lambda b, l: tu.ridge_grid_scores(b, ("close", "open"), (0.0, 0.1), layout=l),
    "sweep": lambda b, l: tu.lookback_scores(b, (3, 10), layout=l),
    "rolling": lambda b, l: ev.rolling_rmse(fo.one_lag_forecasts(b), 20, layout=l),
    "direction": lambda b, l: ev.directional_accuracy(fo.one_lag_forecasts(b), l),
}


def _canon(df):
    pdf = df.select(sorted(df.columns)).toPandas()
    for c in pdf.columns:
        if pdf[c].dtype == object:
            pdf[c] = pdf[c].astype(str)
        elif pdf[c].dtype == float:
            pdf[c] = pdf[c].round(7)
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", JOBS)
def test_chunked_equals_plain(bars, name):
    job = JOBS[name]
    want = _canon(job(bars, PLAIN))
    got = _canon(job(bars, Layout(chunk_rows=201)))
    assert len(want) and got.equals(want)


@pytest.mark.parametrize("size", [30, 31, 100, 5000])
def test_any_chunk_size_that_covers_the_frame(bars, size):
    want = _canon(ind.moving_averages(bars, (30,)))
    assert _canon(ind.moving_averages(bars, (30,), layout=Layout(chunk_rows=size))).equals(want)


def test_quantile_of_few_repeated_values(spark):
    rows = [("a", float(v)) for v in [1, 1, 1, 2, 5, 5, 9]] + [("b", 4.0)] * 6 + [("c", None)]
    df = spark.createDataFrame(rows, "series_id string, v double")
    for q in (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0):
        want = {r.series_id: r.x for r in quantile(df.filter("v is not null"), "v", q, "x").collect()}
        for bins in (1, 3, 1024):
            got = quantile(df, "v", q, "x", Layout(chunk_rows=10), bins).collect()
            assert {r.series_id: pytest.approx(r.x) for r in got} == want


def test_finer_blocks(bars):
    month = Layout(chunk_rows=50, block=lambda c: F.trunc(c, "MM"))
    assert _canon(number_rows(bars, month)).equals(_canon(number_rows(bars)))
    assert _canon(ind.drawdown(bars, month)).equals(_canon(ind.drawdown(bars)))


def test_chunk_must_cover_the_frame(bars):
    with pytest.raises(ValueError):
        over_series(bars, lambda df, w: df, Layout(chunk_rows=5), before=6)


def test_layout_is_chosen_by_the_longest_series(bars):
    assert not layout_for(bars, max_rows=1500).chunked
    chosen = layout_for(bars, max_rows=1499)
    assert chosen.chunked and chosen.chunk_rows == 1499


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_results_do_not_depend_on_partitioning(bars, partitions):
    want = _canon(ind.realised_volatility(bars, (10,)))
    assert _canon(ind.realised_volatility(bars.repartition(partitions), (10,))).equals(want)


def test_empty_input(spark):
    empty = to_spark(spark, random_bars(1, {}))
    for layout in (PLAIN, Layout(chunk_rows=300)):
        for name, job in JOBS.items():
            assert job(empty, layout).count() == 0, name


@pytest.mark.parametrize("chunk", [None, 300])
def test_rolling_moments_equal_numpy(spark, chunk):
    layout = Layout(chunk_rows=chunk)
    pdf = random_bars(4, {"a": 700, "b": 8, "c": 1})
    pdf.loc[pdf.index % 11 == 3, "volume"] = None
    df = spark.createDataFrame(pdf[["series_id", "dt", "volume"]].astype({"volume": object}).where(pdf.volume.notna(), None).values.tolist(), "series_id string, dt date, volume double")
    spans = (1, 2, 7, 252)
    got = over_series(df, lambda d, w: rolling_moments(d, w, "volume", spans, layout), layout, before=252)
    assert got.columns == ["series_id", "dt", "volume", *[f"{c}{k}" for k in spans for c in ("_n", "_mean", "_m2")]]
    for name, g in got.toPandas().sort_values("dt").groupby("series_id"):
        v = g.volume.to_numpy(float)
        for k in spans:
            for i in range(len(v)):
                part = v[max(0, i - k + 1) : i + 1]
                part = part[~np.isnan(part)]
                assert g[f"_n{k}"].iloc[i] == len(part)
                if len(part):
                    assert abs(g[f"_mean{k}"].iloc[i] - part.mean()) < 1e-9 * 1000
                    assert abs(g[f"_m2{k}"].iloc[i] - ((part - part.mean()) ** 2).sum()) < 1e-6


def test_rolling_moments_do_not_cancel(spark):
    values = [1e9 + (i % 3) * 1e-3 for i in range(200)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "series_id string, dt int, v double")
    got = over_series(df, lambda d, w: rolling_moments(d, w, "v", (30,))).orderBy("dt").toPandas()
    for i in (29, 30, 77, 199):
        part = np.array(values[i - 29 : i + 1])
        assert abs(got._m230.iloc[i] / ((part - part.mean()) ** 2).sum() - 1) < 1e-3


def test_rolling_moments_share_one_sort(spark, bars):
    for df in (ind.realised_volatility(bars.select("series_id", "dt", "close")), ind.realised_volatility(bars.select("series_id", "dt", "close"), (3, 64, 100))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1
