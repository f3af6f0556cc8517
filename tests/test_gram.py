import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tests.helpers import bars_of, close_to, ordered, random_bars, to_spark
from tidemark.config import REGISTRY, ForecastSpec
from tidemark.operators import gram as gr
from tidemark.operators import sequences as sq
from tidemark.operators import tuning as tu
from tidemark.operators.scaling import chronological_split, fit_scale
from tidemark.plans import Layout


@pytest.fixture(scope="module")
def pdf():
    return random_bars(3, {"a": 400, "b": 250, "c": 60})


@pytest.fixture(scope="module")
def bars(spark, pdf):
    return to_spark(spark, pdf).cache()


def samples_of(group, p):
    y = group.close.to_numpy()
    x = np.lib.stride_tricks.sliding_window_view(y, p)[:-1]
    return x, y[p:]


def state(row):
    return row.n, np.array(row.mean), gr._square(np.array(row.m2)[None])[0]


@pytest.mark.parametrize("by", [("series_id",), ()])
def test_moments_of_samples(bars, pdf, by, monkeypatch):
    monkeypatch.setattr(gr, "MAX_OPEN", 1)
    rows = gr.gram(sq.sequences(bars, 4, 1, close_only=True), by).collect()
    groups = dict(list(pdf.groupby("series_id")))
    for row in rows:
        used = [groups[row.series_id]] if by else list(groups.values())
        z = np.vstack([np.column_stack(samples_of(g, 4)) for g in used])
        n, mean, m2 = state(row)
        assert n == len(z)
        close_to(mean, z.mean(0))
        close_to(m2, np.cov(z.T, bias=True) * n, 1e-8)
    assert len(rows) == (3 if by else 1)


def test_moments_merge_without_cancellation():
    z = np.random.default_rng(1).normal(1e9, 1e-3, (900, 3))
    whole = gr._moments(z)
    parts = None
    for cut in np.split(z, [1, 400, 401, 850]):
        parts = gr.merge(parts, gr._moments(cut))
    assert parts[0] == 900
    close_to(parts[1], whole[1], 1e-12)
    close_to(parts[2], whole[2], 1e-6)
    assert gr.merge(None, whole) is whole and gr.merge((0, whole[1], whole[2]), whole) is whole


@pytest.mark.parametrize("chunk", [None, 64])
def test_ar_of_ten_lags_equals_numpy(bars, pdf, chunk):
    got = ordered(gr.ar_p(bars, 10, layout=Layout(chunk_rows=chunk)))
    for name, group in pdf.groupby("series_id"):
        x, y = samples_of(group, 10)
        at = round(len(group) * 0.8)
        a = np.column_stack([np.ones(at - 10), x[: at - 10]])
        beta = np.linalg.lstsq(a, y[: at - 10], rcond=None)[0]
        want = np.column_stack([np.ones(len(y) - at), x[at:]]) @ beta
        mine = got[got.series_id == name]
        close_to(mine.y_pred, want, 1e-6)
        close_to(mine.y_true, y[at:])


def test_two_targets_have_their_own_weights(bars, pdf):
    got = gr.ar_p(bars, 3, horizons=2, warm_start=True)
    group = pdf[pdf.series_id == "a"]
    y, at = group.close.to_numpy(), round(400 * 0.8)
    for h in (1, 2):
        x = np.lib.stride_tricks.sliding_window_view(y, 3)[: 400 - 3 - 1]
        target = y[3 + h - 1 : 400 - 2 + h]
        train = np.arange(3, 3 + len(x)) + 1 < at
        beta = np.linalg.lstsq(np.column_stack([np.ones(train.sum()), x[train]]), target[train], rcond=None)[0]
        mine = ordered(got.filter((F.col("horizon") == h) & (F.col("series_id") == "a")))
        test = np.arange(3, 3 + len(x)) >= at
        close_to(mine.y_pred, np.column_stack([np.ones(test.sum()), x[test]]) @ beta, 1e-6)


def test_dependent_inputs_and_short_series(spark):
    line = [float(i) for i in range(40)]
    bars = bars_of(spark, {"line": line, "flat": [5.0] * 30, "tiny": [1.0, 2.0, 3.0], "wide": [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 1.0, 3.0, 9.0, 2.0]})
    rows = ordered(gr.ar_p(bars, 3, warm_start=True))
    by = {k: g for k, g in rows.groupby("series_id")}
    close_to(by["line"].y_pred, by["line"].y_true, 1e-6)
    close_to(by["flat"].y_pred, 5.0)
    assert set(by) == {"line", "flat", "wide"} and np.isfinite(by["wide"].y_pred).all()
    assert gr.ar_p(bars.limit(0), 2).collect() == []
    holes = sq.sequences(bars, 2, 1, close_only=True).withColumn("y", F.when(F.col("sample") > 2, F.col("y")))
    assert {r.series_id: r.n for r in gr.gram(holes).collect()} == {"line": 36, "flat": 26, "wide": 6}


@pytest.fixture(scope="module")
def train(bars):
    split = chronological_split(fit_scale(bars))
    return sq.sequences(split.filter("is_train"), 3, 1, 2).cache()  # open and high: high, low and close are multiples


@pytest.mark.parametrize("penalty,share", [(0.0, 0.0), (1e-3, 0.0), (1e-2, 0.5)])
def test_pooled_fits_equal_spark_ml(train, penalty, share):
    row = gr.fit(gr.gram(train, ()), 1, penalty, share).first()
    ready = sq.with_features(train).select("features", F.col("y")[0].alias("label"))
    model = LinearRegression(regParam=penalty, elasticNetParam=share, maxIter=1000, tol=1e-12, solver="normal").fit(ready)
    close_to(row.coef[0], model.coefficients.toArray(), 1e-5)
    close_to(row.intercept[0], model.intercept, 1e-5)


def test_grid_cells_equal_spark_ml(spark):
    # Independent inputs: where they hang together, Spark ML's quasi-Newton search may end short of the optimum.
    rng = np.random.default_rng(4)
    rows = []
    for name, n in (("a", 210), ("b", 90)):
        x = rng.normal(size=(n, 2, 3))
        y = x.reshape(n, 6) @ np.array([1.0, -0.5, 0.0, 0.2, 0.0, 2.0]) + rng.normal(0, 0.5, n)
        rows += [(name, x[i].tolist(), [float(y[i])], i + 1, n) for i in range(n)]
    train = spark.createDataFrame(rows, "series_id string, X array<array<double>>, y array<double>, sample long, samples long")
    regs, shares = (1e-3, 0.1), (0.0, 0.5, 1.0)
    cells = {(r.param_reg, r.param_elastic_net): r for r in gr.grid_search(train, (), regs, shares).collect()}
    scores, search = tu.cross_validated_grid(train, regs, shares, max_iter=1000, tol=1e-12)
    # Folds are cut per series, and both pool them.
    assert scores.count() == len(cells) == 6
    for r in scores.collect():
        assert abs(cells[r.param_reg, r.param_elastic_net].mean_test_score - r.mean_test_score) < 1e-6
    best = [r for r in cells.values() if r.is_best]
    assert len(best) == 1 and best[0].mean_test_score == max(r.mean_test_score for r in cells.values())
    close_to(best[0].coef[0], search.bestModel.coefficients.toArray(), 1e-5)


def test_elastic_net_meets_the_conditions_of_its_optimum(train):
    rows = train.select("X", "y").toPandas()
    x = np.stack([np.ravel([list(r) for r in v]) for v in rows.X])
    y = np.array([v[0] for v in rows.y])
    for penalty, share in ((1e-4, 0.5), (1e-3, 1.0)):
        row = gr.fit(gr.gram(train, ()), 1, penalty, share).first()
        xs, ys = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
        b, strength = np.array(row.coef[0]) * x.std(0) / y.std(), penalty / y.std()
        slope = xs.T @ (ys - xs @ b) / len(y) - strength * (1 - share) * b
        used = b != 0
        close_to(slope[used], strength * share * np.sign(b[used]), 1e-7)
        assert (np.abs(slope[~used]) <= strength * share + 1e-7).all()


def test_grid_by_series_with_three_folds(train):
    got = gr.grid_search(train, reg_params=(0.0, 0.1), elastic_net=(0.0,), folds=3)
    rows = {(r.series_id, r.param_reg): r.mean_test_score for r in got.collect()}
    pdf = sq.contiguous_folds(train, 3).toPandas()
    for (name, reg), score in rows.items():
        g = pdf[pdf.series_id == name]
        x, y = np.stack([np.ravel([list(r) for r in v]) for v in g.X]), np.array([v[0] for v in g.y])
        errors = []
        for f in range(3):
            a, b = x[g.fold != f], y[g.fold != f]
            sd, sy = a.std(0), b.std()
            r = (a - a.mean(0)) / sd
            beta = np.linalg.solve(r.T @ r / len(a) + reg / sy * np.eye(a.shape[1]), r.T @ ((b - b.mean()) / sy) / len(a)) * sy / sd
            pred = b.mean() + (x[g.fold == f] - a.mean(0)) @ beta
            errors.append(((y[g.fold == f] - pred) ** 2).mean())
        assert abs(score + np.mean(errors)) < 1e-9
    assert len(rows) == 6


def test_refit_scores_with_the_winner(bars):
    spec = ForecastSpec("g", 3, 1, 2)
    got = ordered(gr.refit_forecasts(bars, spec, (1e-4, 10.0), (0.0, 1.0)))
    want = ordered(gr.lag_regression(bars, spec, penalty=1e-4))
    # A penalty of 10 shrinks all to the mean, so the small one wins everywhere.
    assert len(got) == len(want) > 0 and (got[["series_id", "dt", "model"]] == want[["series_id", "dt", "model"]]).all().all()
    cells = gr.grid_search(sq.spec_sequences(chronological_split(fit_scale(bars)).filter("is_train"), spec), reg_params=(1e-4, 10.0), elastic_net=(0.0, 1.0))
    ridge = {r.series_id for r in cells.filter("is_best and param_elastic_net = 0.0 and param_reg < 1").collect()}
    for name in ridge:
        close_to(got[got.series_id == name].y_pred, want[want.series_id == name].y_pred, 1e-6)
    assert ridge


def test_no_job_and_no_broadcast_grows_with_the_series(bars):
    plan = gr.lag_regression(bars, REGISTRY["lstm_exp"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Exchange SinglePartition" not in plan


def test_large_batches_of_moments_are_cut_and_groups_across_cuts_merge(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    parts = {(f"s{i:03d}", j): gr._moments(rng.normal(size=(5 + i % 3, 8))) for i in range(40) for j in range(1 + i % 4)}
    whole = gr._rows_of({(k[0], str(k[1])): v for k, v in parts.items()}, ("series_id", "part"), [pa.string(), pa.string()])
    monkeypatch.setattr(gr, "WORK_BYTES", 3 * 8 * 8 * 9)
    cuts = list(gr._slices(iter([whole.slice(0, 0), whole])))
    assert max(c.num_rows for c in cuts) == 3 and pa.Table.from_batches(cuts).equals(pa.Table.from_batches([whole]))

    def read(batch, rows):
        state = None
        for s in gr._states(batch.take(pa.array(rows))):
            state = gr.merge(state, s)
        return state

    got = pa.Table.from_batches(gr._one_per_group(("series_id",), [pa.string()], read)(iter([whole]))).to_pylist()
    assert [r["series_id"] for r in got] == sorted({k[0] for k in parts})
    for r in got:
        want = None
        for k, v in parts.items():
            want = gr.merge(want, v) if k[0] == r["series_id"] else want
        assert r["n"] == want[0]
        close_to(r["mean"], want[1])
        close_to(r["m2"], want[2][gr._upper(8)])
