import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import bars_of, close_to, ordered, random_bars, to_spark
from tidemark.operators import scaling as sc
from tidemark.operators import sequences as sq
from tidemark.operators import training as tr
from tidemark.operators import tuning as tu
from tidemark.schema import GRID, HISTORY, SWEEP

# Published result tables the operators must reproduce.
GRID_ROWS = [
    ("lstm", "adam", 32, -5.0166843060139854e-05),
    ("lstm", "adam", 64, -3.993350712860888e-05),
    ("lstm", "adam", 128, -3.195467380123773e-05),
    ("lstm", "sgd", 32, -0.0015564510831609368),
    ("lstm", "sgd", 64, -0.0012004930176772177),
    ("lstm", "sgd", 128, -0.002984544262290001),
    ("rnn", "adam", 32, -5.0922031959999003e-05),
    ("rnn", "adam", 64, -2.073871937646743e-05),
    ("rnn", "adam", 128, -2.4123592723412912e-06),
    ("rnn", "sgd", 32, -0.004077911115018651),
    ("rnn", "sgd", 64, -0.017204071715241298),
    ("rnn", "sgd", 128, -0.003518708654155489),
]
SWEEP_ROWS = [
    (20, 96, 0.0014680178137496114),
    (30, 384, 0.002147171413525939),
    (24, 288, 0.0022972298320382833),
    (10, 448, 0.0025606139097362757),
    (15, 160, 0.002607504138723016),
    (25, 32, 0.004819028079509735),
]
# (loss, val_loss) per epoch of three short training logs.
LOGS = {
    "cnn": [
        (1.022251308313571e-05, 0.0006319225067272782),
        (1.0081513437398826e-06, 0.0003787513996940106),
        (6.821099987064372e-07, 0.0002970700734294951),
        (5.325633765096427e-07, 0.00036740145878866315),
        (4.180973007805733e-07, 0.00026394895394332707),
        (3.8196094465092756e-07, 0.000313906988594681),
        (3.151381804400444e-07, 0.00027107633650302887),
        (3.1204200467982446e-07, 0.00026781062479130924),
        (2.9844773052900564e-07, 0.0003253361792303622),
        (2.972388131183834e-07, 0.000353856390574947),
        (2.763599411537143e-07, 0.00037065570359118283),
        (2.517029429327522e-07, 0.0003188767295796424),
        (2.3838357776639896e-07, 0.00028465111972764134),
        (2.2816524847257824e-07, 0.00027677143225446343),
        (2.3986100927686493e-07, 0.00032441667281091213),
    ],
    "rnn_multi": [
        (3.845513774081155e-08, 1.993567821045872e-06),
        (3.69830139845817e-08, 2.0379361558298115e-06),
        (3.605066822842673e-08, 2.091361238854006e-06),
        (3.4079658206565e-08, 2.085672122120741e-06),
    ],
    "deep_lstm_2day": [
        (1.9574967154767364e-05, 0.0007200881955213845),
        (5.406321292866778e-07, 3.7611578136420576e-06),
        (6.082289871756075e-08, 2.9227855975477723e-06),
        (5.676749736949205e-08, 2.9455582080117892e-06),
        (5.5598295745085125e-08, 2.9025632102275267e-06),
        (5.8382298107062525e-08, 2.8983615720790112e-06),
        (5.954741055802515e-08, 2.82732980849687e-06),
        (6.197983992706213e-08, 2.8335909973975504e-06),
        (6.252355433389312e-08, 2.9144644031475764e-06),
        (6.108454186914969e-08, 2.908186843342264e-06),
        (6.615788805675038e-08, 2.8869835659861565e-06),
        (7.126802614720873e-08, 2.8875720090582035e-06),
        (7.204884866496286e-08, 2.8535519049910363e-06),
        (7.287464853789061e-08, 3.0416024401347386e-06),
        (7.317308359233721e-08, 3.1861347906669835e-06),
        (7.211017560848632e-08, 3.412930027479888e-06),
        (7.213061081756678e-08, 3.390484152987483e-06),
    ],
}
BY_MODEL = ("model",)


@pytest.fixture(scope="module")
def logs(spark):
    rows = [(m, i, l, l, v, v) for m, log in LOGS.items() for i, (l, v) in enumerate(log)]
    return spark.createDataFrame(rows, HISTORY).repartition(3).cache()


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame(GRID_ROWS, GRID).cache()


def _by_model(df):
    return {r.model: r for r in df.collect()}


def test_published_logs(logs):
    s = _by_model(tr.epoch_summary(logs, BY_MODEL))
    assert {m: (r.best_epoch, r.epochs) for m, r in s.items()} == {"cnn": (4, 15), "rnn_multi": (0, 4), "deep_lstm_2day": (6, 17)}
    close_to(
        [s["rnn_multi"].final_gap, s["cnn"].final_gap, s["deep_lstm_2day"].final_gap],
        [2.051592463914176e-06, 0.0003241768118016231, 3.318353542169916e-06], 1e-15,
    )
    c = _by_model(tr.convergence_epoch(logs, keys=BY_MODEL))
    assert {m: r.converge_epoch for m, r in c.items()} == {"cnn": 7, "rnn_multi": 2, "deep_lstm_2day": 14}
    after = tr.overfit_epochs(logs, BY_MODEL).groupBy("model").count().collect()
    assert {r.model: r["count"] for r in after} == {"cnn": 10, "rnn_multi": 3, "deep_lstm_2day": 10}


@pytest.mark.parametrize("model,patience", [("rnn_multi", 3), ("cnn", 10), ("deep_lstm_2day", 10)])
def test_published_logs_end_where_patience_runs_out(logs, model, patience):
    r = tr.early_stop(logs.filter(F.col("model") == model), patience, BY_MODEL).first()
    assert r.stop_epoch == len(LOGS[model]) - 1
    assert r.kept_epoch == len(LOGS[model]) - 1 - patience


def test_early_stop_keeps_the_best_before_the_stop(spark):
    losses = [5.0, 4.0, 4.0, 4.5, 1.0]
    log = spark.createDataFrame([("m", i, v, v, v, v) for i, v in enumerate(losses)], HISTORY)
    r = tr.early_stop(log, 2, BY_MODEL).first()
    assert (r.stop_epoch, r.kept_epoch) == (3, 1)  # the later minimum is never reached
    r = tr.early_stop(log, 9, BY_MODEL).first()
    assert (r.stop_epoch, r.kept_epoch) == (None, 4)


def test_log_without_validation(spark):
    log = spark.createDataFrame([("m", i, v, v, None, None) for i, v in enumerate([3.0, 1.0, 2.0])], HISTORY)
    r = tr.epoch_summary(log, BY_MODEL).first()
    assert (r.best_epoch, r.best_loss, r.final_gap) == (2, 1.0, 0.0)


def test_best_epoch_takes_the_first_of_equals(spark):
    log = spark.createDataFrame([("m", i, v, v, v, v) for i, v in enumerate([2.0, 1.0, 1.0])], HISTORY)
    assert tr.epoch_summary(log, BY_MODEL).first().best_epoch == 1


def test_epochs_of_a_legacy_file(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("loss,val_loss\n" + "".join(f"{v},{v}\n" for v in (3.0, 1.0, 2.0)))
    got = tr.number_epochs(spark.read.schema("loss double, val_loss double").option("header", True).csv(str(path)))
    assert [(r.epoch, r.loss) for r in got.orderBy("epoch").collect()] == [(0, 3.0), (1, 1.0), (2, 2.0)]


def test_descent_log_matches_a_loop(spark):
    bars = to_spark(spark, random_bars(3, {"a": 150, "b": 80}))
    pairs = tr.training_pairs(bars)
    got = ordered(tr.gradient_descent_log(pairs, (0.1, 0.5), 25), "series_id", "model", "epoch")
    pdf = pairs.toPandas()
    for s in ("a", "b"):
        mine = pdf[pdf["series_id"] == s]
        t, v = mine[~mine["is_validation"]], mine[mine["is_validation"]]
        n = len(mine)
        assert len(t) == int(np.floor(n * 0.8))
        for rate in (0.1, 0.5):
            a = b = 0.0
            log = got[(got["series_id"] == s) & (got["model"] == f"gd_{rate}")]
            for _, row in log.iterrows():
                e = a * t["x"] + b - t["y"]
                a, b = a - rate * 2 * (e * t["x"]).mean(), b - rate * 2 * e.mean()
                close_to([row["loss"], row["val_loss"]], [((a * d["x"] + b - d["y"]) ** 2).mean() for d in (t, v)], 1e-9)
            assert log["epoch"].tolist() == list(range(25))


def test_published_grid(grid):
    best = _by_model(tu.best_config(grid, ("param_optimiser", "param_neurons")))
    assert (best["lstm"].param_optimiser, best["lstm"].param_neurons, best["lstm"].mean_test_score) == GRID_ROWS[2][1:]
    assert (best["rnn"].param_optimiser, best["rnn"].param_neurons, best["rnn"].mean_test_score) == GRID_ROWS[8][1:]
    lift = _by_model(tu.score_lift(grid))
    assert lift["lstm"].lift == pytest.approx(93.39930305201227, rel=1e-12)
    means = {(r.model, r.param_optimiser): r.mean_score for r in tu.mean_score_by(grid, "param_optimiser").collect()}
    assert means["lstm", "adam"] == pytest.approx(-4.068500799666216e-05, rel=1e-12)
    assert means["lstm", "sgd"] == pytest.approx(-0.0019138294543760332, rel=1e-12)
    assert means["rnn", "adam"] == pytest.approx(-2.4691036869602574e-05, rel=1e-12)
    assert means["rnn", "sgd"] == pytest.approx(-0.008266897161471732, rel=1e-12)
    pivot = tu.score_pivot(grid, "param_neurons", "param_optimiser", ("adam", "sgd"))
    row = pivot.filter("model = 'lstm' and param_neurons = 64").first()
    assert (row.adam, row.sgd) == (3.993350712860888e-05, 0.0012004930176772177)
    cell = _by_model(tu.best_cell(grid, "param_neurons", "param_optimiser"))
    assert (cell["rnn"].param_neurons, cell["rnn"].param_optimiser) == (128, "adam")


def test_published_sweep(spark):
    sweep = spark.createDataFrame(SWEEP_ROWS, SWEEP).withColumn("series_id", F.lit("x"))
    r = tu.sweep_summary(sweep).first()
    assert (r.best_inputs, r.worst_inputs) == (20, 25)
    assert r.improvement == pytest.approx(69.53705623771837, rel=1e-12)
    top = tu.best_rows(sweep).first()
    assert (top.inputs, top.units) == (20, 96)
    norm = {r.inputs: r.norm_loss for r in tu.normalised_loss(sweep).collect()}
    assert norm[20] == 0.0 and norm[25] == pytest.approx(1.0, abs=1e-6)


def test_grid_scores_match_a_loop(spark):
    bars = to_spark(spark, random_bars(12, {"a": 90, "b": 41}))
    got = {(r.model, r.param_feature, r.param_penalty): r.mean_test_score for r in tu.ridge_grid_scores(bars, ("open", "close"), (0.0, 0.1), folds=3).collect()}
    pdf = ordered(sc.fit_scale(bars))
    for s, g in pdf.groupby("series_id"):
        train = g.iloc[: round(len(g) * 0.8)]
        y = train["close"].to_numpy()[1:]
        for f in ("open", "close"):
            x = train[f].to_numpy()[:-1]
            folds = np.array_split(np.arange(len(y)), 3)
            for p in (0.0, 0.1):
                errs = []
                for held in folds:
                    rest = np.setdiff1d(np.arange(len(y)), held)
                    a = np.cov(x[rest], y[rest], bias=True)[0, 1] / (x[rest].var() + p)
                    b = y[rest].mean() - a * x[rest].mean()
                    errs.append(((y[held] - a * x[held] - b) ** 2).mean())
                assert got[s, f, p] == pytest.approx(-np.mean(errs), rel=1e-8)


def test_lookback_scores_match_a_loop(spark):
    bars = to_spark(spark, random_bars(13, {"a": 100, "b": 60}))
    got = {(r.series_id, r.inputs): r.val_loss for r in tu.lookback_scores(bars, (5, 10)).collect()}
    for s, g in ordered(bars).groupby("series_id"):
        c = g["close"].to_numpy()[: round(len(g) * 0.8)]
        for k in (5, 10):
            x = np.array([c[i - k : i].mean() for i in range(k, len(c))])
            y = c[k:]
            cut = int(np.floor(len(y) * 0.8))
            a, b = np.polyfit(x[:cut], y[:cut], 1)
            assert got[s, k] == pytest.approx(((y[cut:] - a * x[cut:] - b) ** 2).mean(), rel=1e-6)


def test_parameter_grid(spark):
    models = spark.createDataFrame([("m",), ("n",)], "model string")
    grid = tu.parameter_grid(models, optimiser=("adam", "sgd"), neurons=(32, 64, 128))
    assert grid.count() == 12 and grid.distinct().count() == 12


def test_cross_validation_prefers_the_smaller_penalty(spark):
    bars = to_spark(spark, random_bars(14, {"a": 120, "b": 120}))
    samples = sq.sequences(sc.fit_scale(bars), 3, 1, 2)
    scores, search = tu.cross_validated_grid(samples, (1e-6, 1.0), (0.0,))
    table = {r.param_reg: r.mean_test_score for r in scores.collect()}
    assert table[1e-6] > table[1.0] and all(v < 0 for v in table.values())
    assert search.bestModel.getRegParam() == 1e-6


def test_ml_sweep_has_one_loss_per_size(spark):
    bars = to_spark(spark, random_bars(15, {"a": 90, "b": 70}))
    got = tu.sweep_lookbacks(sc.fit_scale(bars), (3, 5), n_features=2).collect()
    assert sorted(r.inputs for r in got) == [3, 5] and all(0 < r.val_loss < 1 for r in got)
