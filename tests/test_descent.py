import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import close_to, random_bars, to_spark
from tidemark.operators import descent as ds
from tidemark.operators import scaling as sc
from tidemark.operators import sequences as sq
from tidemark.operators import training as tr
from tidemark.session import last_shuffles

SCHEMA = "series_id string, dt date, X array<array<double>>, y array<double>, is_validation boolean"


def samples(spark, n=300, inputs=3, targets=1, noise=0.05, seed=0):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(inputs, targets))
    rows = []
    for i in range(n):
        x = rng.uniform(-1, 1, (1, inputs))
        y = (x @ w + 0.3)[0] + rng.normal(0, noise, targets)
        rows.append((f"s{i % 3}", dt.date(2020, 1, 1) + dt.timedelta(days=i), x.tolist(), y.tolist(), i % 5 == 0))
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def numpy_fit(df, how):
    """The same fit in one process: shards by Spark's hash, then plain loops."""
    place = F.xxhash64("series_id", "dt")
    rows = df.select("X", "y", "is_validation", "series_id", "dt", F.pmod(place, F.lit(how.shards)).alias("shard"),
                     F.xxhash64(F.lit(1), "series_id", "dt").alias("place")).collect()
    rows.sort(key=lambda r: (r.place, r.series_id, r.dt))
    shards = [[r for r in rows if r.shard == s] for s in range(how.shards)]
    w = np.zeros((len(np.ravel(rows[0].X)) + 1, len(rows[0].y)))
    m, v, steps, log, best, waited = w.copy(), w.copy(), 0, [], (np.inf, None, -1), 0

    def xy(part):
        return np.array([[*np.ravel(r.X), 1.0] for r in part]).reshape(-1, len(w)), np.array([r.y for r in part]).reshape(-1, w.shape[1])

    def loss(e):
        return e**2 if how.loss == "mse" else np.log(np.cosh(e))

    for epoch in range(how.epochs):
        ends, seen = [], []
        for shard in shards:
            train = [r for r in shard if not r.is_validation]
            a, am, av, t = w.copy(), m.copy(), v.copy(), steps
            for lo in range(0, len(train), how.batch):
                x, y = xy(train[lo : lo + how.batch])
                e = x @ a - y
                seen.append((loss(e).mean(1), (e**2).mean(1)))
                g = x.T @ (2 * e if how.loss == "mse" else np.tanh(e)) / e.size
                t += 1
                if how.optimiser == "sgd":
                    a = a - how.rate * g
                else:
                    am, av = 0.9 * am + 0.1 * g, 0.999 * av + 0.001 * g * g
                    a = a - how.rate * (am / (1 - 0.9**t)) / (np.sqrt(av / (1 - 0.999**t)) + 1e-7)
            if train:
                ends.append((len(train), a, am, av, t))
        total = sum(e[0] for e in ends)
        w, m, v = (sum(e[0] * e[i] for e in ends) / total for i in (1, 2, 3))
        steps = max(e[4] for e in ends)
        x, y = xy([r for r in rows if r.is_validation])
        val = loss(x @ w - y).mean(1).mean()
        log.append((epoch, *(np.concatenate([s[i] for s in seen]).mean() for i in (0, 1)), val, ((x @ w - y) ** 2).mean()))
        if val < best[0]:
            best = (val, w, epoch)
        if epoch - best[2] >= how.patience:
            break
    return log, best


@pytest.mark.parametrize("how", [
    ds.Descent("mse", "sgd", 0.3, 16, 6, 3, 2),
    ds.Descent("log_cosh", "adam", 0.05, 32, 5, 5, 3),
    ds.Descent("log_cosh", "sgd", 40.0, 8, 30, 2, 1),  # too fast: the loss rises again and the fit stops
])
def test_fit_equals_a_numpy_loop(spark, how):
    df = samples(spark, targets=1 if how.loss == "mse" else 2)
    got, (log, best) = ds.fit_epochs(df, how), numpy_fit(df, how)
    assert [r[0] for r in got.log] == [r[0] for r in log] and got.best_epoch == best[2]
    close_to(np.array(got.log), np.array(log), 1e-8)
    close_to(got.best.w, best[1], 1e-8)
    assert got.stopped == (len(log) < how.epochs or log[-1][0] - best[2] >= how.patience)


def test_log_feeds_the_log_analyses_and_the_best_weights_score(spark):
    df = samples(spark, 400)
    fits = {"fast": ds.fit_epochs(df, ds.Descent("mse", "sgd", 0.5, 16, 12, 4, 2)), "wild": ds.fit_epochs(df, ds.Descent("mse", "sgd", 1.6, 8, 12, 2, 2))}
    log = ds.log_table(spark, fits)
    for r in tr.epoch_summary(log).collect():
        assert r.best_epoch == fits[r.model].best_epoch
    stop = {r.model: r for r in tr.early_stop(log, 2).collect()}
    wild = fits["wild"]
    assert stop["wild"].kept_epoch == wild.best_epoch
    assert (stop["wild"].stop_epoch is not None) == wild.stopped
    assert tr.overfit_epochs(log).filter("model = 'wild'").count() == len(wild.log) - 1 - wild.best_epoch
    row = ds.model_table(spark, fits["fast"]).first()
    close_to(np.array(row.coef[0]), fits["fast"].best.w[:-1, 0])


def test_shards_without_rows_no_validation_and_no_rows(spark):
    df = samples(spark, 6).withColumn("is_validation", F.lit(False))
    fit = ds.fit_epochs(df, ds.Descent("mse", "sgd", 0.1, 4, 3, 3, 16))
    assert [r[3:] for r in fit.log] == [(None, None)] * 3 and fit.best is not None
    assert ds.fit_epochs(df.limit(0)).log == []
    holes = df.withColumn("X", F.when(F.col("dt") > dt.date(2020, 1, 3), F.col("X")))
    assert ds.fit_epochs(holes, ds.Descent("mse", "sgd", 0.1, 4, 1, 3, 2)).best is not None


@pytest.mark.parametrize("size", [7, 40])
def test_pieces_of_a_shard_bound_what_a_task_holds_and_keep_the_log(spark, monkeypatch, size):
    how = ds.Descent("log_cosh", "adam", 0.05, 32, 4, 4, 3)
    df = samples(spark)
    whole = ds.fit_epochs(df, how)
    monkeypatch.setattr(ds, "PIECE_ROWS", size)
    dealt = ds._sharded(df, 3, -(-300 // (3 * size)))
    width = F.length("block") / 8 / (F.col("inputs") + F.col("targets") + 1)
    held = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(width).alias("n")).collect()
    assert sum(r.n for r in held) == 300 and max(r.n for r in held) <= 3 * size
    cut = ds.fit_epochs(df, how)
    close_to(np.array(cut.log), np.array(whole.log), 1e-12)
    close_to(cut.best.w, whole.best.w, 1e-12)


def windows(spark, lengths, inputs=10):
    return sq.tail_validation(sq.sequences(sc.fit_scale(to_spark(spark, random_bars(3, lengths))), inputs))


def raw_bytes(df):
    return df.select(sum(F.length(c) for c, kind in df.dtypes if kind == "binary").alias("n")).agg(F.sum("n")).first()[0]


def test_what_a_fit_keeps_on_disk_does_not_grow_with_the_window(spark, monkeypatch):
    kept, real = [], ds.materialise
    monkeypatch.setattr(ds, "materialise", lambda df, **how: kept.append(real(df, **how)) or kept[-1])
    lengths = {"a": 400, "b": 300, "c": 12, "d": 5}
    for inputs in (5, 20):
        fit = ds.fit_epochs(windows(spark, lengths, inputs), ds.Descent("mse", "adam", 0.01, 16, 2, 2, 3))
        assert len(fit.log) == 2
    # A row has six features, a target, a place and the rest.
    assert [raw_bytes(df) <= 100 * sum(lengths.values()) for df in kept] == [True, True]


def test_windows_come_back_from_runs_as_they_were(spark, monkeypatch):
    monkeypatch.setattr(ds, "BLOCK_BYTES", 3000)
    df = windows(spark, {"a": 150, "b": 60, "c": 11}, 4).filter("dt != '2001-03-01' and sample % 17 != 0")
    want = {r.place: (*np.ravel(r.X), 1.0, *r.y) for r in df.select("X", "y", F.xxhash64(F.lit(1), "series_id", "dt").alias("place")).collect()}
    got = {}
    for r in ds._sharded(df, 2, 3).collect():
        places = np.frombuffer(r.place, np.int64)
        rows = np.frombuffer(r.block).reshape(len(places), -1)
        got |= {int(p): tuple(v) for p, v in zip(places, rows, strict=True)}
    assert got == want and len(want) == df.count()


@pytest.mark.parametrize("size", [20, 1 << 19])
def test_ranges_are_on_disk_one_at_a_time_and_keep_the_log(spark, monkeypatch, size):
    how, df = ds.Descent("log_cosh", "adam", 0.02, 16, 3, 4, 3), windows(spark, {"a": 300, "b": 200})
    whole, live, seen = ds.fit_epochs(df, how), [], []
    pinned, released = ds.pinned, ds.released

    def pin(rows):
        assert not live
        live.append(pinned(rows))
        seen.append(raw_bytes(live[0]))
        return live[0]

    monkeypatch.setattr(ds, "pinned", pin)
    monkeypatch.setattr(ds, "released", lambda rows: released(rows) or live.clear())
    monkeypatch.setattr(ds, "LEAST_ROOM", 0)
    monkeypatch.setattr(ds, "PIECE_ROWS", size)
    cut = ds.fit_epochs(df, how)
    stored = raw_bytes(ds._stored(df, how.shards))
    assert not live and len(seen) >= 3 * how.epochs and max(seen) <= 1.3 * ds.RUNS_ROOM * stored
    close_to(np.array(cut.log), np.array(whole.log), 1e-12)
    close_to(cut.best.w, whole.best.w, 1e-12)


def test_samples_of_one_place_are_read_in_the_same_order_however_they_came():
    rng = np.random.default_rng(5)
    place, rows = rng.integers(0, 6, 50), rng.integers(0, 3, (50, 4)).astype(float)
    shuffled = rng.permutation(50)
    first, second = rows[ds._order(place, rows)], rows[shuffled][ds._order(place[shuffled], rows[shuffled])]
    assert np.array_equal(first, second) and np.array_equal(np.sort(place), place[ds._order(place, rows)])


def test_shuffle_files_go_with_the_table_that_needed_them(spark):
    outputs, name = spark.sparkContext._jsc.sc().env().mapOutputTracker(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = ds.pinned(spark.range(1000).repartitionById(3, F.col("id").cast("int") % 3))
    (shuffle,) = last_shuffles(held)
    assert held.count() == held.count() == 1000 and outputs.containsShuffle(shuffle)
    ds.released(held)
    assert not outputs.containsShuffle(shuffle)
    before = spark.conf.get(name, None)
    assert ds.materialise(spark.range(9).repartition(3), keep_shuffles=False).count() == 9
    assert spark.conf.get(name, None) == before


def test_samples_with_a_null_anywhere_are_left_out(spark):
    df = windows(spark, {"a": 120, "b": 60}, 4).withColumn("at", F.xxhash64("series_id", "dt") % 7)
    null = F.lit(None).cast("double")
    inside = F.transform("X", lambda row, i: F.transform(row, lambda v, j: F.when((i == 1) & (j == 2), null).otherwise(v)))
    x = F.when(F.col("at") == 1, inside).when(F.col("at") == 2, F.slice("X", 1, 3)).otherwise(F.col("X"))
    x = F.when(F.col("at") == 2, F.concat(x, F.array(F.lit(None).cast("array<double>")))).when(F.col("at") != 3, x)
    y = F.when(F.col("at") == 4, F.array(null)).when(F.col("at") != 5, F.col("y"))
    holes, how = df.withColumns({"X": x, "y": y}), ds.Descent("mse", "adam", 0.02, 16, 2, 2, 3)
    got, want = ds.fit_epochs(holes, how), ds.fit_epochs(df.filter("at in (0, 6) or at < 0"), how)
    close_to(np.array(got.log), np.array(want.log), 1e-12)
    close_to(got.best.w, want.best.w, 1e-12)
    assert df.filter("at between 1 and 5").select("at").distinct().count() == 5 and len(want.log) == 2
