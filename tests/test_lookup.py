import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import random_bars, to_spark
from tidemark.operators import lookup as lk


@pytest.fixture(scope="module")
def data(spark):
    pdf = random_bars(9, {"a": 120, "b": 30, "c": 1})
    return pdf, to_spark(spark, pdf).cache()


def _next(pdf, series, day):
    rows = pdf[(pdf["series_id"] == series) & (pdf["dt"] >= day)].sort_values("dt")
    return None if rows.empty else (rows["dt"].iloc[0], rows["close"].iloc[0])


EVENTS = [("2000-01-01", "before"), ("2001-01-20", "early"), ("2001-03-05", "mid"), ("2030-01-01", "after")]


def test_event_list_matches_brute_force(data):
    pdf, bars = data
    want = set()
    for s in pdf["series_id"].unique():
        for d, label in EVENTS:
            hit = _next(pdf, s, dt.date.fromisoformat(d))
            if hit:
                want.add((s, label, *hit))
    got = {(r.series_id, r.label, r.dt, r.close) for r in lk.events_asof(bars, EVENTS).collect()}
    assert got == want and not any(label == "after" for _, label, *_ in got)


@pytest.mark.parametrize("block", [None, F.year, lambda c: c])
def test_event_table_matches_brute_force(spark, data, block):
    pdf, bars = data
    rng = np.random.default_rng(1)
    days = [dt.date(2000, 11, 1) + dt.timedelta(days=int(x)) for x in rng.integers(0, 500, 300)]
    rows = [("abcd"[i % 4], d, i) for i, d in enumerate(days)]
    events = spark.createDataFrame(rows, "series_id string, event_date date, id int")
    want = {(i, *hit) for s, d, i in rows if (hit := _next(pdf, s, d))}
    got = {(r.id, r.dt, r.close) for r in lk.asof_forward(events, bars, block=block).collect()}
    assert got == want


def test_event_table_keeps_every_copy_of_a_hot_event(spark, data):
    _, bars = data
    events = spark.createDataFrame([("a", dt.date(2001, 1, 5))] * 50, "series_id string, event_date date")
    assert lk.asof_forward(events, bars).count() == 50


def test_value_may_be_null_at_the_event(spark):
    rows = [("a", dt.date(2020, 1, 1), None), ("a", dt.date(2020, 1, 2), 5.0)]
    df = spark.createDataFrame(rows, "series_id string, dt date, rvol30 double")
    r = lk.events_asof(df, [("2019-12-31", "e")], ("rvol30",)).first()
    assert r.dt == dt.date(2020, 1, 1) and r.rvol30 is None


REGIMES = [("2001-01-10", "2001-02-01", "one"), ("2001-02-01", None, "two")]


def test_regime_edges(spark):
    days = ["2001-01-09", "2001-01-10", "2001-01-31", "2001-02-01", "2030-01-01"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "dt date")
    got = {str(r.dt): r.regime for r in lk.tag_regimes(df, REGIMES).collect()}
    assert got == {"2001-01-10": "one", "2001-01-31": "one", "2001-02-01": "two", "2030-01-01": "two"}


def test_interval_table_matches_brute_force(spark, data):
    pdf, bars = data
    spans = [("1999-05-01", "2001-01-15", "w"), ("2001-01-10", "2001-03-01", "x"), ("2001-02-01", None, "y"), ("2003-01-01", "2004-01-01", "z")]
    rows = [(dt.date.fromisoformat(a), b and dt.date.fromisoformat(b), c) for a, b, c in spans]
    intervals = spark.createDataFrame(rows, "start date, end date, label string")
    want = {
        (s, d, c)
        for s, d in zip(pdf["series_id"], pdf["dt"])
        for a, b, c in rows
        if a <= d and (b is None or d < b)
    }
    got = [(r.series_id, r.dt, r.label) for r in lk.interval_join(bars, intervals).collect()]
    assert len(got) == len(want) and set(got) == want


def test_models_share_a_log(spark):
    models = spark.createDataFrame([("m1",), ("m2",), ("unknown",)], "model string")
    logs = spark.createDataFrame([("base", 0, 1.0), ("base", 1, 0.5), ("other", 0, 9.0)], "model string, epoch int, loss double")
    got = lk.with_log_of_model(models, logs, {"m1": "base", "m2": "base"}).collect()
    assert sorted((r.model, r.epoch) for r in got) == [("m1", 0), ("m1", 1), ("m2", 0), ("m2", 1)]


def _cells(df):
    return df.select("lo", "hi", lk.dyadic_cover(F.col("lo"), F.col("hi")).alias("c"))


def test_covers_are_exact_and_small(spark):
    rng = np.random.default_rng(2)
    pairs = [(0, 1), (5, 5), (9, 3), (0, 1 << 22), (15, 17), (16, 32), (255, 4097), ((1 << 22) - 1, 1 << 22)]
    pairs += [tuple(sorted(map(int, rng.integers(0, 9000, 2)))) for _ in range(200)]
    for lo, hi, cells in _cells(spark.createDataFrame(pairs, "lo int, hi int")).collect():
        spans = sorted((c.cell << 4 * c.level, (c.cell + 1) << 4 * c.level) for c in cells)
        assert len(cells) <= 30 * 6 and spans == sorted(set(spans))
        at = lo
        for a, b in spans:  # they follow each other without a gap
            assert a == at
            at = b
        assert at == hi or (hi <= lo and not spans)


@pytest.mark.parametrize("keyed", [True, False])
def test_interval_join_matches_brute_force(spark, data, keyed):
    pdf, bars = data
    rng = np.random.default_rng(3)
    spans = [(str(s), dt.date(2001, 1, 1) + dt.timedelta(days=int(a)), dt.date(2001, 1, 1) + dt.timedelta(days=int(a + n)), i)
             for i, (s, a, n) in enumerate(zip(rng.choice(["a", "b", "z"], 150), rng.integers(-400, 300, 150), rng.integers(-3, 500, 150)))]
    spans += [("a", dt.date(1, 1, 1), None, 1000), ("b", dt.date(2001, 2, 1), None, 1001), ("a", None, dt.date(2002, 1, 1), 1002), ("a", dt.date(1900, 1, 1), dt.date(9999, 12, 31), 1003)]
    table = spark.createDataFrame(spans, "series_id string, start date, end date, label long")
    rows = bars.select("series_id", "dt", "close")
    got = lk.interval_join(rows, table, ("series_id",)) if keyed else lk.interval_join(rows, table.drop("series_id"))
    assert got.columns == ["series_id", "dt", "close", "start", "end", "label"]
    want = sorted(
        (r.series_id, r.dt, label) for r in pdf.itertuples() for s, a, b, label in spans
        if a is not None and a <= r.dt and (b is None or r.dt < b) and (not keyed or s == r.series_id)
    )
    assert sorted((r.series_id, r.dt, r.label) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert lk.interval_join(rows.limit(0), table.drop("series_id")).collect() == []
    assert lk.interval_join(rows, table.limit(0), ("series_id",)).collect() == []


def test_many_intervals_are_combined_before_the_join_and_never_broadcast(spark):
    day = lambda i: F.date_add(F.lit("2001-01-01").cast("date"), i.cast("int"))
    ids = spark.range(20_000)
    table = ids.select((F.col("id") % 2).cast("string").alias("series_id"), day(F.col("id") % 50).alias("start"),
                       day(F.col("id") % 50 + F.col("id") % 900).alias("end"), F.col("id").alias("label"))
    rows = spark.range(400).select((F.col("id") % 4).cast("string").alias("series_id"), day(F.col("id")).alias("dt"))
    parts = [F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.sum("label").alias("total")]
    merged = [F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("total").alias("total")]
    plain, combined = lk.interval_join(rows, table, ("series_id",)), lk.interval_join(rows, table, ("series_id",), combine=parts)
    by = ("series_id", "dt")
    assert sorted(combined.groupBy(*by).agg(*merged).collect()) == sorted(plain.groupBy(*by).agg(*parts).collect())
    assert combined.columns == ["series_id", "dt", "n", "low", "total"] and combined.count() <= 6 * rows.count()
    for df in (plain, combined, lk.interval_join(rows, table.drop("series_id"))):
        joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line and "_cell" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)
