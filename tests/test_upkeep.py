import datetime as dt
import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import random_bars, to_spark
from tidemark.operators import quantiles as qt
from tidemark.sources import checked, daily_bars
from tidemark.sources.upkeep import BarStore, day_states, merged_states

SEQ = [("k", 12)]


def ticks(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(400)), i, round(rng.uniform(1, 99), 2), round(rng.uniform(0, 5), 3)) for i in range(n)]
    return spark.createDataFrame(rows, "s string, d date, k long, p double, v double").cache()


def states(rows):
    return day_states(rows, series="s", ts="d", price="p", volume="v", sequence=SEQ)


def content(df):
    return sorted(map(tuple, df.collect()))


def files(path):
    return {f: open(f, "rb").read() for f in glob.glob(f"{path}/days/month=*/*.parquet")}


def test_late_rows_in_any_order_give_the_full_rebuild(spark, tmp_path):
    rows = ticks(spark)
    full = BarStore(spark, str(tmp_path / "full"))
    full.apply(states(rows), "all")
    for seed in (1, 2):
        parts = rows.randomSplit([1.0] * 4, seed=seed)
        store = BarStore(spark, str(tmp_path / f"parts{seed}"))
        for i, part in enumerate(parts if seed == 1 else reversed(parts)):
            store.apply(states(part), f"b{i}")
        assert content(store.days()) == content(full.days())
        assert content(store.running()) == content(full.running())
    plain = daily_bars(rows, series="s", ts="d", price="p", volume="v", sequence=SEQ)
    got = {r[:2]: r[2:7] for r in content(full.days())}
    assert got == {(r.series_id, r.dt): (r.open, r.high, r.low, r.close, r.adj_close) for r in plain.collect()}


def test_a_batch_rewrites_its_months_only_and_once(spark, tmp_path):
    rows = ticks(spark)
    store = BarStore(spark, str(tmp_path))
    store.apply(states(rows), "first")
    before = files(tmp_path)
    late = rows.filter("d between '2020-03-05' and '2020-03-09'").withColumn("k", F.col("k") + 100_000)
    assert store.apply(states(late), "late") == [dt.date(2020, 3, 1)]
    after = files(tmp_path)
    assert {f: b for f, b in before.items() if "2020-03" not in f} == {f: b for f, b in after.items() if "2020-03" not in f}
    assert any(f not in before for f in after)
    want = content(store.days())
    assert store.apply(states(late), "late") == [] and content(store.days()) == want and store.has("first")
    assert store.apply(states(rows.limit(0)), "none") == [] and content(store.days()) == want
    plan = store.days().filter(F.col("month") == dt.date(2020, 3, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_running_values_carry_over_months(spark, tmp_path):
    rows = ticks(spark, 1500)
    store = BarStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.days()
    store.apply(states(rows), "x")
    got = store.running().toPandas().sort_values(["series_id", "dt"])
    days = store.days().toPandas().sort_values(["series_id", "dt"])
    for s, g in got.groupby("series_id"):
        d = days[days.series_id == s]
        assert list(g.rn) == list(range(1, len(d) + 1))
        np.testing.assert_allclose(g.running_high, d.close.cummax())
        np.testing.assert_allclose(g.running_volume, d.volume.cumsum())


def test_states_merge_and_skip_incomplete_rows(spark):
    rows = ticks(spark, 300)
    holes = rows.withColumn("p", F.when(F.col("k") % 7 > 0, F.col("p")))
    parts = states(holes.filter("k % 2 = 0")).unionByName(states(holes.filter("k % 2 = 1")))
    assert content(merged_states(parts)) == content(states(holes)) == content(states(holes.filter("p is not null")))


LINES = [
    ("2020-01-02,1,2,0.5,1.5,1.4,100", None), ("2020-01-02 00:00:00, 1 ,2,0.5,1.5,1.4,1e3", None), ("", "empty"), (None, "empty"), ("   ", "empty"),
    ("2020-01-02,1,2,0.5,1.5,1.4", "columns"), ("2020-01-02,1,2,0.5,1.5,1.4,7,8", "columns"), ("2020-13-02,1,2,0.5,1.5,1.4,7", "dt"), (",1,2,0.5,1.5,1.4,7", "dt"),
    ("2020-01-02,x,2,0.5,1.5,1.4,7", "open"), ("2020-01-02,1,,0.5,1.5,1.4,7", "high"), ("2020-01-02,1,2,NaN,1.5,1.4,7", "low"), ("2020-01-02,1,2,0.5,Infinity,1.4,7", "close"),
    ("bad,x,2,0.5,1.5,1.4,7", "dt"), ("2020-01-02,1,2,0.5,1.5,1.4,seven", "volume"), ("2020-01-02,1,0.4,0.5,1.5,1.4,7", "range"), ('2020-01-02,"1",2,0.5,1.5,1.4,7', None),
    ("Date,Open,High,Low,Close,Adj Close,Volume", "dt"),
]


def test_every_line_is_accepted_or_rejected_with_a_reason(spark, tmp_path):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(LINES)], "id int, value string")
    judged = checked.judged_lines(df, "XYZ")
    assert [r.reason for r in judged.orderBy("id").collect()] == [want for _, want in LINES]
    good, bad = checked.accepted(judged), checked.rejected(judged)
    assert good.count() + bad.count() == len(LINES) and good.filter("close = 1.5").count() == good.count() == 3
    assert {r.line for r in bad.collect()} == {line for line, want in LINES if want}
    whole = checked.judged_lines(df.select(F.concat(F.lit("S1,"), "value").alias("value")), fields=("series_id", *checked.FIELDS))
    assert checked.accepted(whole).select("series_id").distinct().collect()[0][0] == "S1"
    (tmp_path / "a.txt").write_text("\n".join(line or "" for line, _ in LINES))
    read = checked.read_checked(spark, str(tmp_path), "XYZ")
    assert checked.accepted(read).count() == 3 and read.select("file").distinct().count() == 1
    assert checked.judged_lines(df.limit(0), "X").collect() == []


def test_sketched_quantiles_stay_within_their_bound(spark):
    bars = to_spark(spark, random_bars(2, {"a": 3000, "b": 20})).unionByName(to_spark(spark, random_bars(3, {"c": 9000})))
    months = qt.month_sketches(bars)
    assert months.agg(F.sum("n")).first()[0] == 12020
    est = qt.merged_sketches(months, "all").unionByName(qt.merged_sketches(months, "year"))
    rows = qt.rank_check(bars, qt.sketched_quantiles(est, (0.0, 0.25, 0.5, 0.99, 1.0))).collect()
    assert rows and all(r.within_bound for r in rows)
    assert {r.n for r in rows if r.level == "all"} == {3000, 20, 9000}
    wrong = qt.sketched_quantiles(est, (0.5,)).withColumn("q", F.lit(0.6))
    assert not any(r.within_bound for r in qt.rank_check(bars, wrong).filter("level = 'all' and n > 1000").collect())
    assert qt.month_sketches(bars.limit(0)).collect() == []
