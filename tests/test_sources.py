import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.helpers import bars_of, ordered
from tidemark.functions import order_key
from tidemark.schema import BARS, BEST_PARAMS, FEATURES, HISTORY
from tidemark.sources import (
    between_dates,
    conform_bars,
    daily_bars,
    load_scaler,
    load_with_fallback,
    read_bars,
    read_document,
    read_price_csv,
    read_result_csv,
    read_result_table,
    require_rows,
    resolve_scaler,
    save_bars_table,
    save_scaler,
    write_document,
    write_result_csv,
    write_result_table,
)


def _csv(tmp_path, text, name="p.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


HEADER = "Date,Open,High,Low,Close,Adj Close,Volume\n"


def test_csv_is_projected_typed_and_cleaned(spark, tmp_path):
    path = _csv(
        tmp_path,
        "Extra,Volume,Date,Open,High,Low,Close,Adj Close\n"
        "x,10,2020-01-03,1,2,0.5,1.5,1.4\n"
        "x,11,2020-01-02,1,2,0.5,1.25,1.2\n"
        "x,,2020-01-06,1,2,0.5,1.5,1.4\n",
    )
    df = read_price_csv(spark, path, "S")
    assert df.schema.fieldNames() == BARS.fieldNames()
    assert [f.dataType for f in df.schema] == [f.dataType for f in BARS]
    got = ordered(df)
    assert got["dt"].tolist() == [dt.date(2020, 1, 2), dt.date(2020, 1, 3)]  # null row dropped
    assert got["close"].tolist() == [1.25, 1.5]


def test_missing_column_raises(spark, tmp_path):
    path = _csv(tmp_path, "Date,Open\n2020-01-01,1\n")
    with pytest.raises(AnalysisException):
        read_price_csv(spark, path, "S")


def test_bad_dates_raise_or_drop(spark, tmp_path):
    path = _csv(tmp_path, HEADER + "oops,1,1,1,1,1,1\n2020-01-02,1,1,1,1,1,1\n")
    with pytest.raises(Exception):
        read_price_csv(spark, path, "S").collect()
    assert read_price_csv(spark, path, "S", strict_dates=False).count() == 1


def test_names_are_flattened(spark):
    row = ("S", dt.datetime(2020, 1, 1, 9, 30), (1.0,), (2.0,), 1.0, 1.5, 1.4, 9.0)
    schema = (
        "series_id string, Datetime timestamp, Open struct<XYZ:double>, High struct<XYZ:double>, "
        "`('Low', 'XYZ')` double, Close double, `Adj Close` double, Volume double"
    )
    got = conform_bars(spark.createDataFrame([row], schema)).first()
    assert (got.dt, got.open, got.high, got.low, got.adj_close) == (dt.date(2020, 1, 1), 1.0, 2.0, 1.0, 1.4)


def test_date_range_is_half_open_and_pushed_down(spark, tmp_path):
    bars = bars_of(spark, {"a": [1.0, 2.0, 3.0, 4.0]})
    kept = between_dates(bars, "2020-01-02", "2020-01-04")
    assert sorted(r.close for r in kept.collect()) == [2.0, 3.0]
    path = str(tmp_path / "bars")
    bars.write.parquet(path)
    plan = between_dates(read_bars(spark, path), "2020-01-02").select("dt", "close")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dt,2020-01-02)" in text


def test_empty_source_is_rejected_and_fallback_is_flagged(spark, tmp_path):
    empty = spark.createDataFrame([], BARS)
    with pytest.raises(ValueError):
        require_rows(empty)
    good = bars_of(spark, {"a": [1.0]})
    for primary in (lambda: empty, lambda: read_bars(spark, str(tmp_path / "absent"))):
        out = load_with_fallback(primary, lambda: good, ("live", "bundled"))
        assert out.first().source == "bundled"
    assert load_with_fallback(lambda: good, lambda: empty, ("live", "bundled")).first().source == "live"


def test_results_round_trip_and_default_to_empty(spark, tmp_path):
    rows = [("m", 0, 1.0, 1.0, 2.0, 2.0), ("m", 1, 0.5, 0.5, None, None)]
    log = spark.createDataFrame(rows, HISTORY)
    csv, table = str(tmp_path / "log.csv"), str(tmp_path / "log")
    assert read_result_csv(spark, csv, HISTORY).count() == 0
    assert read_result_table(spark, table, HISTORY).count() == 0
    write_result_csv(log, csv)
    write_result_table(log, table)
    for back in (read_result_csv(spark, csv, HISTORY), read_result_table(spark, table, HISTORY)):
        assert sorted(map(tuple, back.collect())) == rows
    write_result_table(log.limit(1), table)  # overwrites
    assert read_result_table(spark, table, HISTORY).count() == 1


def test_document_round_trip(spark, tmp_path):
    path = str(tmp_path / "best")
    write_document(spark.createDataFrame([(224, 30)], BEST_PARAMS), path)
    assert tuple(read_document(spark, path, BEST_PARAMS).first()) == (224, 30)


def test_saved_scaler_wins(spark, tmp_path):
    path = str(tmp_path / "scaler")
    fresh = spark.createDataFrame([("a", 2.0)], "series_id string, close_scale double")
    assert load_scaler(spark, path) is None
    assert resolve_scaler(spark, path, fresh).first().close_scale == 2.0
    save_scaler(spark.createDataFrame([("a", 3.0)], fresh.schema), path)
    assert resolve_scaler(spark, path, fresh).first().close_scale == 3.0


def test_daily_bars_use_first_and_last_row_of_the_day(spark):
    day, later = dt.datetime(2020, 1, 1, 5), dt.datetime(2020, 1, 1, 23)
    raw = spark.createDataFrame(
        [("a", later, 2, 1, 12.0, 1.0), ("a", day, 1, 2, 9.0, 2.0), ("a", day, 1, 1, 10.0, 3.0), ("b", day, 1, 1, 5.0, 4.0)],
        "s string, ts timestamp_ntz, k1 bigint, k2 int, price double, qty double",
    )
    bars = daily_bars(raw, series="s", ts="ts", price="price", volume="qty", sequence=[("k1", 15), ("k2", 10)])
    got = ordered(bars)
    assert got.loc[0, ["open", "high", "low", "close", "adj_close", "volume"]].tolist() == [10.0, 12.0, 9.0, 12.0, 12.0, 6.0]
    assert len(got) == 2


def test_order_key_sorts_like_the_tuple_and_checks_digits(spark):
    rows = [(5, 1, 10**9, 3), (5, 1, 2, 99), (5, 2, 0, 0), (10**12, 0, 0, 1), (0, 7, 7, 7)]
    df = spark.createDataFrame(rows, "a bigint, b int, c bigint, d bigint")
    key = order_key([("a", 13), ("b", 2), ("c", 12), ("d", 11)])
    got = [tuple(r)[:4] for r in df.withColumn("k", key).orderBy("k").collect()]
    assert got == sorted(rows)
    with pytest.raises(Exception, match="does not fit"):
        df.select(order_key([("a", 3), ("b", 2)]).alias("k")).collect()
    with pytest.raises(ValueError):
        order_key([("a", 20), ("b", 20)])


def test_bucketed_bars_need_no_shuffle(spark):
    from tests.helpers import random_bars, to_spark
    from tidemark.operators import indicators as ind

    bars = to_spark(spark, random_bars(1, {s: 40 for s in "abcdefgh"}))
    save_bars_table(bars, "bars_bucketed", 4)
    stored = spark.table("bars_bucketed")
    means = ind.moving_averages(stored, (5,))
    assert "Exchange" not in means._jdf.queryExecution().executedPlan().toString()
    assert ordered(means).equals(ordered(ind.moving_averages(bars, (5,))))
