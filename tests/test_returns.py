import datetime as dt

import numpy as np
import pytest

from tests.helpers import bars_of, close_to, ordered, random_bars, to_spark
from tidemark.operators import returns as ret
from tidemark.schema import BARS


def _dated(spark, rows):
    full = [(s, dt.date.fromisoformat(d), c, c, c, c, c, 1.0) for s, d, c in rows]
    return spark.createDataFrame(full, BARS)


@pytest.fixture(scope="module")
def bars(spark):
    return _dated(
        spark,
        [
            ("a", "2018-01-02", 10.0), ("a", "2018-12-28", 12.0),
            ("a", "2019-06-03", 20.0),  # one row in the year
            ("a", "2020-01-02", 20.0), ("a", "2020-03-02", 40.0), ("a", "2020-09-01", 40.0), ("a", "2020-12-31", 30.0),
            ("b", "2020-05-04", 8.0), ("b", "2020-05-05", 4.0),
        ],
    )


def test_summary_takes_the_first_date_of_a_tied_high(bars):
    a, b = ret.series_summary(bars).orderBy("series_id").collect()
    assert (a.latest_close, a.latest_date) == (30.0, dt.date(2020, 12, 31))
    assert (a.all_time_high, a.all_time_high_date) == (40.0, dt.date(2020, 3, 2))
    assert b.all_time_high == 8.0


def test_ytd_and_base_year(bars):
    a, b = ret.ytd_return(bars).orderBy("series_id").collect()
    assert a.ytd_return == pytest.approx(50.0) and b.ytd_return == pytest.approx(-50.0)
    a, b = ret.base_year_return(bars, 2018, 2).orderBy("series_id").collect()
    assert a.base_return == pytest.approx(200.0)
    assert a.annualised == pytest.approx((3**0.5 - 1) * 100)
    assert b.base_close is None and b.base_return == 0.0 and b.annualised == 0.0


def test_periods_need_both_years(bars):
    got = ret.period_returns(bars, ((2018, 2020), (2017, 2020), (2018, 2021))).collect()
    assert [(r.series_id, r.start_year, r.end_year) for r in got] == [("a", 2018, 2020)]
    assert got[0].period_return == pytest.approx(200.0)


def test_annual_returns_skip_single_row_years(bars):
    got = ret.annual_returns(bars).orderBy("series_id", "year").collect()
    assert [(r.series_id, r.year) for r in got] == [("a", 2018), ("a", 2020), ("b", 2020)]
    assert [round(r.annual_return, 6) for r in got] == [20.0, 50.0, -50.0]
    assert [round(r.magnitude, 6) for r in got] == [0.4, 1.0, 1.0]
    gap = ret.annual_returns(bars, base="prev_close").collect()
    assert [(r.series_id, r.year, round(r.annual_return, 6)) for r in gap] == [("a", 2020, 50.0)]
    with pytest.raises(ValueError):
        ret.annual_returns(bars, base="other")


def test_annual_summary_breaks_ties_by_year(spark):
    annual = spark.createDataFrame(
        [("a", 2001, 5.0), ("a", 2002, 9.0), ("a", 2003, 9.0), ("a", 2004, -1.0), ("a", 2005, -1.0)],
        "series_id string, year int, annual_return double",
    )
    r = ret.annual_summary(annual).first()
    assert (r.best_year, r.worst_year, r.positive_years, r.n_years) == (2002, 2004, 3, 5)
    assert r.hit_rate == pytest.approx(60.0)


def test_growth_and_its_summary_agree(spark):
    pdf = random_bars(2, {"x": 200, "y": 30}).sort_values(["series_id", "dt"]).reset_index(drop=True)
    bars = to_spark(spark, pdf)
    curve = ordered(ret.growth(bars))
    for s, g in pdf.groupby("series_id"):
        mine = curve[curve["series_id"] == s]
        days = np.array([(d - g["dt"].iloc[0]).days for d in g["dt"]])
        close_to(mine["portfolio"], g["close"] / g["close"].iloc[0] * 1000)
        close_to(mine["risk_free"], 1000 * 1.06 ** (days / 365.25))
        end = ret.growth_summary(bars).filter(f"series_id = '{s}'").first()
        close_to([end.final_portfolio, end.final_risk_free], mine.iloc[-1][["portfolio", "risk_free"]])
        assert end.outperformance == pytest.approx(end.final_portfolio / end.final_risk_free)
        assert end.cagr == pytest.approx(((end.final_portfolio / 1000) ** (365.25 / days[-1]) - 1) * 100)


def test_one_row_series_has_no_growth_rate(spark):
    r = ret.growth_summary(bars_of(spark, {"a": [3.0]})).first()
    assert r.final_portfolio == 1000.0 and r.cagr is None
    assert ret.annual_returns(bars_of(spark, {"a": [3.0]})).count() == 0
