"""Summaries, calendar returns and growth curves. Aggregates only, except the growth curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import (
    BASE_HORIZON_YEARS,
    BASE_YEAR,
    DAYS_PER_YEAR,
    PERIODS,
    RISK_FREE_RATE,
    START_CAPITAL,
)
from tidemark.functions import change_pct
from tidemark.plans import PLAIN, Layout, first_row_value, over_series


def series_summary(bars: DataFrame) -> DataFrame:
    """Per series: latest close and date, highest close and the first date it was reached."""
    return bars.groupBy("series_id").agg(
        F.max_by("close", "dt").alias("latest_close"),
        F.max("dt").alias("latest_date"),
        F.max("close").alias("all_time_high"),
        F.min_by("dt", F.struct(-F.col("close"), F.col("dt"))).alias("all_time_high_date"),
    )


def yearly_closes(bars: DataFrame) -> DataFrame:
    """Per (series, year): first close, last close, number of rows. Hash aggregate, combined
    before the shuffle."""
    return bars.groupBy("series_id", F.year("dt").alias("year")).agg(
        F.min_by("close", "dt").alias("first_close"),
        F.max_by("close", "dt").alias("last_close"),
        F.count(F.lit(1)).alias("n_days"),
    )


def ytd_return(bars: DataFrame) -> DataFrame:
    """Latest close against the first close of the latest year, in percent."""
    latest = yearly_closes(bars).groupBy("series_id").agg(
        F.max("year").alias("year"),
        F.max_by("first_close", "year").alias("year_start"),
        F.max_by("last_close", "year").alias("latest_close"),
    )
    gain = F.coalesce(change_pct(F.col("latest_close"), F.col("year_start")), F.lit(0.0))
    return latest.withColumn("ytd_return", gain)


def base_year_return(
    bars: DataFrame, base_year: int = BASE_YEAR, horizon_years: float = BASE_HORIZON_YEARS
) -> DataFrame:
    """Return since the first close of ``base_year`` (0 when the year is absent), and the
    yearly rate it amounts to over ``horizon_years``."""
    in_base = F.year("dt") == base_year
    out = bars.groupBy("series_id").agg(
        F.max_by("close", "dt").alias("latest_close"),
        F.min_by(F.when(in_base, F.col("close")), F.when(in_base, F.col("dt"))).alias("base_close"),
    )
    gain = F.coalesce(change_pct(F.col("latest_close"), F.col("base_close")), F.lit(0.0))
    yearly = F.pow(1 + F.col("base_return") / 100, F.lit(1.0 / horizon_years)) - 1
    return out.withColumn("base_return", gain).withColumn("annualised", yearly * 100)


def period_returns(bars: DataFrame, periods: tuple[tuple[int, int], ...] = PERIODS) -> DataFrame:
    """First close of the start year to last close of the end year, where both years exist.

    The periods are a short parameter list: each becomes two conditional aggregates of one
    pass, so nothing is joined.
    """
    year, close, dt = F.year("dt"), F.col("close"), F.col("dt")
    aggs, rows = [], []
    for i, (start, end) in enumerate(periods):
        at_start, at_end = year == start, year == end
        aggs.append(F.min_by(F.when(at_start, close), F.when(at_start, dt)).alias(f"_s{i}"))
        aggs.append(F.max_by(F.when(at_end, close), F.when(at_end, dt)).alias(f"_e{i}"))
        rows.append(
            F.struct(
                F.lit(start).alias("start_year"),
                F.lit(end).alias("end_year"),
                F.col(f"_s{i}").alias("start_close"),
                F.col(f"_e{i}").alias("end_close"),
            )
        )
    wide = bars.groupBy("series_id").agg(*aggs)
    return (
        wide.select("series_id", F.inline(F.array(*rows)))
        .filter(F.col("start_close").isNotNull() & F.col("end_close").isNotNull())
        .withColumn("period_return", change_pct(F.col("end_close"), F.col("start_close")))
    )


def annual_returns(bars: DataFrame, base: str = "first_close") -> DataFrame:
    """Percent return per calendar year with its share of the largest absolute return.

    ``base="first_close"`` measures first to last close inside the year, for years with at
    least two rows. ``"prev_close"`` starts from the last close of the year before instead, so
    the gap over the turn of the year counts too.
    """
    if base not in ("first_close", "prev_close"):
        raise ValueError("base must be 'first_close' or 'prev_close'")
    years = yearly_closes(bars)
    by_series = Window.partitionBy("series_id")  # one row per calendar year
    start = F.col("first_close")
    if base == "prev_close":
        before = by_series.orderBy("year")
        adjacent = F.lag("year").over(before) == F.col("year") - 1
        start = F.when(adjacent, F.lag("last_close").over(before))
    rated = (
        years.withColumn("annual_return", change_pct(F.col("last_close"), start))
        .filter(F.col("n_days") >= 2)
        .filter(F.col("annual_return").isNotNull())
    )
    size = F.abs("annual_return")
    return rated.withColumn("magnitude", F.try_divide(size, F.max(size).over(by_series))).select(
        "series_id", "year", "n_days", "annual_return", "magnitude"
    )


def annual_summary(annual: DataFrame) -> DataFrame:
    """Best and worst year (earliest on ties), positive years and hit rate."""
    gain, year = F.col("annual_return"), F.col("year")
    return annual.groupBy("series_id").agg(
        F.min_by("year", F.struct(-gain, year)).alias("best_year"),
        F.max(gain).alias("best_return"),
        F.min_by("year", F.struct(gain, year)).alias("worst_year"),
        F.min(gain).alias("worst_return"),
        F.count_if(gain > 0).alias("positive_years"),
        F.count(F.lit(1)).alias("n_years"),
        (F.count_if(gain > 0) / F.count(F.lit(1)) * 100).alias("hit_rate"),
    )


def growth(
    bars: DataFrame,
    capital: float = START_CAPITAL,
    rate: float = RISK_FREE_RATE,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Adds ``portfolio`` (capital invested at the first close) and ``risk_free`` (capital at a
    fixed yearly rate)."""
    df = first_row_value(bars, {"_first_close": "close", "_first_dt": "dt"}, layout)
    years = F.date_diff("dt", "_first_dt") / F.lit(DAYS_PER_YEAR)
    return df.withColumns(
        {
            "portfolio": F.try_divide(F.col("close"), F.col("_first_close")) * capital,
            "risk_free": capital * F.pow(F.lit(1 + rate), years),
        }
    ).drop("_first_close", "_first_dt")


def growth_summary(
    bars: DataFrame, capital: float = START_CAPITAL, rate: float = RISK_FREE_RATE
) -> DataFrame:
    """Final values of both curves, their ratio and the compound annual growth rate.

    Needs only the first and last row of a series, so it is one hash aggregate, no window.
    """
    ends = bars.groupBy("series_id").agg(
        F.min_by("close", "dt").alias("_first"),
        F.max_by("close", "dt").alias("_last"),
        F.date_diff(F.max("dt"), F.min("dt")).alias("n_days"),
    )
    years = F.col("n_days") / F.lit(DAYS_PER_YEAR)
    multiple = F.col("final_portfolio") / capital
    return (
        ends.withColumn("final_portfolio", F.try_divide(F.col("_last"), F.col("_first")) * capital)
        .withColumn("final_risk_free", capital * F.pow(F.lit(1 + rate), years))
        .withColumn("outperformance", F.col("final_portfolio") / F.col("final_risk_free"))
        .withColumn("cagr", (F.pow(multiple, F.try_divide(F.lit(1.0), years)) - 1) * 100)
        .drop("_first", "_last")
    )


def previous_close(bars: DataFrame, layout: Layout = PLAIN) -> DataFrame:
    """Adds ``prev_close``."""
    return over_series(
        bars, lambda df, w: df.withColumn("prev_close", F.lag("close").over(w)), layout, before=1
    )
