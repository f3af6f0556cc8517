"""Rolling and running price indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import LABEL_FRACTION, MA_SPANS, PRICE_QUANTILE, TRADING_DAYS, VOL_SPANS
from tidemark.functions import change_pct, safe_ln
from tidemark.plans import PLAIN, Layout, number_rows, over_series, quantile, rolling_moments, running_max


def _add_means(df: DataFrame, w, spans, decimals, value="close", shift=0, prefix="ma") -> DataFrame:
    """Rolling means over ``w``, ending ``shift`` rows before the current one."""
    if decimals is None:
        for k in spans:
            frame = w.rowsBetween(1 - k - shift, -shift)
            full = F.count(value).over(frame) == k
            df = df.withColumn(f"{prefix}{k}", F.when(full, F.avg(value).over(frame)))
        return df
    # Prices with a fixed number of decimals are summed as whole units: the running sum is
    # exact, so a rolling sum is the difference of two running sums, O(1) per row.
    unit = 10**decimals
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_cum", F.sum(F.round(F.col(value) * unit).cast("bigint")).over(upto))
    df = df.withColumn("_pos", F.row_number().over(w))
    for k in spans:
        last = F.lag("_cum", shift).over(w) if shift else F.col("_cum")
        total = last - F.coalesce(F.lag("_cum", k + shift).over(w), F.lit(0))
        mean = total.cast("double") / F.lit(float(unit)) / F.lit(float(k))
        df = df.withColumn(f"{prefix}{k}", F.when(F.col("_pos") >= k + shift, mean))
    return df.drop("_cum", "_pos")


def moving_averages(
    bars: DataFrame,
    spans: tuple[int, ...] = MA_SPANS,
    *,
    decimals: int | None = 2,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Adds ``ma<k>``: mean close of the last k rows, NULL until k rows exist.

    ``decimals`` is the number of decimals prices carry; None averages plain doubles.
    """
    return over_series(
        bars, lambda df, w: _add_means(df, w, spans, decimals), layout, before=max(spans)
    )


def lagged_means(
    bars: DataFrame, spans: tuple[int, ...], *, decimals: int | None = 2, layout: Layout = PLAIN
) -> DataFrame:
    """Adds ``past<k>``: mean close of the k rows before the current one."""
    return over_series(
        bars,
        lambda df, w: _add_means(df, w, spans, decimals, shift=1, prefix="past"),
        layout,
        before=max(spans) + 1,
    )


def drawdown(bars: DataFrame, layout: Layout = PLAIN) -> DataFrame:
    """Adds ``running_high`` and ``drawdown`` (percent below it)."""
    df = running_max(bars, "close", "running_high", layout)
    return df.withColumn("drawdown", change_pct(F.col("close"), F.col("running_high")))


def _add_log_return(df: DataFrame, w) -> DataFrame:
    previous = F.lag("close").over(w)
    return df.withColumn("log_return", safe_ln(F.try_divide(F.col("close"), previous)))


def log_returns(bars: DataFrame, layout: Layout = PLAIN) -> DataFrame:
    """Adds ``log_return`` against the previous row's close."""
    return over_series(bars, _add_log_return, layout, before=1)


def realised_volatility(
    bars: DataFrame,
    spans: tuple[int, ...] = VOL_SPANS,
    *,
    trading_days: int = TRADING_DAYS,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Adds ``log_return`` and ``rvol<k>``: annualised sample deviation of the last k log
    returns in percent, NULL until k returns exist."""

    def compute(df: DataFrame, w) -> DataFrame:
        df = rolling_moments(_add_log_return(df, w), w, "log_return", spans, layout)
        out = {}
        for k in spans:
            spread = F.sqrt(F.try_divide(F.col(f"_m2{k}"), F.lit(float(k - 1))))
            out[f"rvol{k}"] = F.when(F.col(f"_n{k}") == k, spread * F.sqrt(F.lit(float(trading_days))) * 100)
        return df.withColumns(out).drop(*[f"{c}{k}" for k in spans for c in ("_n", "_mean", "_m2")])

    return over_series(bars, compute, layout, before=max(spans))


def volatility_summary(vol: DataFrame, column: str = "rvol30") -> DataFrame:
    """Per series: long-run mean of a volatility column and its latest value."""
    known = F.when(F.col(column).isNotNull(), F.col("dt"))
    return vol.groupBy("series_id").agg(
        F.avg(column).alias("mean_vol"), F.max_by(column, known).alias("current_vol")
    )


def golden_crosses(
    bars: DataFrame,
    spans: tuple[int, int] = MA_SPANS,
    *,
    decimals: int | None = 2,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Rows on which the short mean, below the long one a row earlier, has reached it.

    Only rows where both means exist count; they are missing just at the start of a series,
    so comparing with a NULL predecessor drops exactly the first such row.
    """
    short, long = (f"ma{k}" for k in spans)

    def compute(df: DataFrame, w) -> DataFrame:
        df = _add_means(df, w, spans, decimals)
        was_below = F.lag(short).over(w) < F.lag(long).over(w)
        return df.withColumn("_cross", was_below & (F.col(short) >= F.col(long)))

    rows = over_series(bars, compute, layout, before=max(spans) + 1)
    return rows.filter("_cross").drop("_cross")


def most_recent(rows: DataFrame, k: int = 2, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The latest ``k`` rows per key; the rank limit also applies before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("dt"))
    return rows.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= k).drop("_back")


def day_direction(bars: DataFrame) -> DataFrame:
    """Adds ``direction``: up when the close is not below the open, else down."""
    up = F.col("close") >= F.col("open")
    return bars.withColumn("direction", F.when(up, F.lit("up")).otherwise(F.lit("down")))


def price_quantile(
    bars: DataFrame,
    q: float = PRICE_QUANTILE,
    *,
    exact: bool = True,
    accuracy: int = 10_000,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Per series: quantile of the close; exact with linear interpolation, or approximate."""
    if exact:
        return quantile(bars, "close", q, "close_quantile", layout)
    return bars.groupBy("series_id").agg(
        F.approx_percentile("close", q, accuracy).alias("close_quantile")
    )


def row_at_fraction(
    bars: DataFrame, fraction: float = LABEL_FRACTION, layout: Layout = PLAIN
) -> DataFrame:
    """The row at ``fraction`` of each series."""
    at = F.floor(F.col("n") * F.lit(fraction)) + 1
    return number_rows(bars, layout).filter(F.col("rn") == at)
