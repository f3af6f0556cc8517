"""Readers for daily price bars, and raw rows rolled up into bars."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import order_key
from tidemark.schema import FEATURES

# Accepted spellings of the incoming columns, lower-cased with spaces as underscores.
_NAMES = {"date": "dt", "datetime": "dt", **{f: f for f in FEATURES}, "dt": "dt"}


def flatten_names(df: DataFrame) -> DataFrame:
    """Single-level, lower-case names: ``Adj Close`` -> adj_close, ``Datetime`` -> dt.

    A two-level name keeps its first level, whether it comes as a one-field struct column or
    as text such as ``('Close', 'XYZ')``.
    """
    picked: list[Column] = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType) and len(field.dataType) == 1:
            column = column[field.dataType[0].name]
        paired = re.match(r"\(\s*['\"]([^'\"]*)['\"]\s*,", field.name)
        plain = (paired.group(1) if paired else field.name).strip().lower().replace(" ", "_")
        picked.append(column.alias(_NAMES.get(plain, plain)))
    return df.select(*picked)


def conform_bars(df: DataFrame, series_id: str | None = None, *, strict_dates: bool = True) -> DataFrame:
    """The declared bar columns in declared order and type, without incomplete rows.

    Bad dates raise, or become NULL and drop out when ``strict_dates`` is false. A missing
    column raises AnalysisException.
    """
    flat = flatten_names(df)
    if series_id is not None:
        flat = flat.withColumn("series_id", F.lit(series_id))
    if dict(flat.dtypes).get("dt") == "string":
        # Daily text dates may carry a time of day; the day is what counts.
        to_day = F.to_date if strict_dates else F.try_to_date
        day = to_day(F.substring("dt", 1, 10))
    else:
        day = F.col("dt").cast("date")
    return flat.select(
        F.col("series_id").cast("string").alias("series_id"),
        day.alias("dt"),
        *[F.col(f).cast("double").alias(f) for f in FEATURES],
    ).na.drop("any")


def read_price_csv(
    spark: SparkSession, path: str, series_id: str | None = None, *, strict_dates: bool = True
) -> DataFrame:
    """Price CSV with a header. Columns are found by name, so order and extras do not matter."""
    raw = spark.read.option("header", True).csv(path)
    return conform_bars(raw, series_id, strict_dates=strict_dates)


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars stored by Spark (Parquet or ORC); filters and columns reach the scan."""
    return conform_bars(spark.read.format(fmt).load(path))


def between_dates(df: DataFrame, start: str | None = "1980-01-01", end: str | None = None, on: str = "dt") -> DataFrame:
    """Rows with start <= date < end. Compared on the stored column so a scan can push it down."""
    kind = "timestamp_ntz" if dict(df.dtypes)[on] == "timestamp_ntz" else dict(df.dtypes)[on]
    if start is not None:
        df = df.filter(F.col(on) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(F.col(on) < F.lit(end).cast(kind))
    return df


def require_rows(df: DataFrame, what: str = "source") -> DataFrame:
    """The input itself; raises ValueError when it has no row (a one-row probe)."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def load_with_fallback(
    primary: Callable[[], DataFrame],
    fallback: Callable[[], DataFrame],
    names: tuple[str, str] = ("primary", "fallback"),
) -> DataFrame:
    """The primary source, or the fallback when it cannot be read or is empty; the column
    ``source`` says which."""
    try:
        return require_rows(primary()).withColumn("source", F.lit(names[0]))
    except (PySparkException, Py4JJavaError, ValueError, OSError):
        return fallback().withColumn("source", F.lit(names[1]))


def daily_bars(
    rows: DataFrame,
    *,
    series: str | Column,
    ts: str,
    price: str | Column,
    volume: str | Column,
    sequence: list[tuple[str, int]],
    adj_price: str | Column | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Rolls raw priced rows up to one bar per (series, day).

    Open and close are the first and last row of the day by ``sequence``, a list of (integer
    column, digits) that is unique within a series-day. All aggregates combine map-side in a
    hash aggregate, so a series that holds most of the raw rows shuffles one row per task and
    day.
    """
    price = F.col(price) if isinstance(price, str) else price
    adj = price if adj_price is None else F.col(adj_price) if isinstance(adj_price, str) else adj_price
    series = F.col(series) if isinstance(series, str) else series
    volume = F.col(volume) if isinstance(volume, str) else volume
    ticks = between_dates(rows, start, end, on=ts).select(
        series.cast("string").alias("series_id"),
        F.col(ts).cast("date").alias("dt"),
        order_key(sequence).alias("_seq"),
        price.alias("_price"),
        adj.alias("_adj"),
        volume.alias("_volume"),
    )
    return ticks.groupBy("series_id", "dt").agg(
        F.min_by("_price", "_seq").alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", "_seq").alias("close"),
        F.max_by("_adj", "_seq").alias("adj_close"),
        F.sum("_volume").alias("volume"),
    ).na.drop("any")
