"""Bars and parameters for the registered queries, from the shared star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import ForecastSpec
from tidemark.operators.tournament import Plan
from tidemark.sources import daily_bars
from tidemark.sources.upkeep import day_states

# Parameters inside the tables' date range (1995 to 2001); one event lies after its end.
EVENTS = (
    ("1996-03-23", "spring"),
    ("1998-06-06", "summer"),
    ("2000-01-01", "millennium"),
    ("2010-01-01", "after the end"),
)
REGIMES = (
    ("1995-01-01", "1997-01-01", "early"),
    ("1997-01-01", "2000-01-01", "middle"),
    ("2000-01-01", None, "late"),
)
PERIODS = ((1995, 1997), (1998, 2001), (1990, 1999))
BASE_YEAR = 1996
BASE_HORIZON = 5
RATES = (0.1, 0.5)
EPOCHS = 60
PATIENCE = 5
PENALTIES = (0.0, 0.01, 0.1, 1.0)
GRAM_PENALTIES = (0.0, 0.1, 1.0)
GRAM_SPEC = ForecastSpec("ridge2", 2, 1, 1, close_only=True)
GRID_FEATURES = ("open", "high", "low", "close", "adj_close")
CHUNK_ROWS = 512
SPAN_SERIES = 10
SKETCHED = (0.1, 0.5, 0.9)
TOURNAMENT = Plan()

# (column, decimal digits): unique within a series-day, most significant first.
_LINE_ORDER = [("l_orderkey", 13), ("l_linenumber", 2), ("l_partkey", 12), ("l_suppkey", 11)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_bars(spark, sf_dir, series="l_returnflag", start=None, end=None) -> DataFrame:
    """Daily bars of shipped lines: few long series by flag, or many by supplier or part."""
    return daily_bars(
        table(spark, sf_dir, "lineitem"),
        series=series,
        ts="l_shipdate",
        price="l_extendedprice",
        adj_price=F.col("l_extendedprice") * (1 - F.col("l_discount")),
        volume="l_quantity",
        sequence=_LINE_ORDER,
        start=start,
        end=end,
    )


def flag_bars(spark, sf_dir) -> DataFrame:
    return line_bars(spark, sf_dir, "l_returnflag")


def supplier_bars(spark, sf_dir) -> DataFrame:
    return line_bars(spark, sf_dir, "l_suppkey")


def line_ticks(spark, sf_dir) -> DataFrame:
    """Raw priced rows: many a day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("dt"), F.col("l_extendedprice").alias("close")
    )


def line_texts(spark, sf_dir) -> DataFrame:
    """Shipped lines as text a file would hold, some of them damaged by their order's key."""
    key, price = F.col("l_orderkey"), F.col("l_extendedprice")
    fields = F.array(
        F.when(key % 41 == 0, "n/a").otherwise(F.col("l_shipdate").cast("date").cast("string")),
        F.when(key % 43 == 0, "x").otherwise(price.cast("string")),
        F.when(key % 53 == 0, price - 5).otherwise(price + 1).cast("string"),
        (price - 1).cast("string"),
        price.cast("string"),
        F.when(key % 61 == 0, "NaN").otherwise(price.cast("string")),
        F.col("l_quantity").cast("string"),
    )
    kept = F.when(key % 47 == 0, F.slice(fields, 1, 6)).otherwise(fields)
    text = F.when(key % 59 == 0, "").otherwise(F.concat_ws(",", kept))
    return table(spark, sf_dir, "lineitem").select(text.alias("value"), F.col("l_returnflag").alias("flag"))


def line_states(spark, sf_dir, rows: DataFrame) -> DataFrame:
    return day_states(
        rows, series="l_returnflag", ts="l_shipdate", price="l_extendedprice", volume="l_quantity", sequence=_LINE_ORDER,
        adj_price=F.col("l_extendedprice") * (1 - F.col("l_discount")),
    )


def order_bars(spark, sf_dir) -> DataFrame:
    return daily_bars(
        table(spark, sf_dir, "orders"),
        series="o_orderpriority",
        ts="o_orderdate",
        price="o_totalprice",
        volume=F.lit(1.0),
        sequence=[("o_orderkey", 18)],
    )


def arrivals(spark, sf_dir) -> DataFrame:
    """An event table that grows with the data: the day after each shipped line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("series_id"),
        F.date_add(F.col("l_shipdate").cast("date"), 1).alias("event_date"),
        "l_orderkey",
    )


def order_spans(spark, sf_dir) -> DataFrame:
    """Many long intervals per series: each order keeps its customer's supplier busy for up to two years."""
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return orders.select(
        (F.col("o_custkey") % SPAN_SERIES + 1).cast("string").alias("series_id"),
        day.alias("start"),
        F.when(F.col("o_orderkey") % 50 != 0, F.date_add(day, (F.col("o_orderkey") % 700).cast("int"))).alias("end"),
        F.col("o_orderkey").alias("label"),
    )


def order_seasons(spark, sf_dir) -> DataFrame:
    """Overlapping intervals from the orders table: each order year, reaching 90 days on."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return (
        orders.groupBy(F.year("d").alias("y"))
        .agg(F.min("d").alias("start"), F.date_add(F.max("d"), 90).alias("end"))
        .select("start", "end", F.col("y").cast("string").alias("label"))
    )
