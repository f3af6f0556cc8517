"""Daily bars kept up incrementally: late raw rows rewrite the months they touch and nothing else.

A store holds one state row per series and day, partitioned by month: the keys and prices of the day's
first and last raw row, its high, low and exact volume. States merge, so raw rows may come in any order and
number of batches; the table is the same as one built from all of them. A batch reads and overwrites
only its months. Values that run over all time are carried forward over one summary row a month.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import order_key
from tidemark.session import materialise

_DAY = ("series_id", "dt")
_EXACT = "decimal(38,6)"


def day_states(
    rows: DataFrame, *, series: str | Column, ts: str, price: str | Column, volume: str | Column,
    sequence: list[tuple[str, int]], adj_price: str | Column | None = None,
) -> DataFrame:
    """Mergeable states of raw rows, with the parameters of ``daily_bars``. Rows without a series, day,
    order or price have no state."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    price = column(price)
    ticks = rows.select(
        column(series).cast("string").alias("series_id"), F.col(ts).cast("date").alias("dt"), order_key(sequence).alias("_seq"),
        price.alias("_p"), (price if adj_price is None else column(adj_price)).alias("_a"), column(volume).cast(_EXACT).alias("_v"),
    ).na.drop("any")
    return ticks.groupBy(*_DAY).agg(
        F.min("_seq").alias("open_key"), F.min_by("_p", "_seq").alias("open"), F.max("_seq").alias("close_key"),
        F.max_by("_p", "_seq").alias("close"), F.max_by("_a", "_seq").alias("adj_close"), F.max("_p").alias("high"),
        F.min("_p").alias("low"), F.sum("_v").cast(_EXACT).alias("volume"),
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One state per series and day from several."""
    return states.groupBy(*_DAY).agg(
        F.min("open_key").alias("open_key"), F.min_by("open", "open_key").alias("open"), F.max("close_key").alias("close_key"),
        F.max_by("close", "close_key").alias("close"), F.max_by("adj_close", "close_key").alias("adj_close"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").cast(_EXACT).alias("volume"),
    )


@dataclass
class BarStore:
    """A folder with the states (``days``) and the names of the batches that are in them (``batches``)."""

    spark: SparkSession
    path: str

    def _read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{table}")
        except AnalysisException as err:
            if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def has(self, batch: str) -> bool:
        done = self._read("batches")
        return done is not None and not done.filter(F.col("batch") == batch).isEmpty()

    def apply(self, states: DataFrame, batch: str) -> list:
        """Merges a batch of states in and returns the months it rewrote; a batch that is in already changes nothing.

        The months' new content is computed and checkpointed before any file is replaced. The batch is marked
        as done after that, in a second write: if the job dies between the two, the batch is in but not marked, so
        it must not be applied again.
        """
        if self.has(batch):
            return []
        new = materialise(states.withColumn("month", F.trunc("dt", "MM")))
        months = [r.month for r in new.select("month").distinct().orderBy("month").collect()]  # one value a month
        if months:
            old = self._read("days")
            whole = new if old is None else old.filter(F.col("month").isin(months)).select(*new.columns).unionByName(new)
            days = materialise(merged_states(whole).withColumn("month", F.trunc("dt", "MM")))
            # A month is one file per task that holds its rows; ranges keep a month in few tasks.
            dealt = days.repartitionByRange("month", "series_id").sortWithinPartitions("month", *_DAY)
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{self.path}/days")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return months

    def days(self) -> DataFrame:
        """Bars with their month; filters on the month read its partitions only."""
        found = self._read("days")
        if found is None:
            raise ValueError(f"{self.path} has no batch yet")
        return found.select(*_DAY, "open", "high", "low", "close", "adj_close", F.col("volume").cast("double").alias("volume"), "month")

    def months(self) -> DataFrame:
        """One summary row per series and month: rows, high of the closes, volume."""
        return self.days().groupBy("series_id", "month").agg(
            F.count(F.lit(1)).alias("n"), F.max("close").alias("top"), F.sum(F.col("volume").cast(_EXACT)).alias("sold")
        )

    def running(self) -> DataFrame:
        """Bars with ``rn``, ``running_high`` (of the close) and ``running_volume`` since the series began.

        Running values start in each month from what the months before it come to, so no task holds more than
        a month of a series.
        """
        before = Window.partitionBy("series_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
        carried = self.months().select(
            "series_id", "month", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.max("top").over(before).alias("_top"),
            F.coalesce(F.sum("sold").over(before), F.lit(0)).alias("_sold"),
        )
        here = Window.partitionBy("series_id", "month").orderBy("dt")
        upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.days().withColumns(
            {"_rn": F.row_number().over(here), "_high": F.max("close").over(upto), "_vol": F.sum(F.col("volume").cast(_EXACT)).over(upto)}
        )
        return rows.join(carried, ["series_id", "month"]).select(
            "series_id", "dt", "close", (F.col("_n") + F.col("_rn")).cast("bigint").alias("rn"),
            F.greatest("_top", "_high").alias("running_high"), (F.col("_sold") + F.col("_vol")).cast("double").alias("running_volume"),
        )
