"""Quantiles that merge: stored KLL sketches per series and month, joined upward to years and all time.

A month is sketched once, when its rows are read. Longer periods merge the months' sketches, a few
kilobytes each, and never read rows again. The exact counterpart is ``plans.quantile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy parameter of a sketch, and the rank error it keeps to (99 % of sketches keep to a fifth of it).
SKETCH_K = 800
RANK_ERROR = 0.02

_PERIODS = {"month": "MM", "year": "YYYY"}


def _period(column: Column, level: str) -> Column:
    return F.trunc(column, _PERIODS[level]) if level in _PERIODS else F.lit(None).cast("date")


def month_sketches(rows: DataFrame, value: str = "close", keys: Sequence[str] = ("series_id",), on: str = "dt", k: int = SKETCH_K) -> DataFrame:
    """``(*keys, month, n, sketch binary)`` of the non-null values of each month. Tasks sketch what they
    read, so a series with most of the rows shuffles one sketch per task and month."""
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.trunc(on, "MM").alias("month"), F.col(value).cast("double").alias("_v"))
    return known.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v", k).alias("sketch"))


def merged_sketches(months: DataFrame, level: str, keys: Sequence[str] = ("series_id",), k: int = SKETCH_K) -> DataFrame:
    """``(*keys, level, period, n, sketch)``: sketches of longer periods, ``level`` being month, year or all
    (then the period is NULL)."""
    period = _period(F.col("month"), level).alias("period")
    out = months.groupBy(*keys, period).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return out.select(*keys, F.lit(level).alias("level"), "period", "n", "sketch")


def sketched_quantiles(sketches: DataFrame, qs: Sequence[float]) -> DataFrame:
    """``sketches`` with a row per ``q`` and its estimated ``quantile`` in place of the sketch."""
    each = [F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("quantile")) for q in qs]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], F.inline(F.array(*each)))


def rank_check(
    rows: DataFrame, estimates: DataFrame, value: str = "close", keys: Sequence[str] = ("series_id",), on: str = "dt",
    error: float = RANK_ERROR,
) -> DataFrame:
    """``estimates`` with ``within_bound``: whether the exact rank of each estimated quantile is within
    ``error`` of its q. Reads the rows once; a row meets the few estimates of its own periods."""
    named = ["level", "period", "q"]
    facts = estimates.groupBy(*keys, "level", "period").agg(F.collect_list(F.struct("q", "quantile")).alias("_est"))
    known = rows.filter(F.col(value).isNotNull())
    levels = F.array(*[F.struct(F.lit(x).alias("level"), _period(F.col(on), x).alias("period")) for x in ("month", "year", "all")])
    spread = known.select(*keys, F.col(value).alias("_v"), F.inline(levels))
    # Values are counted before they meet the estimates.
    counted = spread.groupBy(*keys, "level", "period", "_v").agg(F.count(F.lit(1)).alias("_c"))
    at = [*keys, "level", "period"]
    facts = facts.withColumnsRenamed({c: f"_of_{c}" for c in at})
    match = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in at]  # the period of all time is NULL
    met = counted.join(facts, match).select(*at, "_v", "_c", F.inline("_est"))
    share = met.groupBy(*keys, *named, "quantile").agg(
        F.sum("_c").alias("_n"),
        F.sum(F.when(F.col("_v") <= F.col("quantile"), F.col("_c")).otherwise(0)).alias("_upto"),
        F.sum(F.when(F.col("_v") < F.col("quantile"), F.col("_c")).otherwise(0)).alias("_below"),
    )
    near = (F.col("_below") / F.col("_n") - error <= F.col("q")) & (F.col("q") <= F.col("_upto") / F.col("_n") + error)
    return share.select(*keys, *named, F.col("_n").alias("n"), near.alias("within_bound"))
