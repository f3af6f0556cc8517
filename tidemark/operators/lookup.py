"""Event and regime lookup: forward as-of, interval tagging, keyed lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import EVENTS, REGIMES


def events_asof(
    rows: DataFrame, events: Sequence[tuple[str, str]] = EVENTS, values: tuple[str, ...] = ("close",)
) -> DataFrame:
    """For each series and event: the first row on or after the event date.

    Events are a short parameter list, so each is one conditional aggregate of a single hash
    aggregate: no join, and no event is paired with all later rows. Events after the end of a
    series give no row.
    """
    aggs, out = [], []
    for i, (date, label) in enumerate(events):
        day = F.lit(date).cast("date")
        at = F.when(F.col("dt") >= day, F.col("dt"))
        aggs.append(F.min(at).alias(f"_dt{i}"))
        aggs += [F.min_by(v, at).alias(f"_{v}{i}") for v in values]
        out.append(
            F.struct(
                day.alias("event_date"),
                F.lit(label).alias("label"),
                F.col(f"_dt{i}").alias("dt"),
                *[F.col(f"_{v}{i}").alias(v) for v in values],
            )
        )
    wide = rows.groupBy("series_id").agg(*aggs)
    return wide.select("series_id", F.inline(F.array(*out))).filter(F.col("dt").isNotNull())


def asof_forward(
    events: DataFrame, rows: DataFrame, values: tuple[str, ...] = ("close",), block=None
) -> DataFrame:
    """As :func:`events_asof` for an event *table* ``(series_id, event_date, ...)`` of any size.

    Event dates are reduced to distinct ones first. Both sides meet per (series, block) of
    the calendar, a month unless ``block`` says otherwise: inside a block the next row is
    found by a window, and a block with nothing after the event falls back to the first row
    of a later block. So no task holds a whole series and nothing is paired quadratically.
    """
    block = block or (lambda c: F.trunc(c, "MM"))
    by = ["series_id", "_block"]
    hit = F.struct("dt", *values)
    days = events.select("series_id", F.col("event_date").alias("_at")).distinct()
    sides = (
        days.select("series_id", "_at", F.lit(None).cast(_type(rows, values)).alias("_hit"))
        .unionByName(rows.select("series_id", F.col("dt").alias("_at"), hit.alias("_hit")))
        .withColumn("_block", block(F.col("_at")))
    )
    # Walking back in time, "next row" is the last one seen: a growing frame, O(1) per row.
    seen = (Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*by).orderBy(F.desc("_at"), F.col("_hit").isNull()).rowsBetween(*seen)
    near = sides.withColumn("_near", F.last("_hit", ignorenulls=True).over(back)).filter(
        F.col("_hit").isNull()
    )
    # One row per (series, block): the first row of the block, then of any later block.
    firsts = sides.groupBy(*by).agg(F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("_at"))).alias("_first"))
    later = (
        Window.partitionBy("series_id")
        .orderBy(F.desc("_block"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    firsts = firsts.select(*by, F.last("_first", ignorenulls=True).over(later).alias("_far"))
    found = (
        near.join(firsts, by)
        .select("series_id", F.col("_at").alias("event_date"), F.coalesce("_near", "_far").alias("_hit"))
        .filter(F.col("_hit").isNotNull())
        .select("series_id", "event_date", "_hit.*")
    )
    return events.join(found, ["series_id", "event_date"])


def _type(rows: DataFrame, values: tuple[str, ...]) -> str:
    return rows.select(F.struct("dt", *values).alias("s")).schema["s"].dataType.simpleString()


def regime_of(day: Column, regimes: Sequence[tuple[str, str | None, str]] = REGIMES) -> Column:
    """Label of the half-open interval a date lies in; an open end has no upper bound.

    A parameter list of intervals is a CASE expression: the tag is a projection, not a join.
    """
    label = None
    for start, end, name in regimes:
        inside = day >= F.lit(start).cast("date")
        if end is not None:
            inside = inside & (day < F.lit(end).cast("date"))
        label = F.when(inside, F.lit(name)) if label is None else label.when(inside, F.lit(name))
    return label


def tag_regimes(rows: DataFrame, regimes: Sequence[tuple[str, str | None, str]] = REGIMES) -> DataFrame:
    """Rows with the regime they fall in; rows outside every regime are dropped."""
    return rows.withColumn("regime", regime_of(F.col("dt"), regimes)).filter(F.col("regime").isNotNull())


#: Days are counted from here on and an open interval ends at this power of two, after any date.
_DAY_ZERO, _DAY_BITS = -(1 << 20), 22
#: A cell of level l is 2^(_STEP l) days long and starts at a multiple of that.
_STEP = 4
#: Cells from this level on are shared by so many rows that they are salted.
_WIDE_LEVEL = 2


def _day(column: Column) -> Column:
    return F.unix_date(column) - _DAY_ZERO


def dyadic_cover(start: Column, end: Column) -> Column:
    """The aligned cells that a half-open interval of day numbers is made of, largest inside, none twice:
    ``array<struct<level int, cell int>>``. Up to 15 cells a level and side, empty if end <= start."""

    def climb(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        up_lo, up_hi = F.shiftright(lo + ((1 << _STEP) - 1), _STEP), F.shiftright(hi, _STEP)
        # On the last level, or where no larger cell fits, all that is left is covered with cells of this one.
        last = (level == _DAY_BITS // _STEP) | (up_lo >= up_hi)
        left_end = F.when(last, hi).otherwise(F.shiftleft(up_lo, _STEP))
        right_start = F.when(last, hi).otherwise(F.shiftleft(up_hi, _STEP))
        none = F.array().cast("array<struct<level:int,cell:int>>")

        def cells(a: Column, b: Column) -> Column:
            whole = F.transform(F.sequence(a, b - 1), lambda c: F.struct(level.alias("level"), c.alias("cell")))
            return F.when(a < b, whole).otherwise(none)

        found = F.concat(acc["cells"], cells(lo, left_end), cells(right_start, hi))
        return F.struct(
            F.when(last, 0).otherwise(up_lo).alias("lo"), F.when(last, 0).otherwise(up_hi).alias("hi"), found.alias("cells")
        )

    begin = F.struct(
        start.cast("int").alias("lo"), end.cast("int").alias("hi"), F.array().cast("array<struct<level:int,cell:int>>").alias("cells")
    )
    levels = F.sequence(F.lit(0), F.lit(_DAY_BITS // _STEP))
    return F.aggregate(levels, begin, climb, lambda acc: acc["cells"])


def interval_join(
    rows: DataFrame, intervals: DataFrame, keys: Sequence[str] = (), salts: int = 16, *, combine: Sequence[Column] = ()
) -> DataFrame:
    """Rows with every interval ``(*keys, start, end, ...)`` of a *table* that contains their date.

    Each interval becomes the few aligned cells of 1, 16, 256, ... days that it is made of, and each
    row looks up the one cell of each size that its date lies in: an equi-join whose matches need no
    further check, whatever the intervals' lengths and however many of them there are. With ``keys``
    an interval meets rows of its own series only; without, rows that share a long cell are spread over
    ``salts`` copies of it. A NULL end is open; empty intervals and NULL dates match nothing.

    ``combine`` are named aggregates over interval columns that the caller merges per row afterwards (sums, counts,
    minima): intervals of a cell are reduced to one row before the join, so a row meets one match for each cell
    size however many intervals contain its date, and comes back with those columns instead of the intervals'.
    """
    keys = list(keys)
    payload = [c for c in intervals.columns if c not in keys]
    ends = F.coalesce(_day("end"), F.lit(1 << _DAY_BITS))
    cover = F.explode(dyadic_cover(_day("start"), ends))
    wide = lambda level: F.when(level >= _WIDE_LEVEL, salts).otherwise(1) if not keys else F.lit(1)
    spread = intervals.filter(F.col("start").isNotNull()).select(*keys, F.struct(*payload).alias("_interval"), cover.alias("_c"))
    spread = spread.select(*keys, "_interval", F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell"))
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), wide(F.col("_level")) - 1)))
    day = _day("dt")
    place = F.xxhash64(*[c for c in ("series_id", "dt") if c in rows.columns])
    probes = [
        F.struct(
            F.lit(level).alias("_level"),
            F.shiftright(day, level * _STEP).alias("_cell"),
            F.pmod(place, wide(F.lit(level))).cast("int").alias("_salt"),
        )
        for level in range(_DAY_BITS // _STEP + 1)
    ]
    at = [*keys, "_level", "_cell", "_salt"]
    if combine:
        spread = spread.select(*at, "_interval.*").groupBy(*at).agg(F.struct(*combine).alias("_interval"))
    dated = rows.filter(F.col("dt").isNotNull())
    if keys:
        # Rows without any interval under their key need no probes.
        dated = dated.join(intervals.select(*keys).distinct(), keys, "left_semi")
    probed = dated.select("*", F.inline(F.array(*probes)))
    # Size estimates do not see how many cells an interval becomes: never broadcast them by such an estimate.
    return probed.join(spread.hint("merge"), at).select(*rows.columns, "_interval.*")


def with_log_of_model(models: DataFrame, logs: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Log rows for each model; several models may share a log.

    The mapping is a parameter, so it is a literal map lookup, and the join is on the log name.
    """
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    wanted = models.withColumn("log", F.try_element_at(pairs, F.col("model")))
    return wanted.join(logs.withColumnRenamed("model", "log"), "log").drop("log")
