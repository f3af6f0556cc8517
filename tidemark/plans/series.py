"""Two ways to run an ordered window over every series.

*Plain*: one window partition per series. One shuffle. A daily series has at most 366 rows a
year, so this is bounded however large the raw data is, and it is the default.

*Chunked*: for series of any length. Rows get their position in the series without bringing
the series together (count per block, then a running total over the block counts), positions
are cut into chunks of ``chunk_rows``, each chunk borrows the few neighbour rows that bounded
frames reach into, and the window runs per (series, chunk). No task ever holds more than a
block or a chunk, so one series may hold most of the data.

Both give the same rows and values; ``layout_for`` picks by a checked row count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.schema import ORDER, SERIES

_BLOCK, _CHUNK, _HALO = "_block", "_chunk", "_halo"


@dataclass(frozen=True)
class Layout:
    """How ordered windows are partitioned.

    ``chunk_rows=None`` is the plain layout. ``block`` must not decrease along ``order`` and
    must be a function of the row alone, so that a lost task recomputes to the same blocks.
    """

    keys: tuple[str, ...] = SERIES
    order: str = ORDER
    chunk_rows: int | None = None
    block: Callable[[Column], Column] = F.year

    @property
    def chunked(self) -> bool:
        return self.chunk_rows is not None

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def keyed(self, *keys: str) -> Layout:
        return Layout(tuple(keys), self.order, self.chunk_rows, self.block)


PLAIN = Layout()


def layout_for(df: DataFrame, layout: Layout = PLAIN, max_rows: int = 1_000_000) -> Layout:
    """The plain layout if every series has at most ``max_rows`` rows, else the chunked one.

    Runs one partial-aggregated count; use it where row counts per series are not known from
    the calendar.
    """
    longest = (
        df.groupBy(*layout.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    )
    if longest <= max_rows:
        return Layout(layout.keys, layout.order, None, layout.block)
    return Layout(layout.keys, layout.order, layout.chunk_rows or max_rows, layout.block)


def number_rows(
    df: DataFrame, layout: Layout = PLAIN, *, rn: str | None = "rn", n: str | None = "n"
) -> DataFrame:
    """Adds the 1-based position in the series (``rn``) and the series length (``n``)."""
    if not layout.chunked:
        if rn:
            df = df.withColumn(rn, F.row_number().over(layout.window()).cast("bigint"))
        if n:
            df = df.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*layout.keys)))
        return df
    blocked = df.withColumn(_BLOCK, layout.block(F.col(layout.order)))
    by = [*layout.keys, _BLOCK]
    totals = blocked.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*layout.keys)
    before = w.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(w).alias("_total"),
    )
    if rn:
        local = Window.partitionBy(*by).orderBy(layout.order)
        blocked = blocked.withColumn("_local", F.row_number().over(local))
    out = blocked.join(totals, by)
    if rn:
        out = out.withColumn(rn, F.col("_before") + F.col("_local"))
    if n:
        out = out.withColumn(n, F.col("_total"))
    return out.drop(_BLOCK, "_local", "_before", "_total")


def over_series(
    df: DataFrame,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    layout: Layout = PLAIN,
    *,
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Runs ``compute(df, window)``, whose frames reach at most ``before`` rows back and
    ``after`` rows ahead of the current row within its series."""
    if not layout.chunked:
        return compute(df, layout.window())
    size = layout.chunk_rows
    if size < max(before, after, 1):
        raise ValueError("chunk_rows must be at least as long as the frame")
    zero = F.col("_rn") - 1
    chunk, pos = F.floor(zero / size).cast("bigint"), zero % size
    copies = [F.struct(chunk.alias("c"), F.lit(False).alias("h"))]
    if before:
        lend = F.struct((chunk + 1).alias("c"), F.lit(True).alias("h"))
        copies.append(F.when(pos >= size - before, lend))
    if after:
        lend = F.struct((chunk - 1).alias("c"), F.lit(True).alias("h"))
        copies.append(F.when((pos < after) & (chunk > 0), lend))
    spread = (
        number_rows(df, layout, rn="_rn", n=None)
        .withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
        .withColumn(_CHUNK, F.col("_copy.c"))
        .withColumn(_HALO, F.col("_copy.h"))
        .drop("_copy", "_rn")
    )
    w = Window.partitionBy(*layout.keys, _CHUNK).orderBy(layout.order)
    return compute(spread, w).filter(~F.col(_HALO)).drop(_CHUNK, _HALO)


def rolling_moments(df: DataFrame, w: WindowSpec, value: str, spans: tuple[int, ...], layout: Layout = PLAIN) -> DataFrame:
    """Adds ``_n<k>``, ``_mean<k>`` and ``_m2<k>``: count, mean and centred square sum of the values of
    the last k rows, nulls not counted. For use inside ``over_series``, with its window ``w``.

    The moments of the last 1, 2, 4, ... rows are each merged from two neighbours of half that length; a frame is
    merged from the lengths that add up to k. All lags share the window's own order, so the rows are sorted once
    whatever the spans. The cost of a row grows with log k, and nothing is subtracted, so nothing cancels.
    """
    kept, parts = df.columns, ("n", "mean", "m2")
    zero = F.lit(0.0)

    def merged(late: str, early: str) -> dict[str, Column]:
        n1, m1, v1 = (F.coalesce(F.col(f"{early}{c}"), zero) for c in parts)
        n2, m2, v2 = (F.col(f"{late}{c}") for c in parts)
        n, gap = n1 + n2, m2 - m1
        both = F.try_divide(n1 * n2, n) * gap * gap
        mean = F.coalesce(F.try_divide(n1 * m1 + n2 * m2, n), zero)
        return dict(zip(parts, (n, mean, v1 + v2 + F.coalesce(both, zero)), strict=True))

    # _d: the last 2^level rows. _a<k>: the last (k mod 2^level) rows, once there are any.
    known = F.col(value).isNotNull()
    df = df.withColumns({"_dn": known.cast("double"), "_dmean": F.coalesce(F.col(value).cast("double"), zero), "_dm2": F.when(known, F.col(value) * 0).otherwise(0).cast("double")})
    spans, held = tuple(dict.fromkeys(spans)), dict.fromkeys(spans, 0)
    for level in range(max(spans).bit_length()):
        size = 1 << level
        lags: dict[str, Column] = {}
        grown: dict[str, Column] = {}
        for k in spans:
            if not k & size:
                continue
            if held[k]:
                lags |= {f"_p{k}{c}": F.lag(f"_d{c}", held[k]).over(w) for c in parts}
                grown |= {f"_a{k}{c}": v for c, v in merged(f"_a{k}", f"_p{k}").items()}
            else:
                grown |= {f"_a{k}{c}": F.col(f"_d{c}") for c in parts}
            held[k] += size
        if max(spans) >> level + 1:
            lags |= {f"_p{c}": F.lag(f"_d{c}", size).over(w) for c in parts}
            grown |= {f"_d{c}": v for c, v in merged("_d", "_p").items()}
        df = df.withColumns(lags).withColumns(grown).drop(*lags)
    out = [F.when(F.col(f"_a{k}n") > 0, F.col(f"_a{k}mean")).alias(f"_mean{k}") if c == "mean" else F.col(f"_a{k}{c}").alias(f"_{c}{k}") for k in spans for c in parts]
    return df.select(*kept, *out)


def running_max(df: DataFrame, value: str, out: str, layout: Layout = PLAIN) -> DataFrame:
    """Largest value up to and including the row."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not layout.chunked:
        return df.withColumn(out, F.max(value).over(layout.window().rowsBetween(*upto)))
    by = [*layout.keys, _BLOCK]
    blocked = df.withColumn(_BLOCK, layout.block(F.col(layout.order)))
    tops = blocked.groupBy(*by).agg(F.max(value).alias("_top"))
    earlier = (
        Window.partitionBy(*layout.keys)
        .orderBy(_BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    tops = tops.select(*by, F.max("_top").over(earlier).alias("_earlier"))
    local = Window.partitionBy(*by).orderBy(layout.order).rowsBetween(*upto)
    return (
        blocked.withColumn("_here", F.max(value).over(local))
        .join(tops, by)
        .withColumn(out, F.greatest("_earlier", "_here"))
        .drop(_BLOCK, "_here", "_earlier")
    )


def first_row_value(
    df: DataFrame, values: dict[str, str], layout: Layout = PLAIN
) -> DataFrame:
    """Adds, for each ``out: column``, the column's value on the first row of the series."""
    if not layout.chunked:
        w = layout.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({o: F.first(c).over(w) for o, c in values.items()})
    firsts = df.groupBy(*layout.keys).agg(
        *[F.min_by(c, layout.order).alias(o) for o, c in values.items()]
    )
    return df.join(firsts, list(layout.keys))


def quantile(
    df: DataFrame, value: str, q: float, out: str, layout: Layout = PLAIN, bins: int = 1024
) -> DataFrame:
    """Exact quantile per key with linear interpolation between the two nearest ranks.

    The plain layout uses Spark's percentile, which gathers a key's distinct values in one
    task. The chunked one never does: equal values are counted first, the counts per value
    range tell which ranges hold the wanted ranks, and only those ranges are ranked, each in
    its own task.
    """
    keys = list(layout.keys)
    if not layout.chunked:
        return df.groupBy(*keys).agg(F.percentile(value, q).alias(out))
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ends = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    share = F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    binned = counts.join(ends, keys).select(
        *keys, "_v", "_n", F.coalesce(F.floor(share * bins), F.lit(0)).cast("int").alias("_bin")
    )
    w = Window.partitionBy(*keys)  # at most bins + 1 rows per key
    before = w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_in_bin"))
        .withColumn("_before", F.coalesce(F.sum("_in_bin").over(before), F.lit(0)))
        .withColumn("_at", (F.sum("_in_bin").over(w) - 1) * F.lit(float(q)))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in_bin")))
        .groupBy(*keys, "_bin", "_before", "_at")
        .agg(F.min("_rank").alias("_r0"), F.max("_rank").alias("_r1"))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    ranked = (
        binned.join(totals, [*keys, "_bin"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )
    holds = lambda r: (F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_upto"))
    weight = F.lit(0.0)
    for r in ("_r0", "_r1"):
        part = F.greatest(1 - F.abs(F.col("_at") - F.col(r)), F.lit(0.0))
        same = F.col("_r0") == F.col("_r1")
        use = holds(r) & (~same if r == "_r1" else F.lit(True))
        weight = weight + F.when(use, part).otherwise(F.lit(0.0))
    return ranked.groupBy(*keys).agg(F.sum(F.col("_v") * weight).alias(out))
