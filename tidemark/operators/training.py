"""Training logs: full-batch fits that leave an epoch log, and the analytics over such logs.

A log has one row per (series, model, epoch): ``loss, mse, val_loss, val_mse``; epochs count
from 0. Per-log windows are bounded by the number of epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import CONVERGENCE_QUANTILE, TRAIN_RATIO, VALIDATION_RATIO
from tidemark.operators.scaling import chronological_split, fit_scale
from tidemark.plans import PLAIN, Layout, over_series

LOG = ("series_id", "model")


def training_pairs(
    bars: DataFrame,
    *,
    ratio: float = TRAIN_RATIO,
    validation: float = VALIDATION_RATIO,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Scaled one-step pairs ``x`` (previous close), ``y`` (close) of the training rows, with
    ``is_validation`` on the last share of each series' samples."""
    narrow = bars.select("series_id", "dt", "close")
    scaled = fit_scale(narrow, ("close",), layout=layout)
    split = chronological_split(scaled, ratio, layout)
    lagged = over_series(
        split, lambda df, w: df.withColumn("x", F.lag("close").over(w)), layout, before=1
    )
    kept = F.floor((F.col("split_at") - 1) * F.lit(1.0 - validation))
    return lagged.filter(F.col("is_train") & F.col("x").isNotNull()).select(
        "series_id",
        "dt",
        "x",
        F.col("close").alias("y"),
        (F.col("rn") - 1 > kept).alias("is_validation"),
    )


def _means(part: Column, tag: str) -> list[Column]:
    x, y = F.when(part, F.col("x")), F.when(part, F.col("y"))
    terms = {"x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    return [F.avg(v).alias(f"{tag}_{k}") for k, v in terms.items()]


def gradient_descent_log(
    pairs: DataFrame, rates: Sequence[float] = (0.1, 0.5), epochs: int = 60
) -> DataFrame:
    """Epoch log of fitting ``y = a*x + b`` by full-batch gradient descent from (0, 0).

    One model per learning rate. The squared loss and its gradient depend on the data only
    through five means, so the rows are read once, by one partial aggregate per series; every
    epoch after that is arithmetic on the five means. Training cost does not grow with epochs
    times rows, and no job runs per epoch.
    """
    part = F.col("is_validation")
    stats = pairs.groupBy("series_id").agg(*_means(~part, "t"), *_means(part, "v"))

    def mse(a: Column, b: Column, tag: str) -> Column:
        m = {k: F.col(f"{tag}_{k}") for k in ("x", "y", "xx", "xy", "yy")}
        return m["yy"] - 2 * a * m["xy"] - 2 * b * m["y"] + a * a * m["xx"] + 2 * a * b * m["x"] + b * b

    def step(state: Column, _epoch: Column) -> Column:
        a, b, rate = state["a"], state["b"], F.col("rate")
        grad_a = 2 * (a * F.col("t_xx") + b * F.col("t_x") - F.col("t_xy"))
        grad_b = 2 * (a * F.col("t_x") + b - F.col("t_y"))
        moved = F.struct((a - rate * grad_a).alias("a"), (b - rate * grad_b).alias("b"))
        return F.struct(
            moved["a"].alias("a"), moved["b"].alias("b"), F.array_append(state["path"], moved).alias("path")
        )

    start = F.struct(
        F.lit(0.0).alias("a"),
        F.lit(0.0).alias("b"),
        F.array().cast("array<struct<a:double,b:double>>").alias("path"),
    )
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), start, step)
    runs = stats.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    a, b = F.col("at.a"), F.col("at.b")
    return (
        runs.withColumn("_path", walk["path"])
        .select("*", F.posexplode("_path").alias("epoch", "at"))
        .select(
            "series_id",
            F.concat(F.lit("gd_"), F.col("rate").cast("string")).alias("model"),
            "epoch",
            mse(a, b, "t").alias("loss"),
            mse(a, b, "t").alias("mse"),
            mse(a, b, "v").alias("val_loss"),
            mse(a, b, "v").alias("val_mse"),
        )
    )


def number_epochs(legacy: DataFrame) -> DataFrame:
    """``epoch`` for a log file that only has row order. Valid straight after reading one
    file in one split; logs written here carry the epoch as a column."""
    at = Window.orderBy(F.monotonically_increasing_id())
    one = legacy.coalesce(1)  # a log is tens of rows
    return one.withColumn("epoch", (F.row_number().over(at) - 1).cast("int"))


def epoch_summary(log: DataFrame, keys: tuple[str, ...] = LOG) -> DataFrame:
    """Best epoch (first on ties; the last one without validation), best loss, and the gap
    between validation and training loss at the last epoch."""
    at_val = F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "epoch"))
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("epochs"),
        F.coalesce(F.min_by("epoch", at_val), F.max("epoch")).alias("best_epoch"),
        F.coalesce(F.min("val_loss"), F.min("loss")).alias("best_loss"),
        F.coalesce(
            F.max_by(F.col("val_loss") - F.col("loss"), F.col("epoch")), F.lit(0.0)
        ).alias("final_gap"),
    )


def convergence_epoch(
    log: DataFrame, q: float = CONVERGENCE_QUANTILE, keys: tuple[str, ...] = LOG
) -> DataFrame:
    """First epoch whose loss change is below its ``q`` quantile; the middle of logs of at
    most five epochs; 0 when no epoch qualifies."""
    in_log = Window.partitionBy(*keys)
    moved = log.withColumn(
        "_change", F.abs(F.col("loss") - F.lag("loss").over(in_log.orderBy("epoch")))
    )
    bar = moved.withColumn("_bar", F.percentile("_change", q).over(in_log))
    n = F.count(F.lit(1))
    calm = F.min(F.when(F.col("_change") < F.col("_bar"), F.col("epoch")))
    middle = F.floor(n / 2).cast("int")
    return bar.groupBy(*keys).agg(
        F.when(n > 5, F.coalesce(calm, F.lit(0))).otherwise(middle).alias("converge_epoch")
    )


def overfit_epochs(log: DataFrame, keys: tuple[str, ...] = LOG) -> DataFrame:
    """Epochs after the best one."""
    best = epoch_summary(log, keys).select(*keys, "best_epoch")
    return log.join(best, list(keys)).filter(F.col("epoch") > F.col("best_epoch"))


def early_stop(log: DataFrame, patience: int, keys: tuple[str, ...] = LOG) -> DataFrame:
    """Where a patience rule ends each log: the stop epoch (NULL when it never triggers) and
    the best epoch up to there, whose parameters would be kept."""
    order = Window.partitionBy(*keys).orderBy("epoch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best_before = F.min("val_loss").over(before)
    better = best_before.isNull() | (F.col("val_loss") < best_before)
    tracked = log.withColumn("_better", F.when(better, F.col("epoch"))).withColumn(
        "_last_better", F.max("_better").over(upto)
    )
    waited = F.col("epoch") - F.col("_last_better")
    ended = F.when(waited >= patience, F.col("epoch"))
    return tracked.groupBy(*keys).agg(
        F.min(ended).alias("stop_epoch"),
        F.coalesce(F.min_by("_last_better", ended), F.max("_better")).alias("kept_epoch"),
    )
