"""Successive halving over forecaster configurations, with nested data budgets.

A configuration is a look-back (the mean of so many predecessors predicts the close) and a ridge
penalty. Rungs have growing budgets, shares of each series' training samples chosen by a hash, so a
rung's samples hold those of the rung below. A rung reads only what it adds to them, and only for
look-backs that are still in; its moments are added to those of the rungs below, which is all a fit
or a validation loss needs. After each rung the best configurations of a bracket are promoted.
Brackets trade the number of configurations against the budget they start with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import LOOKBACKS, TRAIN_RATIO, VALIDATION_RATIO
from tidemark.operators.indicators import lagged_means
from tidemark.operators.scaling import chronological_split
from tidemark.plans import PLAIN, Layout
from tidemark.session import materialise

_SUMS = ("n", "x", "y", "xx", "xy", "yy")


@dataclass(frozen=True)
class Plan:
    """``rungs`` budgets, each ``eta`` times the one before and the last one all samples; after a rung
    one in ``eta`` of a bracket's configurations goes on, at least one."""

    sizes: tuple[int, ...] = LOOKBACKS
    penalties: tuple[float, ...] = (0.0, 0.1, 1.0)
    eta: int = 3
    rungs: int = 3

    def budgets(self) -> list[float]:
        return [float(self.eta) ** (r + 1 - self.rungs) for r in range(self.rungs)]

    def limits(self) -> list[str]:
        """Upper bounds of the samples' hashes (eight hex digits), a rung each; the last has none."""
        return [f"{int(b * 2**32):08x}" for b in self.budgets()[:-1]] + ["g"]

    def entrants(self) -> list[tuple[int, int, int, float]]:
        """``(bracket, first rung, inputs, penalty)``. Bracket b starts at rung b; the later it starts, the fewer
        configurations it takes, those that come first in an order drawn per bracket."""
        cells = [(k, float(p)) for k in self.sizes for p in self.penalties]
        out = []
        for b in range(self.rungs):
            order = sorted(cells, key=lambda c: hashlib.md5(f"{b}/{c[0]}/{c[1]}".encode(), usedforsecurity=False).hexdigest())
            share = self.rungs / (self.rungs - b) / self.eta**b
            out += [(b, b, *c) for c in order[: max(1, min(len(cells), round(len(cells) * share)))]]
        return out


def _samples(bars: DataFrame, plan: Plan, ratio: float, validation: float, decimals: int | None, layout: Layout) -> DataFrame:
    """Training rows with the past means of every size, their rung, and where validation begins for each size."""
    split = chronological_split(bars.select("series_id", "dt", "close"), ratio, layout)
    rows = lagged_means(split.filter("is_train"), plan.sizes, decimals=decimals, layout=layout)
    hashed = F.substring(F.md5(F.concat_ws("/", "series_id", F.col("dt").cast("string"))), 1, 8)
    rung = reduce(lambda later, r: F.when(hashed < r[1], r[0]).otherwise(later), reversed(list(enumerate(plan.limits()))), F.lit(None))
    cells = [
        F.struct(
            F.lit(k).alias("inputs"),
            F.col(f"past{k}").alias("x"),
            (F.col("rn") - k > F.floor((F.col("split_at") - k) * F.lit(1.0 - validation))).alias("late"),
        )
        for k in plan.sizes
    ]
    return rows.select("series_id", F.col("close").alias("y"), rung.cast("int").alias("rung"), F.array(*cells).alias("cells"))


def _sums(rows: DataFrame) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    terms = {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    return rows.groupBy("series_id", "inputs").agg(*[F.sum(terms[c]).cast("double").alias(c) for c in _SUMS])


def _loss(penalty: Column) -> tuple[Column, Column, Column]:
    """Slope, intercept and validation loss of a ridge fit on one standardised input, from ``t_`` and ``v_`` sums."""
    n = F.col("t_n")
    cov = F.col("t_xy") / n - F.col("t_x") / n * (F.col("t_y") / n)
    var = F.col("t_xx") / n - F.col("t_x") / n * (F.col("t_x") / n)
    a = F.coalesce(F.try_divide(cov, var * (1 + penalty)), F.lit(0.0))
    b = F.col("t_y") / n - F.col("_a") * (F.col("t_x") / n)
    v = {c: F.col(f"v_{c}") / F.col("v_n") for c in _SUMS}
    s, c = F.col("_a"), F.col("_b")
    return a, b, v["yy"] - 2 * s * v["xy"] - 2 * c * v["y"] + s * s * v["xx"] + 2 * s * c * v["x"] + c * c


def tournament(
    bars: DataFrame,
    plan: Plan = Plan(),
    *,
    ratio: float = TRAIN_RATIO,
    validation: float = VALIDATION_RATIO,
    decimals: int | None = 2,
    loss_digits: int | None = None,
    layout: Layout = PLAIN,
) -> DataFrame:
    """``(series_id, bracket, rung, inputs, penalty, budget, n_train, val_loss, promoted)``: every
    configuration that was tried at a rung, for each series.

    ``promoted`` marks the configurations that go on to the next rung, at the last one the bracket's
    winner: the smallest validation losses (rounded to ``loss_digits`` first, if given), then the smallest
    parameters. The penalty is the share of the input's variance that is added to it. The validation loss is taken on
    the last samples of the training rows, all of them at every rung. A configuration without a sample
    in its budget, or without validation samples, is not tried. Any run gives the same rows.
    """
    rows = materialise(_samples(bars, plan, ratio, validation, decimals, layout))
    spark = bars.sparkSession
    entrants = plan.entrants()
    lists = [F.struct(*[F.lit(v).alias(n) for v, n in zip(e, ("bracket", "first", "inputs", "penalty"), strict=True)]) for e in entrants]
    series = rows.select("series_id").distinct()
    everyone = materialise(series.select("series_id", F.inline(F.array(*lists))))
    one = rows.select("series_id", "y", "rung", F.inline("cells")).filter(F.col("x").isNotNull())
    held_out = materialise(_sums(one.filter("late")).withColumnsRenamed({c: f"v_{c}" for c in _SUMS}))
    keys, cell = ["series_id", "inputs"], ["inputs", "penalty"]
    alive, moments, out = None, None, None
    for rung, budget in enumerate(plan.budgets()):
        entering = everyone.filter(F.col("first") == rung).drop("first")
        tried = entering if alive is None else alive.unionByName(entering)
        # Brackets that have not begun yet will need this slice too.
        wanted = tried.select(*keys).unionByName(everyone.filter(F.col("first") > rung).select(*keys)).distinct()
        added = _sums(one.filter((F.col("rung") == rung) & ~F.col("late")).join(wanted, keys, "left_semi"))
        if moments is not None:
            kept = moments.join(wanted, keys, "left_semi")
            added = kept.unionByName(added).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])
        moments = materialise(added)
        ready = tried.join(moments.withColumnsRenamed({c: f"t_{c}" for c in _SUMS}), keys).join(held_out, keys)
        slope, intercept, loss = _loss(F.col("penalty"))
        loss = F.round(loss, loss_digits) if loss_digits is not None else loss
        losses = ready.withColumn("_a", slope).withColumn("_b", intercept).withColumn("val_loss", loss)
        bracket = Window.partitionBy("series_id", "bracket")
        keep = F.lit(1) if rung + 1 == plan.rungs else F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(bracket) / plan.eta))
        place = F.row_number().over(bracket.orderBy("val_loss", *cell))
        judged = materialise(
            losses.select(
                "series_id", "bracket", F.lit(rung).alias("rung"), *cell, F.lit(budget).alias("budget"),
                F.col("t_n").cast("bigint").alias("n_train"), "val_loss", (place <= keep).alias("promoted"),
            )
        )
        out = judged if out is None else out.unionByName(judged)
        alive = judged.filter("promoted").select("series_id", "bracket", *cell)
    return out if out is not None else spark.createDataFrame([], "series_id string")


def winners(results: DataFrame) -> DataFrame:
    """The best configuration of each series over the brackets' winners: ``series_id, inputs, penalty, val_loss``."""
    last = results.filter("promoted").groupBy("series_id").agg(F.max("rung").alias("_last"))
    final = results.filter("promoted").join(last, "series_id").filter("rung = _last")
    best = F.min_by(F.struct("inputs", "penalty", "val_loss"), F.struct("val_loss", "inputs", "penalty")).alias("_b")
    return final.groupBy("series_id").agg(best).select("series_id", "_b.*")


def rung_costs(results: DataFrame, keys: Sequence[str] = ("bracket", "rung")) -> DataFrame:
    """Configurations, promotions and training samples per rung, over all series."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("configs"), F.count_if("promoted").alias("promotions"), F.sum("n_train").alias("samples")
    )
