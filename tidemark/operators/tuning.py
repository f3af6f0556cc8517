"""Grid search and look-back sweeps, and the analytics over their score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import (
    GRID_FOLDS,
    LOOKBACKS,
    NORM_EPS,
    TRAIN_RATIO,
    VALIDATION_RATIO,
)
from tidemark.operators.evaluate import error
from tidemark.operators.forecast import (
    default_estimator,
    fit_forecaster,
    fit_horizons,
    moment_samples,
    score,
    solves_normal_equations,
)
from tidemark.operators.indicators import lagged_means
from tidemark.operators.scaling import chronological_split, fit_scale
from tidemark.operators.sequences import contiguous_folds, sequences, tail_validation
from tidemark.plans import PLAIN, Layout, over_series
from tidemark.schema import FEATURES
from tidemark.session import materialise

# --- searches -----------------------------------------------------------------------------


def ridge_grid_scores(
    bars: DataFrame,
    features: Sequence[str] = FEATURES[:5],
    penalties: Sequence[float] = (0.0, 0.01, 0.1, 1.0),
    *,
    folds: int = GRID_FOLDS,
    ratio: float = TRAIN_RATIO,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Cross-validated grid over (input feature, ridge penalty), for every series at once.

    Each cell predicts the scaled close from one scaled feature a row earlier; folds are
    contiguous; the score is minus the mean squared error averaged over folds. Moments per
    (series, fold) from one hash aggregate are all a ridge fit or its error needs, so the rows
    are read once however many cells and folds there are.
    """
    cols = tuple(dict.fromkeys((*features, "close")))
    narrow = bars.select("series_id", "dt", *cols)
    scaled = fit_scale(narrow, cols, layout=layout)
    split = chronological_split(scaled, ratio, layout)
    lagged = over_series(
        split,
        lambda df, w: df.withColumns({f"x_{f}": F.lag(f).over(w) for f in features}),
        layout,
        before=1,
    )
    samples = contiguous_folds(
        lagged.filter(F.col("is_train") & (F.col("rn") > 1))
        .withColumn("sample", F.col("rn") - 1)
        .withColumn("samples", F.col("split_at") - 1),
        folds,
    )
    y = F.col("close")
    sums = samples.groupBy("series_id", "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("y"),
        F.sum(y * y).alias("yy"),
        *[
            F.sum(term).alias(f"{name}_{f}")
            for f in features
            for name, term in (
                ("x", F.col(f"x_{f}")),
                ("xx", F.col(f"x_{f}") * F.col(f"x_{f}")),
                ("xy", F.col(f"x_{f}") * y),
            )
        ],
    )
    per_feature = sums.select(
        "series_id",
        "fold",
        "n",
        "y",
        "yy",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("param_feature"),
                        F.col(f"x_{f}").alias("x"),
                        F.col(f"xx_{f}").alias("xx"),
                        F.col(f"xy_{f}").alias("xy"),
                    )
                    for f in features
                ]
            )
        ),
    )
    # Training moments of a fold are the totals of the series minus the fold's own: a window
    # over a handful of fold rows.
    others = Window.partitionBy("series_id", "param_feature")
    rest = {f"o_{c}": F.sum(c).over(others) - F.col(c) for c in ("n", "y", "x", "xx", "xy")}
    cells = per_feature.withColumns(rest).withColumn(
        "param_penalty", F.explode(F.array(*[F.lit(float(p)) for p in penalties]))
    )
    on = F.col("o_n")
    cov = F.col("o_xy") / on - F.col("o_x") / on * (F.col("o_y") / on)
    var = F.col("o_xx") / on - F.col("o_x") / on * (F.col("o_x") / on)
    a, b, n = F.col("_a"), F.col("_b"), F.col("n")
    fitted = cells.withColumn("_a", F.try_divide(cov, var + F.col("param_penalty"))).withColumn(
        "_b", F.col("o_y") / on - a * (F.col("o_x") / on)
    )
    sse = (
        F.col("yy")
        - 2 * a * F.col("xy")
        - 2 * b * F.col("y")
        + a * a * F.col("xx")
        + 2 * a * b * F.col("x")
        + n * b * b
    )
    return (
        fitted.withColumn("_mse", sse / n)
        .groupBy("series_id", "param_feature", "param_penalty")
        .agg((-F.avg("_mse")).alias("mean_test_score"))
        .withColumnRenamed("series_id", "model")
    )


def lookback_scores(
    bars: DataFrame,
    sizes: Sequence[int] = LOOKBACKS,
    *,
    ratio: float = TRAIN_RATIO,
    validation: float = VALIDATION_RATIO,
    decimals: int | None = 2,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Validation loss per look-back size: least squares of the close on the mean of its
    ``inputs`` predecessors, fitted on the first samples of the training rows and scored on
    the last. All sizes share one window pass and one aggregate.
    """
    split = chronological_split(bars.select("series_id", "dt", "close"), ratio, layout)
    train = lagged_means(split.filter("is_train"), tuple(sizes), decimals=decimals, layout=layout)
    rows = [
        F.struct(
            F.lit(k).alias("inputs"),
            F.col(f"past{k}").alias("x"),
            (F.col("rn") - k > F.floor((F.col("split_at") - k) * F.lit(1.0 - validation))).alias("late"),
        )
        for k in sizes
    ]
    # One narrow row per size, aggregated where it is made: the rows are already together by
    # series, so the wider table is never shuffled.
    samples = train.select("series_id", F.col("close").alias("y"), F.inline(F.array(*rows)))
    x, y, late = F.col("x"), F.col("y"), F.col("late")
    fit_y = F.when(~late, y)
    terms = {"y": y, "x": x, "xx": x * x, "xy": x * y, "yy": y * y}
    stats = samples.filter(x.isNotNull()).groupBy("series_id", "inputs").agg(
        F.regr_slope(fit_y, x).alias("a"),
        F.regr_intercept(fit_y, x).alias("b"),
        *[F.avg(F.when(late, t)).alias(f"m_{k}") for k, t in terms.items()],
    )
    a, b, m = F.col("a"), F.col("b"), {k: F.col(f"m_{k}") for k in terms}
    loss = m["yy"] - 2 * a * m["xy"] - 2 * b * m["y"] + a * a * m["xx"] + 2 * a * b * m["x"] + b * b
    return stats.select("series_id", "inputs", loss.alias("val_loss")).filter(
        F.col("val_loss").isNotNull()
    )


def cross_validated_grid(
    samples: DataFrame,
    reg_params: Sequence[float] = (1e-6, 1e-3),
    elastic_net: Sequence[float] = (0.0, 0.5, 1.0),
    *,
    folds: int = GRID_FOLDS,
    parallelism: int = 4,
    max_iter: int = 20,
    tol: float = 1e-6,
) -> tuple[DataFrame, CrossValidatorModel]:
    """Spark ML grid search with contiguous folds over pooled samples.

    Returns the score table (mean over folds of minus the MSE) and the fitted search, whose
    ``bestModel`` is refitted on all samples. Every cell is a least squares fit and a mean squared
    error, so the search runs on a few weighted samples with the moments of each fold, for which the
    samples are read once.
    """
    dealt = contiguous_folds(samples, folds).withColumn("y", F.slice("y", 1, 1))
    ready = moment_samples(dealt, ("fold",)).select(
        "features", F.col("y")[0].alias("label"), "fold", "weight"
    )
    lr = LinearRegression(maxIter=max_iter, tol=tol, solver="normal", weightCol="weight")
    grid = (
        ParamGridBuilder()
        .addGrid(lr.regParam, list(reg_params))
        .addGrid(lr.elasticNetParam, list(elastic_net))
        .build()
    )
    search = CrossValidator(
        estimator=lr,
        estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(metricName="mse", weightCol="weight"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    ).fit(ready)
    rows = [
        (float(cell[lr.regParam]), float(cell[lr.elasticNetParam]), -float(mse))
        for cell, mse in zip(grid, search.avgMetrics)
    ]
    spark = samples.sparkSession
    schema = "param_reg double, param_elastic_net double, mean_test_score double"
    return spark.createDataFrame(rows, schema), search


def sweep_lookbacks(
    scaled_train: DataFrame,
    sizes: Sequence[int] = LOOKBACKS,
    *,
    n_features: int = len(FEATURES),
    validation: float = VALIDATION_RATIO,
    estimator=None,
    layout: Layout = PLAIN,
) -> DataFrame:
    """Validation loss of the pooled Spark ML forecaster per look-back size.

    The loop is over the few sizes; each fit and its score is a distributed job. For a linear
    regression by normal equations one pass over a size's windows gives the moments of both parts,
    and fit and loss follow from few weighted samples.
    """
    base = materialise(scaled_train)
    estimator = estimator or default_estimator()
    out = None
    for k in sizes:
        samples = tail_validation(sequences(base, k, 1, n_features, layout=layout), validation)
        if solves_normal_equations(estimator):
            few = moment_samples(samples, ("is_validation",))
            [model] = fit_horizons(few.filter(~F.col("is_validation")), 1, estimator)
            scored = model.transform(few.filter("is_validation")).select(
                F.col("y")[0].alias("y_true"), F.col("prediction").alias("y_pred"), "weight"
            )
            loss = F.try_divide(F.sum(F.col("weight") * error() * error()), F.sum("weight"))
        else:
            models = fit_forecaster(samples.filter(~F.col("is_validation")), 1, estimator)
            scored = score(samples.filter("is_validation"), models, "sweep")
            loss = F.avg(error() * error())
        row = scored.agg(loss.alias("val_loss")).select(F.lit(k).alias("inputs"), "val_loss")
        out = row if out is None else out.unionByName(row)
    return out


# --- score tables -------------------------------------------------------------------------


def best_config(
    scores: DataFrame,
    params: Sequence[str],
    score_col: str = "mean_test_score",
    keys: tuple[str, ...] = ("model",),
) -> DataFrame:
    """The configuration with the highest score per key; ties go to the smallest parameters."""
    ranked = F.struct(-F.col(score_col), *params)
    return (
        scores.groupBy(*keys)
        .agg(F.min_by(F.struct(*params, score_col), ranked).alias("_best"))
        .select(*keys, *[F.col(f"_best.{c}").alias(c) for c in (*params, score_col)])
    )


def score_pivot(
    scores: DataFrame,
    index: str,
    columns: str,
    values: Sequence,
    score_col: str = "mean_test_score",
    keys: tuple[str, ...] = ("model",),
) -> DataFrame:
    """Mean error (the score negated) with one column per value of ``columns``. The values
    are given, so no job looks them up."""
    return (
        scores.groupBy(*keys, index).pivot(columns, list(values)).agg(-F.avg(score_col))
    )


def best_cell(
    scores: DataFrame,
    index: str,
    columns: str,
    score_col: str = "mean_test_score",
    keys: tuple[str, ...] = ("model",),
) -> DataFrame:
    """The (index, column) cell with the lowest mean error."""
    cells = scores.groupBy(*keys, index, columns).agg((-F.avg(score_col)).alias("error"))
    return (
        cells.groupBy(*keys)
        .agg(F.min(F.struct("error", index, columns)).alias("_c"))
        .select(*keys, *[F.col(f"_c.{c}").alias(c) for c in (index, columns, "error")])
    )


def score_lift(
    scores: DataFrame, score_col: str = "mean_test_score", keys: tuple[str, ...] = ("model",)
) -> DataFrame:
    """How many times the worst configuration's error exceeds the best one's."""
    return scores.groupBy(*keys).agg(
        F.try_divide(F.min(score_col), F.max(score_col)).alias("lift")
    )


def mean_score_by(
    scores: DataFrame,
    param: str,
    score_col: str = "mean_test_score",
    keys: tuple[str, ...] = ("model",),
) -> DataFrame:
    return scores.groupBy(*keys, param).agg(F.avg(score_col).alias("mean_score"))


def sweep_summary(sweep: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Best and worst look-back and the improvement of best over worst in percent."""
    at = F.struct("val_loss", "inputs")
    worst = F.struct(-F.col("val_loss"), F.col("inputs"))
    out = sweep.groupBy(*keys).agg(
        F.min_by("inputs", at).alias("best_inputs"),
        F.min("val_loss").alias("best_loss"),
        F.min_by("inputs", worst).alias("worst_inputs"),
        F.max("val_loss").alias("worst_loss"),
    )
    gain = F.try_divide(F.col("worst_loss") - F.col("best_loss"), F.col("worst_loss")) * 100
    return out.withColumn("improvement", gain)


def best_rows(sweep: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` rows with the lowest validation loss; Catalyst turns sort + limit into a
    top-k per task. Equal losses are ordered by the other columns."""
    return sweep.orderBy("val_loss", *[c for c in sweep.columns if c != "val_loss"]).limit(k)


def normalised_loss(sweep: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Adds ``norm_loss``: the loss scaled to [0, 1] within its key (a handful of rows)."""
    group = Window.partitionBy(*keys)
    low, high = F.min("val_loss").over(group), F.max("val_loss").over(group)
    return sweep.withColumn("norm_loss", (F.col("val_loss") - low) / (high - low + NORM_EPS))


def parameter_grid(models: DataFrame, **options: Sequence) -> DataFrame:
    """Every combination of the given option lists for every row of ``models``. Options are
    short literal lists, exploded in place rather than cross-joined."""
    out = models
    for name, values in options.items():
        out = out.withColumn(f"param_{name}", F.explode(F.array(*[F.lit(v) for v in values])))
    return out
