"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import fixtures as fx
from tidemark.config import LOOKBACKS, REGISTRY
from tidemark.operators import evaluate as ev
from tidemark.operators import forecast as fo
from tidemark.operators import gram as gr
from tidemark.operators import indicators as ind
from tidemark.operators import lookup as lk
from tidemark.operators import quantiles as qt
from tidemark.operators import returns as ret
from tidemark.operators import descent as ds
from tidemark.operators import families as fam
from tidemark.operators import scaling as sc
from tidemark.operators import sequences as sq
from tidemark.operators import training as tr
from tidemark.operators import tournament as to
from tidemark.operators import tuning as tu
from tidemark.plans import PLAIN, Layout, number_rows
from tidemark.schema import FEATURES
from tidemark.session import checkpoint_dir, materialise
from tidemark.sources import checked
from tidemark.sources.upkeep import BarStore

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
LONG = Layout(chunk_rows=fx.CHUNK_ROWS)


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Continuous results compared to a fixed number of decimals."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- ingest -------------------------------------------------------------------------------


@query
def bars_daily(spark, sf):
    return rounded(fx.flag_bars(spark, sf), "adj_close", "volume")


@query
def bars_by_supplier(spark, sf):
    return rounded(fx.supplier_bars(spark, sf), "adj_close", "volume")


@query
def bars_of_orders(spark, sf):
    return rounded(fx.order_bars(spark, sf), "adj_close", "volume")


@query
def bars_in_range(spark, sf):
    bars = fx.line_bars(spark, sf, "l_returnflag", start="1996-06-01", end="1999-06-01")
    return rounded(bars, "adj_close", "volume")


@query
def bars_numbered(spark, sf):
    return number_rows(fx.flag_bars(spark, sf).select("series_id", "dt", "close"))


@query
def checked_lines(spark, sf):
    """Lines accepted and rejected, by reason."""
    judged = checked.judged_lines(fx.line_texts(spark, sf), "all")
    return judged.groupBy("flag", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _upkept(spark, sf):
    """A store to which a third of all raw rows came late."""
    store = BarStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/bars-{uuid.uuid4().hex}")
    rows = fx.table(spark, sf, "lineitem")
    late = F.col("l_orderkey") % 3 == 0
    store.apply(fx.line_states(spark, sf, rows.filter(~late)), "first")
    store.apply(fx.line_states(spark, sf, rows.filter(late)), "late")
    return store


@query
def upkeep_days(spark, sf):
    return rounded(_upkept(spark, sf).days().drop("month"), "adj_close", "volume")


@query
def upkeep_running(spark, sf):
    return _upkept(spark, sf).running()


# --- indicators ---------------------------------------------------------------------------


def _averages(bars, layout=PLAIN):
    return ind.moving_averages(bars.select("series_id", "dt", "close"), layout=layout)


@query
def moving_averages(spark, sf):
    return _averages(fx.flag_bars(spark, sf))


@query
def moving_averages_by_supplier(spark, sf):
    return _averages(fx.supplier_bars(spark, sf))


@query
def moving_averages_long(spark, sf):
    return _averages(fx.flag_bars(spark, sf), LONG)


def _drawdown(bars, layout=PLAIN):
    return rounded(ind.drawdown(bars.select("series_id", "dt", "close"), layout), "drawdown")


@query
def drawdown(spark, sf):
    return _drawdown(fx.flag_bars(spark, sf))


@query
def drawdown_by_supplier(spark, sf):
    return _drawdown(fx.supplier_bars(spark, sf))


@query
def drawdown_long(spark, sf):
    return _drawdown(fx.flag_bars(spark, sf), LONG)


@query
def price_overview(spark, sf):
    """The flagship view: averages, running high and drawdown from one shuffle per series."""
    bars = fx.flag_bars(spark, sf).select("series_id", "dt", "close", "volume")
    return rounded(ind.drawdown(ind.moving_averages(bars)), "drawdown")


@query
def log_returns(spark, sf):
    out = ind.log_returns(fx.flag_bars(spark, sf).select("series_id", "dt", "close"))
    return rounded(out, "log_return")


def _volatility(bars, layout=PLAIN):
    return ind.realised_volatility(bars.select("series_id", "dt", "close"), layout=layout)


@query
def realised_vol(spark, sf):
    return rounded(_volatility(fx.flag_bars(spark, sf)), "log_return", "rvol30", "rvol252", digits=4)


@query
def realised_vol_by_supplier(spark, sf):
    return rounded(_volatility(fx.supplier_bars(spark, sf)), "log_return", "rvol30", "rvol252", digits=4)


@query
def realised_vol_long(spark, sf):
    return rounded(_volatility(fx.flag_bars(spark, sf), LONG), "log_return", "rvol30", "rvol252", digits=4)


@query
def vol_summary(spark, sf):
    out = ind.volatility_summary(_volatility(fx.supplier_bars(spark, sf)))
    return rounded(out, "mean_vol", "current_vol")


def _crosses(bars, layout=PLAIN):
    bars = bars.select("series_id", "dt", "close")
    return ind.most_recent(ind.golden_crosses(bars, layout=layout))


@query
def golden_cross(spark, sf):
    return _crosses(fx.flag_bars(spark, sf))


@query
def golden_cross_by_supplier(spark, sf):
    return _crosses(fx.supplier_bars(spark, sf))


@query
def golden_cross_long(spark, sf):
    return _crosses(fx.flag_bars(spark, sf), LONG)


@query
def updown_volume(spark, sf):
    bars = fx.flag_bars(spark, sf).select("series_id", "dt", "open", "close", "volume")
    return ind.day_direction(bars)


@query
def close_quantile(spark, sf):
    return rounded(ind.price_quantile(fx.supplier_bars(spark, sf)), "close_quantile")


@query
def close_quantile_long(spark, sf):
    return rounded(ind.price_quantile(fx.flag_bars(spark, sf), layout=LONG), "close_quantile")


@query
def row_at_fraction(spark, sf):
    return ind.row_at_fraction(fx.supplier_bars(spark, sf).select("series_id", "dt", "close"))


# --- summaries and returns ----------------------------------------------------------------


@query
def series_summary(spark, sf):
    return ret.series_summary(fx.supplier_bars(spark, sf))


@query
def series_summary_orders(spark, sf):
    return ret.series_summary(fx.order_bars(spark, sf))


@query
def ytd_return(spark, sf):
    return rounded(ret.ytd_return(fx.supplier_bars(spark, sf)), "ytd_return")


@query
def base_year_return(spark, sf):
    out = ret.base_year_return(fx.supplier_bars(spark, sf), fx.BASE_YEAR, fx.BASE_HORIZON)
    return rounded(out, "base_return", "annualised")


@query
def base_year_absent(spark, sf):
    out = ret.base_year_return(fx.flag_bars(spark, sf))
    return rounded(out, "base_return", "annualised")


@query
def period_returns(spark, sf):
    return rounded(ret.period_returns(fx.supplier_bars(spark, sf), fx.PERIODS), "period_return")


@query
def annual_returns(spark, sf):
    out = ret.annual_returns(fx.supplier_bars(spark, sf))
    return rounded(out, "annual_return", "magnitude")


@query
def annual_returns_prev_close(spark, sf):
    out = ret.annual_returns(fx.flag_bars(spark, sf), base="prev_close")
    return rounded(out, "annual_return", "magnitude")


@query
def annual_summary(spark, sf):
    out = ret.annual_summary(ret.annual_returns(fx.supplier_bars(spark, sf)))
    return rounded(out, "best_return", "worst_return", "hit_rate")


@query
def growth_1000(spark, sf):
    out = ret.growth(fx.flag_bars(spark, sf).select("series_id", "dt", "close"))
    return rounded(out, "portfolio", "risk_free")


@query
def growth_summary(spark, sf):
    out = ret.growth_summary(fx.supplier_bars(spark, sf))
    return rounded(out, "final_portfolio", "final_risk_free", "outperformance", "cagr")


# --- lookup -------------------------------------------------------------------------------


@query
def event_asof_price(spark, sf):
    return lk.events_asof(fx.supplier_bars(spark, sf), fx.EVENTS)


@query
def event_asof_vol(spark, sf):
    vol = _volatility(fx.flag_bars(spark, sf))
    return rounded(lk.events_asof(vol, fx.EVENTS, ("rvol30",)), "rvol30")


@query
def event_asof_growth(spark, sf):
    curve = ret.growth(fx.flag_bars(spark, sf))
    return rounded(lk.events_asof(curve, fx.EVENTS, ("portfolio",)), "portfolio")


@query
def event_table_asof(spark, sf):
    bars = fx.supplier_bars(spark, sf).select("series_id", "dt", "close")
    return lk.asof_forward(fx.arrivals(spark, sf), bars)


@query
def regime_tag(spark, sf):
    return lk.tag_regimes(fx.flag_bars(spark, sf).select("series_id", "dt", "close"), fx.REGIMES)


@query
def regime_table_join(spark, sf):
    bars = fx.flag_bars(spark, sf).select("series_id", "dt", "close")
    return lk.interval_join(bars, fx.order_seasons(spark, sf))


@query
def kll_quantile_bounds(spark, sf):
    """Merged sketches against exact ranks, for months, years and all time."""
    ticks = fx.line_ticks(spark, sf)
    months = materialise(qt.month_sketches(ticks))
    levels = [qt.merged_sketches(months, level) for level in ("month", "year", "all")]
    sketches = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return qt.rank_check(ticks, materialise(qt.sketched_quantiles(sketches, fx.SKETCHED)))


@query
def open_intervals_by_bar(spark, sf):
    bars = fx.supplier_bars(spark, sf).select("series_id", "dt")
    parts = [F.count(F.lit(1)).alias("n_open"), F.min("label").alias("first_label"), F.sum("label").alias("label_sum")]
    hits = lk.interval_join(bars, fx.order_spans(spark, sf), ("series_id",), combine=parts)
    return hits.groupBy("series_id", "dt").agg(
        F.sum("n_open").alias("n_open"), F.min("first_label").alias("first_label"), F.sum("label_sum").alias("label_sum")
    )


@query
def param_grid(spark, sf):
    models = fx.supplier_bars(spark, sf).select(F.col("series_id").alias("model")).distinct()
    return tu.parameter_grid(models, feature=fx.GRID_FEATURES, penalty=fx.PENALTIES)


# --- preprocessing ------------------------------------------------------------------------


@query
def minmax_params(spark, sf):
    params = sc.params_by_feature(sc.fit_minmax(fx.supplier_bars(spark, sf)))
    return rounded(rounded(params, "data_min", "data_max", "offset"), "scale", digits=12)


@query
def minmax_params_train(spark, sf):
    params = sc.params_by_feature(sc.fit_minmax(fx.flag_bars(spark, sf), fit_on="train"))
    return rounded(rounded(params, "data_min", "data_max", "offset"), "scale", digits=12)


@query
def minmax_scaled(spark, sf):
    return rounded(sc.fit_scale(fx.supplier_bars(spark, sf)), *FEATURES, digits=9)


@query
def minmax_roundtrip(spark, sf):
    bars = fx.flag_bars(spark, sf)
    params = sc.fit_minmax(bars)
    return rounded(sc.unscale(sc.scale(bars, params), params), *FEATURES, digits=4)


@query
def chrono_split(spark, sf):
    return sc.split_summary(sc.chronological_split(fx.supplier_bars(spark, sf)))


@query
def chrono_split_long(spark, sf):
    return sc.split_summary(sc.chronological_split(fx.flag_bars(spark, sf), layout=LONG))


def _window_digest(samples, *keys):
    """A sample table as scalars: shape, ends and a position-weighted sum of each window."""
    flat = F.flatten("X")
    pairs = F.transform(flat, lambda v, i: v * (i + 1))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)
    digest = samples.select(
        *keys,
        "series_id",
        "dt",
        F.size("X").alias("n_inputs"),
        F.size(flat).alias("n_values"),
        F.element_at(flat, 1).alias("x_first"),
        F.element_at(flat, -1).alias("x_last"),
        total.alias("x_digest"),
        F.element_at("y", 1).alias("y_first"),
        F.element_at("y", -1).alias("y_last"),
        F.element_at("y_dt", -1).alias("last_dt"),
    )
    return rounded(digest, "x_first", "x_last", "x_digest", "y_first", "y_last")


def _scaled(bars, layout=PLAIN):
    return sc.fit_scale(bars, layout=layout)


@query
def seq_windows(spark, sf):
    return _window_digest(sq.sequences(_scaled(fx.flag_bars(spark, sf)), 10, 1, 6))


@query
def seq_windows_by_supplier(spark, sf):
    return _window_digest(sq.sequences(_scaled(fx.supplier_bars(spark, sf)), 15, 1, 6))


@query
def seq_windows_long(spark, sf):
    return _window_digest(sq.sequences(_scaled(fx.flag_bars(spark, sf), LONG), 10, 1, 6, layout=LONG))


@query
def seq_all_shapes(spark, sf):
    """Every registered shape from one window per row."""
    rows = number_rows(_scaled(fx.flag_bars(spark, sf)))
    samples = fam.shared_samples(rows, list(REGISTRY.values()), ("n",))
    return _window_digest(samples, "spec")


@query
def seq_five_features(spark, sf):
    return _window_digest(sq.sequences(_scaled(fx.flag_bars(spark, sf)), 10, 1, 5))


@query
def seq_close_only(spark, sf):
    samples = sq.sequences(_scaled(fx.flag_bars(spark, sf)), 10, 1, 1, close_only=True)
    return _window_digest(samples)


@query
def seq_targets_2(spark, sf):
    return _window_digest(sq.sequences(_scaled(fx.flag_bars(spark, sf)), 7, 2, 6))


@query
def tail_validation(spark, sf):
    samples = sq.tail_validation(sq.sequences(fx.supplier_bars(spark, sf), 10, 1, 1))
    return samples.groupBy("series_id", "is_validation").agg(
        F.count(F.lit(1)).alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")
    )


@query
def kfold_assign(spark, sf):
    samples = sq.contiguous_folds(sq.sequences(fx.supplier_bars(spark, sf), 15, 1, 1), 3)
    return samples.select("series_id", "dt", "fold")


@query
def latest_window(spark, sf):
    latest = sq.latest_window(fx.supplier_bars(spark, sf), 7).select(
        "series_id", "dt", F.posexplode("X").alias("pos", "x")
    )
    values = [F.col("x")[i].alias(f) for i, f in enumerate(FEATURES)]
    return rounded(latest.select("series_id", "dt", "pos", *values), "adj_close", "volume")


# --- forecasts and their evaluation -------------------------------------------------------


def _forecasts(bars, **kwargs):
    return fo.one_lag_forecasts(bars, (1, 2), **kwargs)


@query
def forecast_one_lag(spark, sf):
    return rounded(_forecasts(fx.supplier_bars(spark, sf)), "y_pred", digits=4)


@query
def forecast_warm_start(spark, sf):
    return rounded(_forecasts(fx.flag_bars(spark, sf), warm_start=True), "y_pred", digits=4)


@query
def forecast_one_lag_long(spark, sf):
    return rounded(_forecasts(fx.flag_bars(spark, sf), layout=LONG), "y_pred", digits=4)


@query
def ar2_forecasts(spark, sf):
    return rounded(gr.ar_p(fx.supplier_bars(spark, sf), 2), "y_pred", digits=4)


@query
def ar3_forecasts(spark, sf):
    return rounded(gr.ar_p(fx.supplier_bars(spark, sf), 3), "y_pred", digits=4)


@query
def ar3_forecasts_long(spark, sf):
    return rounded(gr.ar_p(fx.flag_bars(spark, sf), 3, layout=LONG), "y_pred", digits=4)


@query
def fc_metrics(spark, sf):
    out = ev.metrics(_forecasts(fx.supplier_bars(spark, sf)))
    return rounded(rounded(out, "mse", digits=1), "rmse", "mape", digits=3)


@query
def fc_logcosh(spark, sf):
    return rounded(ev.mean_log_cosh(_forecasts(fx.supplier_bars(spark, sf))), "log_cosh", digits=4)


@query
def fc_residuals(spark, sf):
    out = ev.residual_bias(_forecasts(fx.supplier_bars(spark, sf)))
    return rounded(rounded(out, "sigma", "minus_sigma", digits=4), "bias", digits=7)


@query
def fc_residual_series(spark, sf):
    return rounded(ev.residuals(_forecasts(fx.flag_bars(spark, sf))), "y_pred", "residual", digits=4)


@query
def fc_extremes(spark, sf):
    out = ev.extremes(_forecasts(fx.flag_bars(spark, sf)))
    return rounded(out, "max_overshoot", "last_pred", "last_error", "peak_error", "peak_pred", digits=4)


@query
def fc_hit_bands(spark, sf):
    return rounded(ev.hit_bands(_forecasts(fx.supplier_bars(spark, sf))), "within_1pct", "within_5pct")


@query
def fc_direction(spark, sf):
    return rounded(ev.directional_accuracy(_forecasts(fx.supplier_bars(spark, sf))), "directional_accuracy")


@query
def fc_rolling_rmse(spark, sf):
    out = ev.rolling_rmse(_forecasts(fx.flag_bars(spark, sf)))
    return rounded(out, "y_pred", "rolling_rmse", digits=4)


@query
def fc_rolling_rmse_long(spark, sf):
    out = ev.rolling_rmse(_forecasts(fx.flag_bars(spark, sf)), layout=Layout(chunk_rows=128))
    return rounded(out, "y_pred", "rolling_rmse", digits=4)


@query
def fc_rolling_rmse_mean(spark, sf):
    out = ev.rolling_rmse_mean(ev.rolling_rmse(_forecasts(fx.supplier_bars(spark, sf))))
    return rounded(out, "mean_rolling_rmse", digits=4)


@query
def fc_band95(spark, sf):
    out = ev.prediction_band(_forecasts(fx.supplier_bars(spark, sf)))
    return rounded(out, "y_pred", "lower", "upper", digits=4)


@query
def fc_moments(spark, sf):
    return rounded(ev.residual_moments(_forecasts(fx.supplier_bars(spark, sf))), "skewness", "kurtosis")


@query
def fc_histogram(spark, sf):
    out = ev.residual_histogram(_forecasts(fx.flag_bars(spark, sf)))
    return rounded(out, "bin_start", "bin_end", digits=4)


@query
def fc_normal_curve(spark, sf):
    return rounded(rounded(ev.normal_curve(_forecasts(fx.flag_bars(spark, sf))), "x", digits=4), "density")


@query
def fc_corridor(spark, sf):
    out = ev.corridor(_forecasts(fx.flag_bars(spark, sf)))
    return rounded(out, "y_pred", "floor", "ceiling", digits=4)


@query
def fc_scorecard(spark, sf):
    card = ev.scorecard(ev.common_dates(_forecasts(fx.supplier_bars(spark, sf))), digits=1)
    return rounded(card, "worst_over_best")


@query
def fc_scorecard_sorted(spark, sf):
    card = ev.scorecard(_forecasts(fx.flag_bars(spark, sf)), digits=1)
    return rounded(ev.sorted_by_mape(card), "worst_over_best")


@query
def fc_best_worst(spark, sf):
    card = ev.scorecard(_forecasts(fx.supplier_bars(spark, sf)), digits=1)
    return rounded(ev.best_and_worst(card), "worst_over_best")


@query
def fc_scaled_mse(spark, sf):
    bars = fx.supplier_bars(spark, sf)
    return ev.scaled_mse(_forecasts(bars), sc.fit_minmax(bars, ("close",)))


# --- training logs and tuning -------------------------------------------------------------


def _log(bars):
    return tr.gradient_descent_log(tr.training_pairs(bars), fx.RATES, fx.EPOCHS)


@query
def hist_log(spark, sf):
    return rounded(_log(fx.supplier_bars(spark, sf)), "loss", "mse", "val_loss", "val_mse", digits=9)


@query
def hist_best_epoch(spark, sf):
    log = rounded(_log(fx.supplier_bars(spark, sf)), "loss", "val_loss", digits=7)
    return rounded(tr.epoch_summary(log), "final_gap", digits=9)


@query
def hist_overfit(spark, sf):
    log = rounded(_log(fx.flag_bars(spark, sf)), "loss", "val_loss", digits=7)
    return tr.overfit_epochs(log).select("series_id", "model", "epoch", "best_epoch")


@query
def hist_converge(spark, sf):
    log = rounded(_log(fx.flag_bars(spark, sf)), "loss", digits=7)
    return tr.convergence_epoch(log)


@query
def hist_early_stop(spark, sf):
    log = rounded(_log(fx.supplier_bars(spark, sf)), "val_loss", digits=7)
    return tr.early_stop(log, fx.PATIENCE)


@query
def hist_by_model(spark, sf):
    """Several models share a log; each model's rows come from the log it maps to."""
    bars = fx.flag_bars(spark, sf)
    logs = _log(bars).withColumn("model", F.concat_ws("/", "series_id", "model")).drop("series_id")
    models = bars.select(
        F.explode(F.array(*[F.concat_ws("/", "series_id", F.lit(m)) for m in ("base", "grid")])).alias("model")
    ).distinct()
    mapping = {f"{s}/{m}": f"{s}/gd_0.5" for s in ("A", "N", "R") for m in ("base", "grid")}
    out = lk.with_log_of_model(models, logs, mapping).select("model", "epoch", "loss", "val_loss")
    return rounded(out, "loss", "val_loss", digits=9)


def _grid(bars):
    scores = tu.ridge_grid_scores(bars, fx.GRID_FEATURES, fx.PENALTIES)
    return rounded(scores, "mean_test_score", digits=9)


@query
def grid_scores(spark, sf):
    return _grid(fx.supplier_bars(spark, sf))


@query
def grid_best(spark, sf):
    return tu.best_config(_grid(fx.supplier_bars(spark, sf)), ("param_feature", "param_penalty"))


@query
def grid_pivot(spark, sf):
    return tu.score_pivot(
        _grid(fx.supplier_bars(spark, sf)), "param_penalty", "param_feature", fx.GRID_FEATURES
    )


@query
def grid_best_cell(spark, sf):
    return tu.best_cell(_grid(fx.supplier_bars(spark, sf)), "param_penalty", "param_feature")


@query
def grid_lift(spark, sf):
    return rounded(tu.score_lift(_grid(fx.supplier_bars(spark, sf))), "lift")


@query
def grid_by_feature(spark, sf):
    out = tu.mean_score_by(_grid(fx.supplier_bars(spark, sf)), "param_feature")
    return rounded(out, "mean_score", digits=12)


def _gram_cells(bars):
    split = sc.chronological_split(sc.fit_scale(bars.select("series_id", "dt", "close"), ("close",)))
    samples = sq.sequences(split.filter("is_train"), 2, 1, close_only=True)
    return gr.grid_search(samples, reg_params=fx.GRAM_PENALTIES, elastic_net=(0.0,))


@query
def gram_grid_scores(spark, sf):
    cells = _gram_cells(fx.supplier_bars(spark, sf))
    return rounded(cells.select("series_id", "param_reg", "mean_test_score", "is_best"), "mean_test_score", digits=9)


@query
def gram_grid_refit(spark, sf):
    out = gr.refit_forecasts(fx.supplier_bars(spark, sf), fx.GRAM_SPEC, fx.GRAM_PENALTIES, (0.0,))
    return rounded(out.drop("model"), "y_pred", "y_true", digits=4)


def _sweep(bars):
    return rounded(tu.lookback_scores(bars), "val_loss", digits=2)


@query
def sweep_scores(spark, sf):
    return _sweep(fx.supplier_bars(spark, sf))


@query
def tuner_best(spark, sf):
    return rounded(tu.sweep_summary(_sweep(fx.supplier_bars(spark, sf))), "improvement")


@query
def tuner_norm(spark, sf):
    return rounded(tu.normalised_loss(_sweep(fx.supplier_bars(spark, sf))), "norm_loss")


@query
def tuner_top_row(spark, sf):
    return tu.best_rows(_sweep(fx.supplier_bars(spark, sf)), 1)


def _tournament(spark, sf):
    return to.tournament(fx.supplier_bars(spark, sf), fx.TOURNAMENT, loss_digits=0)


@query
def tournament_rungs(spark, sf):
    return rounded(_tournament(spark, sf), "budget", digits=9)


@query
def tournament_winners(spark, sf):
    return to.winners(_tournament(spark, sf))


@query
def tournament_costs(spark, sf):
    return to.rung_costs(_tournament(spark, sf))


# --- Spark ML (rows-only in the driver's check; unit tests cover the values) ----------------


@query
def ml_lag_regression(spark, sf):
    return fo.train_and_score(fx.supplier_bars(spark, sf), REGISTRY["lstm_exp"])


@query
def ml_series_regression(spark, sf):
    """A fit per series of the same shape as `ml_lag_regression`, which pools them."""
    return gr.lag_regression(fx.supplier_bars(spark, sf), REGISTRY["lstm_exp"], penalty=1e-6)


@query
def ml_series_two_step(spark, sf):
    return gr.lag_regression(fx.supplier_bars(spark, sf), REGISTRY["deep"], penalty=1e-6)


def _lag_samples(spark, sf):
    split = sc.chronological_split(sc.fit_scale(fx.supplier_bars(spark, sf)))
    return sq.tail_validation(sq.spec_sequences(split.filter("is_train"), REGISTRY["lstm_exp"]))


@query
def ml_training_log(spark, sf):
    """The log of a mini-batch fit that stops early, as the log analyses read it."""
    how = ds.Descent(rate=0.01, batch=64, epochs=12, patience=2, shards=4)
    return ds.log_table(spark, {"lag_adam": ds.fit_epochs(_lag_samples(spark, sf), how)})


@query
def ml_seven_families(spark, sf):
    """Scorecard of the seven registered forecasters on the days all of them cover."""
    fc = fam.family_forecasts(fx.flag_bars(spark, sf))
    return ev.scorecard(ev.common_dates(fc.filter("horizon = 1")))


@query
def ml_grid_one_pass(spark, sf):
    """The cells of `ml_grid_cv`, from the moments of its folds."""
    split = sc.chronological_split(sc.fit_scale(fx.supplier_bars(spark, sf)))
    samples = sq.spec_sequences(split.filter("is_train"), REGISTRY["lstm_grid"])
    return gr.grid_search(samples, by=()).select("param_reg", "param_elastic_net", "mean_test_score", "is_best")


@query
def ml_two_step(spark, sf):
    return fo.train_and_score(fx.supplier_bars(spark, sf), REGISTRY["deep"])


@query
def ml_live_forecast(spark, sf):
    bars, spec = materialise(fx.supplier_bars(spark, sf)), REGISTRY["deep"]
    params = sc.fit_minmax(bars)
    samples = sq.spec_sequences(sc.fit_scale(bars), spec)
    models = fo.fit_forecaster(samples, spec.n_predictions)
    return fo.live_forecast(bars, params, models, spec)


@query
def ml_grid_cv(spark, sf):
    bars = fx.supplier_bars(spark, sf)
    split = sc.chronological_split(sc.fit_scale(bars))
    samples = sq.spec_sequences(split.filter("is_train"), REGISTRY["lstm_grid"])
    return tu.cross_validated_grid(samples)[0]


@query
def ml_lookback_sweep(spark, sf):
    bars = fx.supplier_bars(spark, sf)
    split = sc.chronological_split(sc.fit_scale(bars))
    return tu.sweep_lookbacks(split.filter("is_train").select(*bars.columns), LOOKBACKS)
