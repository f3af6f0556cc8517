"""Defaults that results depend on, and the forecaster registry."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------------------
TRAIN_RATIO = 0.8
VALIDATION_RATIO = 0.2
MA_SPANS = (50, 200)
VOL_SPANS = (30, 252)
TRADING_DAYS = 252
RISK_FREE_RATE = 0.06
DAYS_PER_YEAR = 365.25
START_CAPITAL = 1000.0
MAPE_EPS = 1e-8
NORM_EPS = 1e-10
BAND_Z = 1.96
ROLLING_ERROR_SPAN = 30
HISTOGRAM_BINS = 40
CURVE_POINTS = 200
CURVE_SIGMAS = 4.0
CORRIDOR = 0.05
GOOD_FIT_MAPE = 2.0
CONVERGENCE_QUANTILE = 0.1
PRICE_QUANTILE = 0.7
LABEL_FRACTION = 0.15
BASE_YEAR = 2015
BASE_HORIZON_YEARS = 10
PERIODS = ((1990, 1999), (2000, 2009), (2010, 2019), (2020, 2024))
LOOKBACKS = (10, 15, 20, 24, 25, 30)
GRID_FOLDS = 2
EVENTS = (
    ("2001-01-09", "iPod"),
    ("2007-01-09", "iPhone"),
    ("2010-01-27", "iPad"),
    ("2012-09-12", "iPhone 5"),
    ("2020-03-23", "COVID nadir"),
    ("2020-08-31", "4-for-1 split"),
    ("2022-01-03", "ATH $182"),
)
REGIMES = (
    ("1980-12-12", "1997-01-01", "Pre-internet era"),
    ("1997-01-01", "2007-01-09", "Turnaround & iPod era"),
    ("2007-01-09", "2020-03-01", "iPhone supercycle"),
    ("2020-03-01", None, "Services & post-COVID"),
)
# ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ForecastSpec:
    """Shape of a lag-window forecaster: input rows, predicted rows, leading features used."""

    key: str
    n_inputs: int
    n_predictions: int
    n_features: int
    close_only: bool = False


# The seven window shapes.
REGISTRY = {
    s.key: s
    for s in (
        ForecastSpec("lstm_exp", 10, 1, 6),
        ForecastSpec("lstm_grid", 15, 1, 6),
        ForecastSpec("rnn_single", 10, 1, 1, close_only=True),
        ForecastSpec("rnn_multi", 10, 1, 5),
        ForecastSpec("rnn_grid", 15, 1, 6),
        ForecastSpec("cnn", 10, 1, 6),
        ForecastSpec("deep", 7, 2, 6),
    )
}
# Which training log each forecaster reads; grid variants share the base log.
LOG_OF_MODEL = {
    "lstm_exp": "lstm_exploratory",
    "lstm_grid": "lstm_exploratory",
    "rnn_single": "rnn_single",
    "rnn_multi": "rnn_multi",
    "rnn_grid": "rnn_multi",
    "cnn": "cnn",
    "deep": "deep_lstm_2day",
}
