"""Small random bar tables as pandas and Spark frames."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from tidemark.schema import BARS, FEATURES


def random_bars(seed: int, lengths: dict[str, int]) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    frames = []
    for name, n in lengths.items():
        gaps = rng.integers(1, 4, n).cumsum()
        close = np.round(np.exp(np.cumsum(rng.normal(0, 0.03, n))) * 50, 2)
        frames.append(
            pd.DataFrame(
                {
                    "series_id": name,
                    "dt": [dt.date(2001, 1, 1) + dt.timedelta(days=int(g)) for g in gaps],
                    "open": np.round(close * rng.uniform(0.97, 1.03, n), 2),
                    "high": np.round(close * 1.05, 2),
                    "low": np.round(close * 0.95, 2),
                    "close": close,
                    "adj_close": np.round(close * 0.9, 2),
                    "volume": rng.integers(1, 1000, n).astype(float),
                }
            )
        )
    if not frames:
        return pd.DataFrame(columns=["series_id", "dt", *FEATURES])
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame, shuffle_seed: int | None = 7):
    if shuffle_seed is not None and len(pdf):
        pdf = pdf.sample(frac=1, random_state=shuffle_seed)
    rows = [tuple(r) for r in pdf[["series_id", "dt", *FEATURES]].itertuples(index=False)]
    return spark.createDataFrame(rows, BARS)


def bars_of(spark, closes: dict[str, list[float]], start: str = "2020-01-01"):
    """Daily bars with the given closes; other features derived from them."""
    day0 = dt.date.fromisoformat(start)
    rows = [
        (s, day0 + dt.timedelta(days=i), c, c, c, c, c, 1.0)
        for s, values in closes.items()
        for i, c in enumerate(values)
    ]
    return spark.createDataFrame(rows, BARS)


def ordered(df, *by: str) -> pd.DataFrame:
    by = by or ("series_id", "dt")
    return df.toPandas().sort_values(list(by), kind="stable").reset_index(drop=True)


def close_to(a, b, tol=1e-9) -> None:
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    np.testing.assert_allclose(a, b, rtol=tol, atol=tol, equal_nan=True)
