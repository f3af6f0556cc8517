"""Column expressions shared by the operators. All are built-in, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import MAPE_EPS


def change_pct(new: Column, old: Column) -> Column:
    """(new - old) / old * 100; NULL where old is 0."""
    return F.try_divide(new - old, old) * 100


def safe_ln(x: Column) -> Column:
    """Natural logarithm; NULL for values that have none."""
    return F.when(x > 0, F.ln(x))


def log_cosh(e: Column) -> Column:
    """log(cosh(e)), written so that large errors do not overflow exp()."""
    a = F.abs(e)
    return a + F.log1p(F.exp(-2.0 * a)) - F.ln(F.lit(2.0))


def relative_error(y_true: Column, y_pred: Column) -> Column:
    """|error| over |truth|, with a small constant against division by zero."""
    return F.abs((y_true - y_pred) / (F.abs(y_true) + MAPE_EPS))


def corrected_skewness(x: Column) -> Column:
    """Bias-corrected skewness aggregate; NULL below three values. Spark's is the population form."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis aggregate; NULL below four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def order_key(parts: list[tuple[str, int]]) -> Column:
    """One sortable number from several non-negative integer columns.

    ``parts`` lists (column, decimal digits) from most to least significant. min_by / max_by
    over a struct key would force a sort-based aggregate; a numeric key keeps the hash
    aggregate. A value that does not fit its digits raises, so ordering is never wrong.
    """
    if sum(d for _, d in parts) > 38:
        raise ValueError("order key needs more than 38 digits")
    pieces: list[tuple[Column, int]] = []
    for name, digits in parts:
        c = F.col(name).cast("bigint")
        if digits < 19:
            fits = (c >= 0) & (c < F.lit(10**digits))
            c = F.when(fits, c).otherwise(
                F.raise_error(F.lit(f"{name} does not fit {digits} digits")).cast("bigint")
            )
        if pieces and pieces[-1][1] + digits <= 18:
            head, width = pieces[-1]
            pieces[-1] = (head * F.lit(10**digits) + c, width + digits)
        else:
            pieces.append((c, digits))
    key, width = pieces[0]
    if len(pieces) == 1:
        return key
    key = key.cast(f"decimal({width},0)")
    for piece, digits in pieces[1:]:
        width += digits
        scale = F.lit("1" + "0" * digits).cast(f"decimal({digits + 1},0)")
        key = (key * scale + piece.cast(f"decimal({digits},0)")).cast(f"decimal({width},0)")
    return key
