from tidemark.functions.expr import (  # noqa: F401
    change_pct,
    corrected_kurtosis,
    corrected_skewness,
    log_cosh,
    order_key,
    relative_error,
    safe_ln,
)
