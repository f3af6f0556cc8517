from tidemark.plans.series import (  # noqa: F401
    PLAIN,
    Layout,
    first_row_value,
    layout_for,
    number_rows,
    over_series,
    quantile,
    rolling_moments,
    running_max,
)
