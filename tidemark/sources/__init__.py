from tidemark.sources.bars import (  # noqa: F401
    between_dates,
    conform_bars,
    daily_bars,
    flatten_names,
    load_with_fallback,
    read_bars,
    read_price_csv,
    require_rows,
)
from tidemark.sources.results import (  # noqa: F401
    load_model,
    load_or_fit,
    load_scaler,
    read_document,
    read_result_csv,
    read_result_table,
    resolve_scaler,
    save_bars_table,
    save_model,
    save_scaler,
    write_document,
    write_result_csv,
    write_result_table,
)
