from tidemark.operators import (  # noqa: F401
    evaluate,
    forecast,
    indicators,
    lookup,
    returns,
    scaling,
    sequences,
    training,
    tuning,
)
