"""Schemas shared by readers, operators and tests. Types are declared, never inferred."""

from pyspark.sql import types as T

# Fixed order: "the first k features" means a prefix of this tuple.
FEATURES = ("open", "high", "low", "close", "adj_close", "volume")
SERIES = ("series_id",)
ORDER = "dt"

BARS = T.StructType(
    [T.StructField("series_id", T.StringType()), T.StructField("dt", T.DateType())]
    + [T.StructField(f, T.DoubleType()) for f in FEATURES]
)

HISTORY = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("mse", T.DoubleType()),
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("val_mse", T.DoubleType()),
    ]
)

GRID = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("param_optimiser", T.StringType()),
        T.StructField("param_neurons", T.IntegerType()),
        T.StructField("mean_test_score", T.DoubleType()),
    ]
)

SWEEP = T.StructType(
    [
        T.StructField("inputs", T.IntegerType()),
        T.StructField("units", T.IntegerType()),
        T.StructField("val_loss", T.DoubleType()),
    ]
)

BEST_PARAMS = T.StructType(
    [T.StructField("units", T.IntegerType()), T.StructField("dense", T.IntegerType())]
)
