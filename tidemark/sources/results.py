"""Result tables, parameter documents, scaler tables and fitted models on storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _missing(err: AnalysisException) -> bool:
    return err.getCondition() == "PATH_NOT_FOUND"


def read_result_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result CSV under a declared schema; no rows when the path does not exist."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as err:
        if _missing(err):
            return spark.createDataFrame([], schema)
        raise


def read_result_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result Parquet table; no rows when the path does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if _missing(err):
            return spark.createDataFrame([], schema)
        raise


def write_result_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_result_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_bars_table(bars: DataFrame, name: str, buckets: int) -> None:
    """Bars as a table bucketed by series: windows and joins on the series read it without a
    shuffle. Rows are brought to their bucket first, so each bucket is one file."""
    (
        bars.repartition(buckets, "series_id")
        .write.mode("overwrite")
        .bucketBy(buckets, "series_id")
        .sortBy("series_id", "dt")
        .saveAsTable(name)
    )


def write_document(df: DataFrame, path: str) -> None:
    """One flat JSON object per row."""
    df.write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_scaler(params: DataFrame, path: str) -> None:
    """The fitted scaling parameters are a table (one row per series), not an object."""
    params.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame | None:
    """Saved scaling parameters, or None when there are none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if _missing(err):
            return None
        raise


def resolve_scaler(spark: SparkSession, path: str, fresh: DataFrame) -> DataFrame:
    """Saved parameters win over freshly fitted ones."""
    saved = load_scaler(spark, path)
    return fresh if saved is None else saved


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_or_fit(path: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The stored model, or a fresh fit when nothing is stored at ``path``.

    Existence is asked of the file system that owns the path, so that a damaged model raises
    instead of being refitted silently.
    """
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return load_model(path) if fs.exists(location) else fit()
