"""Price text with a channel for what cannot be used: every line is accepted as a bar or rejected with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import FEATURES

#: Fields of a line in the files' own order.
FIELDS = ("dt", *FEATURES)


def judged_lines(lines: DataFrame, series_id: str | None = None, fields: Sequence[str] = FIELDS, column: str = "value") -> DataFrame:
    """``lines`` with the fields it parses to and ``reason``, NULL for a usable bar.

    A line is parsed once, as text, so nothing raises; fields are then cast one by one. The first that
    applies counts: ``empty``, ``columns`` (too few or too many), ``dt`` or a feature's name (missing or not
    a date, not a finite number), ``range`` (a high below the low). ``series_id`` is a field of the line, or given.
    """
    text = ", ".join(f"`{f}` string" for f in fields)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("_line", F.from_csv(F.col(column), f"{text}, _corrupt string", options))
    typed = {"dt": F.try_to_date(F.substring(F.trim("_line.dt"), 1, 10))}
    for f in FEATURES:
        number = F.trim(F.col(f"_line.{f}")).try_cast("double")
        typed[f] = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    series = F.col("_line.series_id") if series_id is None else F.lit(series_id)
    empty = F.coalesce(F.trim(column), F.lit("")) == ""
    reason = F.when(empty, "empty").when(F.col("_line").isNull() | F.col("_line._corrupt").isNotNull(), "columns")
    if series_id is None:
        reason = reason.when(F.coalesce(F.trim(series), F.lit("")) == "", "series_id")
    rows = parsed.select("*", series.alias("series_id"), *[c.alias(f) for f, c in typed.items()])
    for f in ("dt", *FEATURES):
        reason = reason.when(F.col(f).isNull(), f)
    return rows.withColumn("reason", reason.when(F.col("high") < F.col("low"), "range")).drop("_line")


def accepted(judged: DataFrame) -> DataFrame:
    """The bars of usable lines."""
    return judged.filter(F.col("reason").isNull()).select("series_id", "dt", *FEATURES)


def rejected(judged: DataFrame, column: str = "value") -> DataFrame:
    """The other lines as they are, with the reason."""
    return judged.filter(F.col("reason").isNotNull()).select(F.col(column).alias("line"), "reason")


def read_checked(spark: SparkSession, path: str, series_id: str | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Judged lines of text files without a header; `file` names the one each line is from."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return judged_lines(lines, series_id, fields)
