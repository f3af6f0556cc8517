"""Helpers that several corpus operators use: written tables, text buffers, keyed randomness."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

#: What counts as a word, and as white space between words, in contracts that count words.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch, where the session leaves it at Spark's default: two workers share an executor's memory.
ARROW_BATCH = 8 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings that Python stages need, where the user has not chosen others.

    Workers on this machine import the package from where the driver did; on a cluster it comes with the job
    (``--py-files``) or the image, and an unknown folder in the path is ignored. Arrow batches are bounded in bytes, so
    that batches of long texts stay small.
    """
    here = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (paths, here) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("64m", "64MB", "67108864b", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share, and read it back.

    Later jobs start from the files, so neither a lost executor nor a second use recomputes what led there.
    Unlike a checkpoint the table is columnar: each use reads only the columns it needs.
    """
    spark = prepared(df.sparkSession)
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(text: Column | str = "text", key: Column | str = "doc_id") -> Column:
    """64-bit key of a row's id and text. Repeated rows share it, and share every result that follows from text."""
    text = F.col(text) if isinstance(text, str) else text
    key = F.col(key) if isinstance(key, str) else key
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00null")), F.coalesce(text, F.lit("")))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each string."""
    return column.cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift), elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))  # a copy, which the other steps change in place
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def draw(mixed_seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) that depend on (seed, counter) alone, so that a retried task draws the same."""
    bits = mix64(mixed_seed + counter * np.uint64(0x9E3779B97F4A7C15))
    bits >>= np.uint64(11)
    out = bits.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out
