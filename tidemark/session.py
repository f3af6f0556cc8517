"""Session helpers. A cluster job brings its own session; nothing here overrides it."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tidemark", cores: int | str = "*", warehouse: str | None = None) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder; on a cluster a folder of
    one machine would lose the data with the machine, so a missing setting raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, keep_shuffles: bool = True) -> DataFrame:
    """Reliable checkpoint: a table several jobs read is computed once and survives executors.

    Without ``keep_shuffles`` the files of the shuffles that led to it are removed at once, not when the driver's
    memory is next cleaned.
    """
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    checkpoint_dir(spark)
    if keep_shuffles:
        return df.checkpoint(eager=True)
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        # The setting is read by the query, so it has to be built after it is made.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def pinned(df: DataFrame) -> DataFrame:
    """``df`` as a table whose jobs read the files of one shuffle, which stay until :func:`released`.

    A lost file is computed again from what ``df`` was made of.
    """
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def last_shuffles(df: DataFrame) -> list[int]:
    """The shuffles whose files a pinned table reads."""
    found, rdds = [], [df._jdf.queryExecution().toRdd()]
    while rdds:
        links = rdds.pop().dependencies()
        for link in (links.apply(i) for i in range(links.size())):
            if link.getClass().getSimpleName() == "ShuffleDependency":
                found.append(link.shuffleId())
            else:
                rdds.append(link.rdd())
    return found


def released(df: DataFrame) -> None:
    """Removes the files of a pinned table's last shuffle."""
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    for shuffle in last_shuffles(df) if cleaner.isDefined() else ():
        cleaner.get().doCleanupShuffle(shuffle, True)
