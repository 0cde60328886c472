"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest magnitude of a time in ms; larger finite values are clamped so that casts cannot overflow.
MAX_MS = 4_000_000_000_000_000


def session(app: str = "talklake", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TALKLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; Spark prunes the columns a plan does not use."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (spark.checkpoint.dir).

    Only where the session names none, as in local tests, is a temporary folder set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="talklake-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def finite(col):
    """True for a number that is neither null, NaN nor infinite."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def millis(col):
    """Seconds to whole milliseconds (nearest); null where the value is null or not finite.

    Finite values beyond +-MAX_MS are clamped, so a damaged time never overflows.
    """
    c = F.col(col) if isinstance(col, str) else col
    ms = F.greatest(F.least(c * F.lit(1000.0), F.lit(float(MAX_MS))), F.lit(float(-MAX_MS)))
    return F.when(finite(c), F.round(ms, 0).cast("long"))
