"""Copies of the small test tables: empty ones, and ones with nulls in every column, repeated rows, odd texts and extra columns."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
EXTRA = ["run_no", "run_shard", "start_ms", "island", "nearest", "key", "pos", "term", "item_pos", "piece", "own", "_k", "_t", "_s", "_row", "_shard", "unit"]


def hostile(df: DataFrame) -> DataFrame:
    """The rows, some of them again, one row with a null for each column, a row of nulls, odd texts, and columns with clashing names."""
    some = df.limit(1)
    variants = [df, df.limit(20)]
    for f in df.schema.fields:
        variants.append(some.withColumn(f.name, F.lit(None).cast(f.dataType)))
        if f.dataType.simpleString() == "string":
            for odd in ("", " ​ ", "\U0001f3a7퟿\U000e0041", "a\u0000b", "“" * 50 + ". " * 50, "word " * 60_000):
                variants.append(some.withColumn(f.name, F.lit(odd)))
        if f.dataType.simpleString() == "double":
            for odd in (float("nan"), float("inf"), float("-inf"), -1e300, 1e300, -5.0):
                variants.append(some.withColumn(f.name, F.lit(odd)))
        if f.dataType.simpleString() == "array<string>":
            variants.append(some.withColumn(f.name, F.array(F.lit(None).cast("string"), F.lit(""))))
    variants.append(some.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
    out = reduce(DataFrame.unionByName, variants)
    return out.withColumns({c: F.lit("x") for c in EXTRA if c not in df.columns})


def write(spark: SparkSession, folder: Path, change) -> str:
    """Every test table, changed, under a folder."""
    for p in sorted(Path(DATA).glob("*.parquet")):
        change(spark.read.parquet(str(p))).coalesce(2).write.parquet(str(folder / p.name))
    return str(folder)
