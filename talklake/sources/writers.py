"""Sinks: create-only tables, ordered text documents, content-addressed stores, compressed archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talklake.functions.text import fingerprint


def create_only(rows: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Writes a new table; an existing one is an error and stays as it is."""
    rows.write.mode("errorifexists").options(**options).format(fmt).save(path)


def documents_of_lines(lines: DataFrame, key: str, part: str, order: list[str], line: str = "line") -> DataFrame:
    """(key, part, text) from ordered lines: the lines of one key and part in one text. ``part`` keeps texts bounded; null lines are left out."""
    told = lines.where(F.col(line).isNotNull())
    return told.groupBy(key, part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: x[line]), "\n").alias("text"))


def archive(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Compressed JSON lines, one folder per value of the partition columns; an existing archive is an error."""
    w = rows.write.mode("errorifexists").option("compression", "gzip").format("json")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def store_new(rows: DataFrame, cols: list[str], path: str, prefix: str) -> DataFrame:
    """Adds rows whose content is not stored yet, named ``prefix-<20 hex>`` by digest; returns the rows with their names. Nothing is overwritten."""
    spark = rows.sparkSession
    named = rows.withColumn("name", F.concat(F.lit(prefix + "-"), F.left(fingerprint(*cols), F.lit(20)))).dropDuplicates(["name"])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        new = named.join(spark.read.parquet(path).select("name"), "name", "left_anti")
    else:
        new = named
    new.write.mode("append").parquet(path)
    return named
