"""Problem 6: documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.llm.packing import CAPACITY, fill_containers
from talklake.runtime import table


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its container."""
    return fill_containers(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by fill in steps of 5 %, with texts and tokens."""
    per = p6_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    step = (F.floor(F.col("used") * 20 / CAPACITY) * 5).cast("int").alias("fill_percent")
    return per.groupBy(step).agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"))


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill}
ORACLE: dict[str, str] = {}
