"""Problem 7: documents that contain passages of evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.llm.leakage import LETTERS, near_passages, shared_passages
from talklake.runtime import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items of which they hold a passage."""
    return shared_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item and suite: the number of documents and the longest shared passage, in words or letters."""
    found = shared_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    letters = F.col("need") == LETTERS - 2
    longest = F.when(letters, F.col("tokens") + 2).otherwise(F.col("tokens") + 1)
    per = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max(longest).alias("longest_passage"))
    suites = table(spark, sf_dir, "eval_items").select("item_id", "suite").dropDuplicates(["item_id"])
    return per.join(suites, "item_id").select("item_id", "suite", "documents", "longest_passage")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches: documents that hold much of an item with words put in or left out."""
    return near_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p7_near": p7_near, "p7_found": p7_found, "p7_report": p7_report}
ORACLE: dict[str, str] = {}
