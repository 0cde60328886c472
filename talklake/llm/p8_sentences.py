"""Problem 8: sentence units of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.llm.sentences import UNIT_SCHEMA, unit_batches
from talklake.runtime import table


def sentence_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every unit. Needs doc_id, text and kind; other columns are ignored.

    No shuffle: each document is cut where it is read.
    """
    return docs.select("doc_id", "text", "kind").mapInArrow(unit_batches, UNIT_SCHEMA)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all documents."""
    return sentence_spans(table(spark, sf_dir, "documents"))


def p8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with their number in the document and their text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    spans = p8_found(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("u"))
    met = docs.join(spans, "doc_id").select("doc_id", "text", F.posexplode("u").alias("unit", "u"))
    return met.select("doc_id", "unit", F.expr("substring(text, int(u.start_pos) + 1, int(u.end_pos - u.start_pos))").alias("text"))


QUERIES = {"p8_found": p8_found, "p8_units": p8_units}
ORACLE: dict[str, str] = {}
