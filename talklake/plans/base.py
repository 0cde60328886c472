"""Cleaned views of the test tables, in Spark and in SQL: redelivered rows count once, times in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.runtime import millis, table


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, id, start_ms, end_ms, text, confidence, low_confidence)."""
    c = table(spark, sf_dir, "cues")
    return c.select("doc_id", "idx", "id", millis("start").alias("start_ms"), millis("end").alias("end_ms"), "text", "confidence", "low_confidence").distinct()


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, idx, id, start_ms, end_ms, speaker_id, raw_text, text, review_status)."""
    s = table(spark, sf_dir, "segments")
    return s.select("episode_id", "idx", "id", millis("start").alias("start_ms"), millis("end").alias("end_ms"), "speaker_id", "raw_text", "text", "review_status").distinct()


def timed(rows: DataFrame) -> DataFrame:
    """Rows that have both bounds."""
    return rows.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subtitle document."""
    return table(spark, sf_dir, "subtitle_docs").dropDuplicates(["doc_id"])


def sql_ms(c: str) -> str:
    """The statement's form of runtime.millis."""
    return f'CASE WHEN {c} IS NOT NULL AND isfinite({c}) THEN round(greatest(least({c} * 1000.0, 4e15), -4e15))::BIGINT END'


CUES = f"""cu AS (SELECT DISTINCT doc_id, idx, id, {sql_ms('"start"')} AS start_ms, {sql_ms('"end"')} AS end_ms, text, confidence, low_confidence FROM cues)"""
SEGMENTS = f"""sg AS (SELECT DISTINCT episode_id, idx, id, {sql_ms('"start"')} AS start_ms, {sql_ms('"end"')} AS end_ms, speaker_id, raw_text, text, review_status FROM segments)"""
