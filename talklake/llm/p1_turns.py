"""Problem 1: recogniser rows as ordered turns of the episode's speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talklake.llm.turns import found_turns, speaker_turns
from talklake.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last row and speaker of every turn."""
    return found_turns(table(spark, sf_dir, "asr_events"), table(spark, sf_dir, "speakers"))


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with start and cleaned text."""
    return speaker_turns(table(spark, sf_dir, "asr_events"), table(spark, sf_dir, "speakers"))


QUERIES = {"p1_found": p1_found, "p1_turns": p1_turns}
ORACLE: dict[str, str] = {}
