"""Problem 4: lines of a track that look the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.llm.lookalike import consistent_text
from talklake.runtime import table


def look_alike_pairs(rows: DataFrame, key: str, id_col: str, text: str) -> DataFrame:
    """Pairs (key, id_a, id_b), id_a < id_b, of rows whose texts look the same but differ in code points.

    Only forms that have at least two spellings are paired, spelling by spelling, so identical copies are
    never compared with each other. Rows with a null text or id pair with nothing; a repeated row counts once.
    """
    ids = rows.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(key).alias("_k"), F.col(id_col).alias("_id"), F.col(text).alias("_t")
    )
    marked = ids.select("_k", "_id", F.unhex(F.md5(consistent_text("_t"))).alias("_form"), F.unhex(F.md5("_t")).alias("_raw"))
    spellings = marked.groupBy("_k", "_form", "_raw").agg(F.count(F.lit(1)).alias("_n"))
    several = spellings.groupBy("_k", "_form").agg(F.collect_list("_raw").alias("_raws")).where(F.size("_raws") > 1)
    left = several.select("_k", "_form", F.explode("_raws").alias("_raw"), "_raws")
    pairs = left.select("_k", "_form", "_raw", F.explode("_raws").alias("_raw_b")).where(F.col("_raw") < F.col("_raw_b"))
    a = marked.select("_k", "_raw", F.col("_id").alias("id_a")).distinct()
    b = marked.select("_k", F.col("_raw").alias("_raw_b"), F.col("_id").alias("id_b")).distinct()
    met = pairs.join(a, [pairs._k.eqNullSafe(a._k), pairs._raw == a._raw]).select(pairs._k, "_raw_b", "id_a")
    both = met.join(b, [met._k.eqNullSafe(b._k), met._raw_b == b._raw_b]).where(F.col("id_a") != F.col("id_b"))
    return both.select(
        met._k.alias(key), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")
    ).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of one track that look the same and aren't."""
    return look_alike_pairs(table(spark, sf_dir, "cues"), "doc_id", "id", "text")


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cue's text in the consistent form."""
    cues = table(spark, sf_dir, "cues").select("doc_id", "id", "text").distinct()
    return cues.select("doc_id", "id", consistent_text("text").alias("text"))


QUERIES = {"p4_found": p4_found, "p4_text": p4_text}
ORACLE: dict[str, str] = {}
