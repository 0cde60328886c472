"""Problem 2: long segment texts and long episodes in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.llm.splitting import sequence_pieces, text_pieces
from talklake.operators.sequence import idx_shard, prefix
from talklake.runtime import table

#: A pause between two segments of at least so many seconds is a boundary.
PAUSE_SECONDS = 1.0


def p2_text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every segment text over the limit."""
    segments = table(spark, sf_dir, "segments")
    return text_pieces(segments, ["episode_id", "id"], "text").dropDuplicates(["episode_id", "id", "piece"])


def boundary_strengths(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """(episode_id, id, idx, strength): 3 where a chapter begins, 2 at another speaker, 1 after a pause, else 0.

    The segment before is the one before in the whole episode; an episode's first counts as another speaker, or as a pause if it has none.
    """
    own = segments.groupBy("episode_id", "id").agg(F.min(F.struct("idx", "start", "end", "speaker_id")).alias("m")).select("episode_id", "id", "m.*")
    told = prefix(own, ["episode_id"], idx_shard(), [F.col("idx").asc_nulls_last(), "id"], {"_sp": ("lag", "speaker_id"), "_e": ("lag", "end")})
    begins = chapters.where(F.col("segment_id").isNotNull()).select("episode_id", F.col("segment_id").alias("id"), F.lit(True).alias("_c")).distinct()
    strength = (
        F.when(F.col("_c"), 3)
        .when(~F.col("speaker_id").eqNullSafe(F.col("_sp")), 2)
        .when(F.coalesce(F.col("start") - F.col("_e") >= PAUSE_SECONDS, F.lit(True)), 1)
        .otherwise(0)
    )
    return told.join(begins, ["episode_id", "id"], "left").select("episode_id", "id", "idx", strength.cast("int").alias("strength"))


def p2_episode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every episode with more than 200 segments."""
    segments = table(spark, sf_dir, "segments").select("episode_id", "id", "idx", "start", "end", "speaker_id")
    return sequence_pieces(boundary_strengths(segments, table(spark, sf_dir, "chapters")), "episode_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be split; unbroken marks texts with a stretch that has no natural boundary."""
    texts = text_pieces(table(spark, sf_dir, "segments"), ["episode_id", "id"], "text").groupBy("episode_id", "id").agg(F.max("unbroken").alias("unbroken"))
    episodes = p2_episode_pieces(spark, sf_dir).select("episode_id").distinct()
    return texts.select(F.lit("text").alias("item_kind"), "episode_id", "id", "unbroken").unionByName(
        episodes.select(F.lit("episode").alias("item_kind"), "episode_id", F.lit("").alias("id"), F.lit(0).alias("unbroken"))
    )


QUERIES = {"p2_found": p2_found, "p2_text_pieces": p2_text_pieces, "p2_episode_pieces": p2_episode_pieces}
ORACLE: dict[str, str] = {}
