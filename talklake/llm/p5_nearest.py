"""Problem 5: every cue with the segment of its episode that begins nearest in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.llm.nearest import nearest_in_time
from talklake.runtime import millis, table

TOLERANCE_MS = 1_500


def cue_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, cue_id, episode_id, nearest) of every cue with a start in a track of an episode."""
    cues = table(spark, sf_dir, "cues").select("doc_id", F.col("id").alias("cue_id"), millis("start").alias("cue_ms"))
    cues = cues.where(F.col("cue_ms").isNotNull()).distinct()
    tracks = table(spark, sf_dir, "subtitle_docs").where(F.col("episode_id").isNotNull()).select("doc_id", "episode_id").distinct()
    segments = table(spark, sf_dir, "segments").select("episode_id", "id", "idx", "start", millis("start").alias("segment_ms"))
    value = F.struct("start", "idx", F.col("id").alias("segment_id"))
    return nearest_in_time(cues.join(tracks, "doc_id"), segments, ["episode_id"], "cue_ms", "segment_ms", value, TOLERANCE_MS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue and segment ids of the pairs."""
    return cue_segments(spark, sf_dir).where(F.col("nearest").isNotNull()).select("doc_id", "cue_id", F.col("nearest.segment_id").alias("segment_id"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with both starts and texts; cues without a near segment have nulls."""
    cues = table(spark, sf_dir, "cues").select("doc_id", F.col("id").alias("cue_id"), F.col("start").alias("cue_start"), F.col("text").alias("cue_text")).distinct()
    segments = table(spark, sf_dir, "segments").select("episode_id", F.col("id").alias("segment_id"), F.col("start").alias("segment_start"), F.col("text").alias("segment_text")).distinct()
    met = cue_segments(spark, sf_dir).select("doc_id", "cue_id", "episode_id", "nearest.segment_id")
    return met.join(cues, ["doc_id", "cue_id"]).join(segments, ["episode_id", "segment_id"], "left").select(
        "doc_id", "cue_id", "cue_start", "cue_text", "segment_id", "segment_start", "segment_text"
    )


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs}

_PAIRS = """
WITH c AS (SELECT DISTINCT doc_id, id AS cue_id, "start" AS cue_start, text AS cue_text, round("start" * 1000.0)::BIGINT AS t
           FROM cues WHERE "start" IS NOT NULL AND isfinite("start")),
l AS (SELECT c.*, d.episode_id FROM c JOIN subtitle_docs d USING (doc_id) WHERE d.episode_id IS NOT NULL),
s AS (SELECT DISTINCT episode_id, id, idx, "start" AS segment_start, text AS segment_text, round("start" * 1000.0)::BIGINT AS u
      FROM segments WHERE "start" IS NOT NULL AND isfinite("start")),
p AS (SELECT l.*, s.id AS segment_id, s.segment_start, s.segment_text,
             row_number() OVER (PARTITION BY l.doc_id, l.cue_id ORDER BY abs(s.u - l.t) NULLS LAST, s.u, s.segment_start, s.idx, s.id) AS n
      FROM l LEFT JOIN s ON s.episode_id = l.episode_id AND s.u BETWEEN l.t - 1500 AND l.t + 1500)
"""
ORACLE = {
    "p5_found": _PAIRS + "SELECT doc_id, cue_id, segment_id FROM p WHERE n = 1 AND segment_id IS NOT NULL",
    "p5_pairs": _PAIRS + "SELECT doc_id, cue_id, cue_start, cue_text, segment_id, segment_start, segment_text FROM p WHERE n = 1",
}
