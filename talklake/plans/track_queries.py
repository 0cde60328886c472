"""Assessment, comparison and repair of subtitle tracks; recogniser streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.operators import assess as A
from talklake.operators.align import align
from talklake.plans.base import cues, segments, timed, tracks
from talklake.plans.interval_queries import repair_ranges
from talklake.runtime import millis, table


def assess_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons against every track as an English one."""
    t = tracks(spark, sf_dir).select("doc_id", "status", "language", "confidence_scale", millis("duration_seconds").alias("duration_ms"))
    return A.assess(cues(spark, sf_dir), t, "en")


def align_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track against the segments of its episode."""
    t = tracks(spark, sf_dir).where("episode_id is not null").select("doc_id", "episode_id")
    s = timed(segments(spark, sf_dir)).join(t, "episode_id").select("doc_id", "idx", "id", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text")
    c = timed(cues(spark, sf_dir)).join(t, "doc_id").select("doc_id", "idx", "id", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text", F.col("low_confidence").alias("low"))
    return align(s, c)


def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every track by status, and the covered share in thousandths."""
    a = align_text(spark, sf_dir)
    own = F.col("segment_id").isNotNull()
    covered = F.count_if(F.col("status").isin("match", "text_difference"))
    return a.groupBy("doc_id").agg(
        F.count_if(own).alias("segments"), F.count_if(F.col("status") == "match").alias("matched"), F.count_if(F.col("status") == "text_difference").alias("different"),
        F.count_if(F.col("status") == "no_subtitle").alias("without"), F.count_if(~own).alias("unaligned"), F.try_divide(covered * 1000, F.count_if(own)).cast("long").alias("covered_permille"),
    )


def repaired_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues outside the repair ranges, with the segments that begin in a range in place of those inside."""
    r = repair_ranges(spark, sf_dir).select("doc_id", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"))
    c = timed(cues(spark, sf_dir)).select("doc_id", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text")
    t = tracks(spark, sf_dir).where("episode_id is not null").select("doc_id", "episode_id")
    s = timed(segments(spark, sf_dir)).join(t, "episode_id").select("doc_id", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text")
    wide = r.withColumns({"range_start": F.col("start"), "range_end": F.col("end")})
    met = A.overlap_join(s, wide, "doc_id", "strict").where(F.col("start") >= F.col("range_start"))
    rows = met.select("doc_id", "range_start", "range_end", (F.col("start") - F.col("range_start")).alias("start"), (F.col("end") - F.col("range_start")).alias("end"), "text")
    out = A.replace_ranges(c, r, rows, "doc_id")
    return out.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).cast("long").alias("chars"))


def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every recogniser attempt: complete, incomplete, or why it is invalid.

    Ids must be unique apart from redelivered rows, starts must not decrease in order of seq, and the full text must equal that of the segments without blanks.
    """
    e = table(spark, sf_dir, "asr_events").select("stream_id", "attempt", "seq", "type", "id", "text", millis("start").alias("ms")).distinct()
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\p{Z}\x1c-\x1f\x85]+", "")
    seg = F.col("type") == "transcript.text.segment"
    per = e.groupBy("stream_id", "attempt").agg(
        F.bool_or(F.col("type") == "transcript.text.done").alias("done"),
        F.count_if(seg).alias("segments"),
        F.count_distinct(F.when(seg, F.col("id"))).alias("ids"),
        F.array_sort(F.collect_list(F.when(seg, F.struct("seq", "ms", bare.alias("t"))))).alias("rows"),
        F.max(F.when(F.col("type") == "transcript.text.done", F.md5(bare))).alias("full"),
    )
    joined = F.md5(F.array_join(F.transform("rows", lambda r: r["t"]), ""))
    falls = F.exists(F.zip_with(F.slice("rows", 1, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda a, b: b["ms"] < a["ms"]), lambda x: x)
    state = F.when(~F.col("done"), "incomplete").when(F.col("ids") < F.col("segments"), "id_repeated").when(F.coalesce(falls, F.lit(False)), "not_in_order").when(joined != F.col("full"), "text_differs").otherwise("complete")
    return per.select("stream_id", "attempt", "segments", state.alias("state"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users' events with pauses under ten minutes (batch form of the streaming job)."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id")
    s = e.groupBy("user_id", F.session_window("at", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events")


QUERIES = {f.__name__: f for f in (assess_tracks, align_text, alignment_summary, repaired_tracks, stream_attempts, stream_sessions)}
ORACLE = {
    "stream_sessions": """WITH a AS (SELECT user_id, epoch_us(ts) AS us FROM events), b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 600000000 THEN 0 ELSE 1 END AS f FROM a),
c AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, min(us) AS start_us, max(us) + 600000000 AS end_us, count(*) AS events FROM c GROUP BY user_id, k""",
    "stream_attempts": """WITH e AS (SELECT DISTINCT stream_id, attempt, seq, type, id, text, CASE WHEN isfinite("start") THEN round("start" * 1000.0)::BIGINT END AS ms FROM asr_events),
b AS (SELECT *, regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\x1c-\x1f\x85]+', '', 'g') AS t, type = 'transcript.text.segment' AS g FROM e),
o AS (SELECT *, CASE WHEN g THEN lag(ms) OVER (PARTITION BY stream_id, attempt, g ORDER BY seq, ms, t) END AS p FROM b),
a AS (SELECT stream_id, attempt, bool_or(type = 'transcript.text.done') AS d, count(*) FILTER (g) AS segments, count(DISTINCT id) FILTER (g) AS ids, coalesce(bool_or(g AND ms < p), false) AS falls,
 coalesce(string_agg(t, '' ORDER BY seq, ms, t) FILTER (g), '') AS joined, max(t) FILTER (type = 'transcript.text.done') AS whole FROM o GROUP BY stream_id, attempt)
SELECT stream_id, attempt, segments, CASE WHEN NOT d THEN 'incomplete' WHEN ids < segments THEN 'id_repeated' WHEN falls THEN 'not_in_order' WHEN joined <> whole THEN 'text_differs' ELSE 'complete' END AS state FROM a""",
}
