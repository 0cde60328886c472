"""Turns, numbering and neighbours of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.functions.text import strip
from talklake.operators.runs import mark_runs
from talklake.operators.sequence import idx_shard, prefix, rank
from talklake.operators.turns import reading_turns, turn_text
from talklake.plans.base import SEGMENTS, segments
from talklake.runtime import table


def turns_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading turns of every episode."""
    s = segments(spark, sf_dir).select("episode_id", "idx", "id", "start_ms", "end_ms", "speaker_id", "review_status")
    marked = reading_turns(s, table(spark, sf_dir, "speakers"))
    return marked.groupBy("episode_id", "run_shard", "run_no").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.max("_who").alias("known_speaker"), F.min_by("start_ms", "idx").alias("start_ms"),
        F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("segments"), F.bool_or(~F.col("review_status").eqNullSafe(F.lit("reviewed"))).alias("needs_review"),
    ).drop("run_shard", "run_no")


def turns_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users' events in time: one type of event is one speaker, errors are nobody."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    who = e.withColumn("_who", F.when(F.col("event_type") != "error", F.col("event_type")))
    day = F.floor(F.col("at") / F.lit(86_400_000_000)).cast("long")
    marked = mark_runs(who, ["user_id"], day, ["at", "event_id"], "_who")
    return marked.groupBy("user_id", "run_shard", "run_no").agg(
        F.min(F.struct("at", "event_id")).alias("f"), F.max("_who").alias("speaker"), F.count(F.lit(1)).alias("events"), F.max("at").alias("last_us")
    ).select("user_id", F.col("f.event_id").alias("first_event"), "speaker", "events", F.col("f.at").alias("first_us"), "last_us")


def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined text of every turn."""
    s = segments(spark, sf_dir).select("episode_id", "idx", "id", "speaker_id", F.coalesce(F.when(F.col("text") != "", F.col("text")), "raw_text").alias("text"))
    return turn_text(reading_turns(s, table(spark, sf_dir, "speakers")))


def speaker_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser labels numbered by first appearance; blank and unknown labels have no number."""
    e = table(spark, sf_dir, "asr_events").where("type = 'transcript.text.segment'").select("stream_id", "attempt", "seq", "speaker").distinct()
    named = e.where(F.col("speaker").isNotNull() & (strip("speaker") != "") & ~F.lower("speaker").isin("unknown", "none", "null"))
    first = named.groupBy("stream_id", "attempt", "speaker").agg(F.min("seq").alias("idx"))
    shard = idx_shard()
    return rank(first, ["stream_id", "attempt"], shard, ["idx", "speaker"], "n").select("stream_id", "attempt", "speaker", F.concat(F.lit("speaker-"), (F.col("n") + 1).cast("string")).alias("speaker_id"))


def segment_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser rows that say something, renumbered without holes."""
    e = table(spark, sf_dir, "asr_events").where("type = 'transcript.text.segment'").select("stream_id", "attempt", F.col("seq").alias("idx"), "id", "text").distinct()
    kept = e.where(strip(F.coalesce("text", F.lit(""))) != "").groupBy("stream_id", "attempt", "id").agg(F.min("idx").alias("idx"))
    n = rank(kept, ["stream_id", "attempt"], idx_shard(), ["idx", "id"], "n")
    number = (F.col("n") + 1).cast("string")
    return n.select("stream_id", "attempt", "id", F.concat(F.lit("seg-"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)).alias("segment_id"))


def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of the text before and the start of the text after every segment that needs review."""
    s = segments(spark, sf_dir).select("episode_id", "idx", "id", "text", "review_status")
    order = [F.col("idx").asc_nulls_last(), F.col("id")]
    before = prefix(s, ["episode_id"], idx_shard(), order, {"_b": ("lag", "text")})
    backwards = prefix(before, ["episode_id"], -idx_shard(), [F.col("idx").desc_nulls_first(), F.col("id").desc()], {"_a": ("lag", "text")})
    return backwards.where("review_status = 'needs_review'").select("episode_id", "id", F.coalesce(F.right("_b", F.lit(40)), F.lit("")).alias("context_before"), F.coalesce(F.left("_a", F.lit(40)), F.lit("")).alias("context_after"))


QUERIES = {f.__name__: f for f in (turns_segments, turns_events, turn_texts, speaker_numbers, segment_numbers, neighbour_context)}

_TURNS = f"""{SEGMENTS}, kn AS (SELECT DISTINCT episode_id, id AS who FROM speakers),
t1 AS (SELECT sg.*, kn.who FROM sg LEFT JOIN kn ON kn.episode_id = sg.episode_id AND kn.who = sg.speaker_id),
t2 AS (SELECT *, CASE WHEN who = lag(who) OVER (PARTITION BY episode_id ORDER BY idx, id) THEN 0 ELSE 1 END AS f FROM t1),
t3 AS (SELECT *, sum(f) OVER (PARTITION BY episode_id ORDER BY idx, id ROWS UNBOUNDED PRECEDING) AS t FROM t2)"""

TURN_TEXTS = f"""WITH {_TURNS}, x AS (SELECT episode_id, idx, id, t, min(idx) OVER (PARTITION BY episode_id, t) AS first_idx, regexp_replace(coalesce(nullif(text, ''), raw_text), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS v FROM t3),
y AS (SELECT *, last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY episode_id, t ORDER BY idx, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM x),
z AS (SELECT *, CASE WHEN regexp_matches(l, '[A-Za-z0-9.,!?;:)"'']$') AND regexp_matches(v, '^[A-Za-z0-9]') THEN ' ' || v ELSE v END AS piece FROM y),
tt AS (SELECT episode_id, first_idx, (idx // 4096 - first_idx // 4096)::INTEGER AS part, string_agg(piece, '' ORDER BY idx, id) AS text FROM z GROUP BY episode_id, t, first_idx, idx // 4096)"""

ORACLE = {
    "turns_segments": f"""WITH {_TURNS} SELECT episode_id, min(idx) AS first_idx, max(idx) AS last_idx, max(who) AS known_speaker, first(start_ms ORDER BY idx, id) AS start_ms, max(end_ms) AS end_ms,
count(*) AS segments, bool_or(review_status IS DISTINCT FROM 'reviewed') AS needs_review FROM t3 GROUP BY episode_id, t""",
    "turns_events": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN event_type <> 'error' THEN event_type END AS who FROM events),
a AS (SELECT *, CASE WHEN who = lag(who) OVER (PARTITION BY user_id ORDER BY us, event_id) THEN 0 ELSE 1 END AS f FROM e),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS t FROM a)
SELECT user_id, first(event_id ORDER BY us, event_id) AS first_event, max(who) AS speaker, count(*) AS events, min(us) AS first_us, max(us) AS last_us FROM b GROUP BY user_id, t""",
    "turn_texts": TURN_TEXTS + " SELECT episode_id, first_idx, part, text FROM tt",
    "speaker_numbers": """WITH a AS (SELECT stream_id, attempt, speaker, min(seq) AS s FROM asr_events WHERE type = 'transcript.text.segment' AND speaker IS NOT NULL
 AND regexp_replace(speaker, '[\\s\\p{Z}]+', '', 'g') <> '' AND lower(speaker) NOT IN ('unknown', 'none', 'null') GROUP BY ALL)
SELECT stream_id, attempt, speaker, 'speaker-' || row_number() OVER (PARTITION BY stream_id, attempt ORDER BY s, speaker) AS speaker_id FROM a""",
    "segment_numbers": """WITH a AS (SELECT stream_id, attempt, id, min(seq) AS s FROM asr_events WHERE type = 'transcript.text.segment' AND regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', '', 'g') <> '' GROUP BY ALL)
SELECT stream_id, attempt, id, 'seg-' || lpad((row_number() OVER (PARTITION BY stream_id, attempt ORDER BY s, id))::VARCHAR, 5, '0') AS segment_id FROM a""",
    "neighbour_context": f"""WITH {SEGMENTS}, a AS (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS n FROM sg WINDOW w AS (PARTITION BY episode_id ORDER BY idx, id))
SELECT episode_id, id, coalesce(right(b, 40), '') AS context_before, coalesce(left(n, 40), '') AS context_after FROM a WHERE review_status = 'needs_review'""",
}
