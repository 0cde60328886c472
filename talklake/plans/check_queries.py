"""Validation reports, status counts and sums that respect unknown values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.functions.text import identifier, strip
from talklake.operators.sequence import idx_shard, prefix
from talklake.plans.base import CUES, SEGMENTS, cues, segments, tracks
from talklake.runtime import finite, millis, table


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, code) of every rule that a row breaks, in one pass; a rule that is null is broken."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    return rows.select(*keys, F.explode(codes).alias("code"))


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of segments and chapters: bounds, order, references, text, identifiers, uniqueness."""
    s = segments(spark, sf_dir)
    told = prefix(s, ["episode_id"], idx_shard(), [F.col("idx").asc_nulls_last(), F.col("id")], {"_before": ("lag", "start_ms")})
    people = table(spark, sf_dir, "speakers").select("episode_id", F.col("id").alias("speaker_id"), F.lit(True).alias("_known")).distinct()
    lengths = table(spark, sf_dir, "episodes").groupBy(F.col("id").alias("episode_id")).agg(F.max(millis("duration_seconds")).alias("_ms"))
    met = told.join(people, ["episode_id", "speaker_id"], "left").join(lengths, "episode_id", "left")
    rules = {
        "bounds_missing": F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(),
        "end_before_start": F.coalesce(F.col("end_ms") >= F.col("start_ms"), F.lit(True)),
        "start_decreases": F.coalesce(F.col("start_ms") >= F.col("_before"), F.lit(True)),
        "after_duration": F.coalesce(F.col("end_ms") <= F.col("_ms") + 1000, F.lit(True)),
        "speaker_unknown": F.col("speaker_id").isNull() | F.col("_known"),
        "text_empty": (strip(F.coalesce("text", F.lit(""))) != "") & (strip(F.coalesce("raw_text", F.lit(""))) != ""),
        "id_invalid": identifier("id"),
    }
    own = violations(met, ["episode_id", "id"], rules)
    twice = s.groupBy("episode_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("episode_id", "id", F.lit("id_repeated").alias("code"))
    c = table(spark, sf_dir, "chapters").select("episode_id", "id", "segment_id", millis("start").alias("at_ms")).distinct()
    first = s.groupBy("episode_id", F.col("id").alias("segment_id")).agg(F.min("start_ms").alias("seg_ms"), F.lit(True).alias("there"))
    cm = c.join(first, ["episode_id", "segment_id"], "left")
    chapter_rules = {
        "chapter_segment_missing": F.col("segment_id").isNull() | F.col("there"),
        "chapter_off_segment": F.coalesce(F.abs(F.col("at_ms") - F.col("seg_ms")) <= 10, F.lit(True)),
    }
    all_ = own.unionByName(twice).unionByName(violations(cm, ["episode_id", "id"], chapter_rules))
    return all_.groupBy("episode_id", "code").agg(F.count(F.lit(1)).alias("rows"))


def cue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of cues per track."""
    c = cues(spark, sf_dir)
    told = prefix(c, ["doc_id"], idx_shard(), [F.col("idx").asc_nulls_last(), F.col("id")], {"_before": ("lag", "start_ms")})
    rules = {
        "bounds_missing": F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(),
        "no_length": F.coalesce(F.col("end_ms") > F.col("start_ms"), F.lit(True)),
        "start_decreases": F.coalesce(F.col("start_ms") >= F.col("_before"), F.lit(True)),
        "confidence_invalid": F.col("confidence").isNull() | (finite("confidence") & F.col("confidence").between(0, 100)),
    }
    return violations(told, ["doc_id"], rules).groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("rows"))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editing state of every episode: counts by status, unknown speakers, characters left, first pending segment."""
    s = segments(spark, sf_dir)
    pending = F.col("review_status") != "reviewed"
    return s.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("segments"),
        *[F.count_if(F.col("review_status") == v).alias(v) for v in ("unreviewed", "needs_review", "edited", "reviewed")],
        F.count_if(F.col("speaker_id").isNull()).alias("no_speaker"),
        F.coalesce(F.sum(F.when(pending, F.length("text"))), F.lit(0)).cast("long").alias("pending_chars"),
        F.min_by(F.when(pending, F.col("id")), F.when(pending, F.col("idx"))).alias("first_pending"),
    )


def null_poison_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration of tracks per format: one unknown length makes the sum unknown, and the known part is given beside it."""
    t = tracks(spark, sf_dir).select("format", millis("duration_seconds").alias("ms"))
    return t.groupBy("format").agg(
        F.when(F.count(F.lit(1)) == F.count("ms"), F.sum("ms")).alias("total_ms"), F.coalesce(F.sum("ms"), F.lit(0)).alias("known_ms"), (F.count(F.lit(1)) - F.count("ms")).alias("unknown")
    )


def unanimous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of an episode's tracks if all agree, else null, with the number of spellings."""
    t = tracks(spark, sf_dir).where("episode_id is not null")
    return t.groupBy("episode_id").agg(F.when(F.min("language").eqNullSafe(F.max("language")) & (F.count("language") == F.count(F.lit(1))), F.min("language")).alias("language"), F.count_distinct("language").alias("spellings"))


def attempt_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser requests per stream: first attempts, retries, attempts without an end, audio submitted (unknown if any attempt has none)."""
    e = table(spark, sf_dir, "asr_events")
    per = e.groupBy("stream_id", "attempt").agg(F.bool_or(F.col("type") == "transcript.text.done").alias("done"), F.max(F.when(F.col("type") == "transcript.text.segment", millis("end"))).alias("ms"))
    return per.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("attempts"), (F.count(F.lit(1)) - 1).alias("retries"), F.count_if(~F.col("done")).alias("failed"), F.when(F.count(F.lit(1)) == F.count("ms"), F.sum("ms")).alias("audio_ms")
    )


def library_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with several titles, and episode ids with differing records."""
    e = table(spark, sf_dir, "episodes")
    series = e.where("series.id is not null").groupBy(F.col("series.id").alias("key")).agg(F.count_distinct("series.title").alias("n")).where("n > 1").select(F.lit("series_titles").alias("kind"), "key", "n")
    ids = e.groupBy(F.col("id").alias("key")).agg(F.count_distinct("revision").alias("n"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.lit("episode_rows").alias("kind"), "key", F.col("c").alias("n"))
    return reduce(DataFrame.unionByName, [series, ids])


QUERIES = {f.__name__: f for f in (validation_report, cue_report, status_rollup, null_poison_sum, unanimous_value, attempt_usage, library_conflicts)}

_BLANK = r"regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}]+', '', 'g')"
ORACLE = {
    "validation_report": f"""WITH {SEGMENTS}, a AS (SELECT *, lag(start_ms) OVER (PARTITION BY episode_id ORDER BY idx, id) AS b FROM sg),
kn AS (SELECT DISTINCT episode_id, id AS w FROM speakers), du AS (SELECT id, max(CASE WHEN isfinite(duration_seconds) THEN round(duration_seconds * 1000.0)::BIGINT END) AS ms FROM episodes GROUP BY id),
m AS (SELECT a.*, kn.w, du.ms FROM a LEFT JOIN kn ON kn.episode_id = a.episode_id AND kn.w = a.speaker_id LEFT JOIN du ON du.id = a.episode_id),
ch AS (SELECT DISTINCT episode_id, id, segment_id, CASE WHEN isfinite("start") THEN round("start" * 1000.0)::BIGINT END AS t FROM chapters),
f AS (SELECT episode_id, id AS segment_id, min(start_ms) AS sm FROM sg GROUP BY ALL),
v AS (SELECT episode_id, 'bounds_missing' AS code FROM m WHERE start_ms IS NULL OR end_ms IS NULL
 UNION ALL SELECT episode_id, 'end_before_start' FROM m WHERE end_ms < start_ms
 UNION ALL SELECT episode_id, 'start_decreases' FROM m WHERE start_ms < b
 UNION ALL SELECT episode_id, 'after_duration' FROM m WHERE end_ms > ms + 1000
 UNION ALL SELECT episode_id, 'speaker_unknown' FROM m WHERE speaker_id IS NOT NULL AND w IS NULL
 UNION ALL SELECT episode_id, 'text_empty' FROM m WHERE {_BLANK.format('text')} = '' OR {_BLANK.format('raw_text')} = ''
 UNION ALL SELECT episode_id, 'id_invalid' FROM m WHERE NOT coalesce(regexp_full_match(id, '[A-Za-z0-9_-]{{1,100}}'), false)
 UNION ALL SELECT episode_id, 'id_repeated' FROM (SELECT episode_id, id FROM sg GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT ch.episode_id, 'chapter_segment_missing' FROM ch LEFT JOIN f USING (episode_id, segment_id) WHERE ch.segment_id IS NOT NULL AND f.episode_id IS NULL
 UNION ALL SELECT ch.episode_id, 'chapter_off_segment' FROM ch JOIN f USING (episode_id, segment_id) WHERE abs(t - sm) > 10)
SELECT episode_id, code, count(*) AS rows FROM v GROUP BY ALL""",
    "cue_report": f"""WITH {CUES}, a AS (SELECT *, lag(start_ms) OVER (PARTITION BY doc_id ORDER BY idx, id) AS b FROM cu),
v AS (SELECT doc_id, 'bounds_missing' AS code FROM a WHERE start_ms IS NULL OR end_ms IS NULL UNION ALL SELECT doc_id, 'no_length' FROM a WHERE end_ms <= start_ms
 UNION ALL SELECT doc_id, 'start_decreases' FROM a WHERE start_ms < b UNION ALL SELECT doc_id, 'confidence_invalid' FROM a WHERE confidence IS NOT NULL AND NOT (isfinite(confidence) AND confidence BETWEEN 0 AND 100))
SELECT doc_id, code, count(*) AS rows FROM v GROUP BY ALL""",
    "status_rollup": f"""WITH {SEGMENTS} SELECT episode_id, count(*) AS segments, count(*) FILTER (review_status = 'unreviewed') AS unreviewed, count(*) FILTER (review_status = 'needs_review') AS needs_review,
count(*) FILTER (review_status = 'edited') AS edited, count(*) FILTER (review_status = 'reviewed') AS reviewed, count(*) FILTER (speaker_id IS NULL) AS no_speaker,
coalesce(sum(length(text)) FILTER (review_status <> 'reviewed'), 0)::BIGINT AS pending_chars, arg_min(id, idx) FILTER (review_status <> 'reviewed') AS first_pending FROM sg GROUP BY episode_id""",
    "null_poison_sum": """WITH t AS (SELECT format, CASE WHEN isfinite(duration_seconds) THEN round(duration_seconds * 1000.0)::BIGINT END AS ms FROM subtitle_docs)
SELECT format, CASE WHEN count(*) = count(ms) THEN sum(ms)::BIGINT END AS total_ms, coalesce(sum(ms), 0)::BIGINT AS known_ms, count(*) - count(ms) AS unknown FROM t GROUP BY format""",
    "unanimous_value": """SELECT episode_id, CASE WHEN count(DISTINCT language) = 1 AND count(language) = count(*) THEN min(language) END AS language, count(DISTINCT language) AS spellings
FROM subtitle_docs WHERE episode_id IS NOT NULL GROUP BY episode_id""",
    "attempt_usage": """WITH p AS (SELECT stream_id, attempt, bool_or(type = 'transcript.text.done') AS d, max(CASE WHEN type = 'transcript.text.segment' AND isfinite("end") THEN round("end" * 1000.0)::BIGINT END) AS ms FROM asr_events GROUP BY ALL)
SELECT stream_id, count(*) AS attempts, count(*) - 1 AS retries, count(*) FILTER (NOT d) AS failed, CASE WHEN count(*) = count(ms) THEN sum(ms)::BIGINT END AS audio_ms FROM p GROUP BY stream_id""",
    "library_conflicts": """SELECT 'series_titles' AS kind, series.id AS key, count(DISTINCT series.title) AS n FROM episodes WHERE series.id IS NOT NULL GROUP BY series.id HAVING count(DISTINCT series.title) > 1
UNION ALL SELECT 'episode_rows', id, count(*) FROM episodes GROUP BY id HAVING count(*) > 1""",
}
