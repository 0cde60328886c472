"""Interval and cue operators on the subtitle tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talklake.operators import cues as ops
from talklake.operators.intervals import interval_gaps
from talklake.operators.ranges import overlap_join
from talklake.operators.sequence import prefix
from talklake.plans.base import CUES, SEGMENTS, cues, segments, sql_ms, timed, tracks
from talklake.runtime import millis, table


def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and raw time of every track."""
    return ops.coverage(cues(spark, sf_dir).select("doc_id", "start_ms", "end_ms"), "doc_id")


def gap_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerated pause of every track, from the median pause."""
    return ops.gap_tolerance(cues(spark, sf_dir).select("doc_id", "idx", "id", "start_ms", "end_ms"), "doc_id")


def low_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of low confidence, by flag or by the scaled value."""
    t = tracks(spark, sf_dir).select("doc_id", "confidence_scale")
    scaled = F.col("confidence") / F.when(F.col("confidence_scale") == "percent", 100.0).otherwise(1.0)
    joined = cues(spark, sf_dir).join(t, "doc_id")
    return joined.where(F.coalesce(F.col("low_confidence"), F.lit(False)) | F.coalesce(scaled < 0.8, F.lit(False)))


def repair_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that another source should replace: uncertain cues and long gaps, grown to whole cues."""
    own = cues(spark, sf_dir).select("doc_id", "idx", "id", "start_ms", "end_ms")
    low = low_cues(spark, sf_dir).select("doc_id", "start_ms", "end_ms", F.lit("low_confidence").alias("reason"))
    gaps = interval_gaps(own, ["doc_id"]).join(ops.gap_tolerance(own, "doc_id"), "doc_id").where(F.col("gap_end_ms") - F.col("gap_start_ms") >= F.col("tolerance_ms"))
    holes = gaps.select("doc_id", F.col("gap_start_ms").alias("start_ms"), F.col("gap_end_ms").alias("end_ms"), F.lit("internal_gap").alias("reason"))
    durations = tracks(spark, sf_dir).select("doc_id", millis("duration_seconds").alias("duration_ms"))
    return ops.repair_ranges(own, low.unionByName(holes), durations, "doc_id")


def _seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"start": F.col("start_ms") / 1000.0, "end": F.col("end_ms") / 1000.0}).drop("start_ms", "end_ms")


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and cues of a track's episode that overlap within a quarter of a second; over 64 cues are flagged."""
    t = tracks(spark, sf_dir).where("episode_id is not null").select("doc_id", "episode_id")
    left = _seconds(timed(segments(spark, sf_dir)).select("episode_id", F.col("id").alias("segment_id"), "start_ms", "end_ms").join(t, "episode_id"))
    right = _seconds(timed(cues(spark, sf_dir)).select("doc_id", F.col("id").alias("cue_id"), "start_ms", "end_ms"))
    pairs = overlap_join(left, right, "doc_id", "tolerant", 0.25)
    per = pairs.groupBy("doc_id", "segment_id").agg(F.count(F.lit(1)).alias("cues"), F.min("cue_id").alias("first_cue"), F.max("cue_id").alias("last_cue"))
    return per.withColumn("overflow", F.col("cues") > 64)


def outside_ranges_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that share no moment with a report group of differing text."""
    ranges = table(spark, sf_dir, "report_groups").where("status <> 'match'").select("doc_id", millis("start").alias("start_ms"), millis("end").alias("end_ms"))
    left = _seconds(timed(cues(spark, sf_dir)).select("doc_id", "id", "start_ms", "end_ms"))
    return overlap_join(left, _seconds(timed(ranges)), "doc_id", "strict", how="left_anti").where(F.col("end") >= F.col("start")).select("doc_id", "id")


def range_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that a report group of differing text cuts: they overlap it and are not inside it."""
    ranges = table(spark, sf_dir, "report_groups").where("status <> 'match'").select("doc_id", F.col("idx").alias("group_idx"), millis("start").alias("start_ms"), millis("end").alias("end_ms"))
    right = _seconds(timed(ranges)).withColumns({"g_start": F.col("start"), "g_end": F.col("end")})
    left = _seconds(timed(cues(spark, sf_dir)).select("doc_id", "id", "start_ms", "end_ms"))
    pairs = overlap_join(left, right, "doc_id", "strict")
    return pairs.where((F.col("start") < F.col("g_start")) | (F.col("end") > F.col("g_end"))).select("doc_id", "id", "group_idx")


def non_overlapping_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice references: per speaker the first segment with 2 to 6 s that no other segment overlaps; at most four per episode."""
    s = timed(segments(spark, sf_dir)).select("episode_id", "idx", "id", "speaker_id", "start_ms", "end_ms")
    inner = s.where("speaker_id is not null").withColumns({"a": F.col("start_ms") + 200, "b": F.least(F.col("end_ms") - 200, F.col("start_ms") + 6200)}).where(F.col("b") - F.col("a") >= 2000)
    left = inner.select("episode_id", "idx", "id", "speaker_id", (F.col("a") / 1000.0).alias("start"), (F.col("b") / 1000.0).alias("end"))
    right = s.select("episode_id", F.col("id").alias("other_id"), (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"))
    hit = overlap_join(left.select("episode_id", "id", "start", "end"), right, "episode_id", "strict").where(F.col("id") != F.col("other_id")).select("episode_id", "id").distinct()
    free = left.join(hit, ["episode_id", "id"], "left_anti")
    first = free.groupBy("episode_id", "speaker_id").agg(F.min(F.struct("idx", "id", "start", "end")).alias("m"))
    order = F.row_number().over(Window.partitionBy("episode_id").orderBy("m.idx", "m.id"))
    return first.withColumn("reference", order).where("reference <= 4").select(
        "episode_id", "reference", "speaker_id", F.col("m.id").alias("segment_id"), F.round(F.col("m.start") * 1000).cast("long").alias("start_ms"), F.round(F.col("m.end") * 1000).cast("long").alias("end_ms")
    )


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("episode_id", F.col("idx").alias("chapter_idx"), F.col("id").alias("chapter_id"), "segment_id", millis("start").alias("at_ms")).distinct()


def asof_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment of every chapter: the named one, else the last in list order that begins by the chapter's second (no start counts as 0), else the first."""
    s = segments(spark, sf_dir).select("episode_id", "idx", "id", "start_ms")
    c = _chapters(spark, sf_dir)
    named = c.join(s.select("episode_id", F.col("id").alias("segment_id"), F.col("idx").alias("named")), ["episode_id", "segment_id"], "left")
    second = lambda x: F.floor(F.greatest(x, F.lit(0)) / 1000).cast("long")
    points = s.select("episode_id", second(F.coalesce("start_ms", F.lit(0))).alias("t"), F.lit(0).alias("kind"), F.col("idx").alias("v"), F.col("id").alias("o"))
    asks = named.select("episode_id", second(F.coalesce("at_ms", F.lit(0))).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("v"), F.col("chapter_id").alias("o"))
    shard = F.floor(F.col("t") / 600).cast("long")
    latest = prefix(points.unionByName(asks), ["episode_id"], shard, ["t", "kind", "o"], {"best": ("max", "v")}).where("kind = 1").select("episode_id", F.col("o").alias("chapter_id"), "best")
    return named.join(latest, ["episode_id", "chapter_id"]).select("episode_id", "chapter_id", F.coalesce("named", "best", F.lit(0)).alias("segment_idx"))


def containing_else_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment of every chapter's start: one that contains it, else the first at or after it, else the last."""
    s = timed(segments(spark, sf_dir)).select("episode_id", "idx", "id", "start_ms", "end_ms")
    c = _chapters(spark, sf_dir).where("at_ms is not null")
    left = c.select("episode_id", "chapter_id", (F.col("at_ms") / 1000.0).alias("start"), (F.col("at_ms") / 1000.0).alias("end"), "at_ms")
    right = _seconds(s).withColumns({"s0": F.col("start"), "e0": F.col("end")}).select("episode_id", "idx", "start", "end", "s0", "e0")
    holds = overlap_join(left, right, "episode_id", "touching").where((F.col("s0") <= F.col("start")) & (F.col("start") < F.col("e0")))
    inside = holds.groupBy("episode_id", "chapter_id").agg(F.min("idx").alias("inside"))
    points = s.select("episode_id", (-F.col("start_ms")).alias("t"), F.lit(0).alias("kind"), F.struct("start_ms", "idx").alias("v"), F.col("id").alias("o"), F.col("idx").alias("i"))
    asks = c.select("episode_id", (-F.col("at_ms")).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<start_ms:bigint,idx:int>").alias("v"), F.col("chapter_id").alias("o"), F.lit(0).alias("i"))
    shard = F.floor(F.col("t") / 600_000).cast("long")
    after = prefix(points.unionByName(asks), ["episode_id"], shard, ["t", "kind", F.col("i").desc(), "o"], {"nxt": ("last", "v")}).where("kind = 1").select("episode_id", F.col("o").alias("chapter_id"), F.col("nxt.idx").alias("nxt"))
    last = s.groupBy("episode_id").agg(F.max("idx").alias("last"))
    return c.join(inside, ["episode_id", "chapter_id"], "left").join(after, ["episode_id", "chapter_id"], "left").join(last, "episode_id").select(
        "episode_id", "chapter_id", F.coalesce("inside", "nxt", "last").alias("segment_idx")
    )


def cue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with overlapping repetitions merged."""
    return ops.dedupe(cues(spark, sf_dir).select("doc_id", "idx", "id", "start_ms", "end_ms", "text"), "doc_id")


def overlap_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that repeat a text still on screen."""
    return ops.overlapping_repeats(cues(spark, sf_dir).select("doc_id", "idx", "id", "start_ms", "end_ms", "text"), "doc_id").select("doc_id", "id")


def run_length_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of neighbouring segments with one review status: members, time and characters."""
    s = segments(spark, sf_dir).select("episode_id", "idx", "id", "start_ms", "end_ms", "review_status", F.length("text").alias("chars"))
    marked = ops.equal_runs(s, "episode_id", "review_status")
    return marked.groupBy("episode_id", "run_shard", "run_no", "review_status").agg(
        F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("segments"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("chars").cast("long").alias("chars")
    ).drop("run_shard", "run_no")


def static_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay through at least two neighbouring cues of a track."""
    c = cues(spark, sf_dir).select("doc_id", "idx", "id", "text")
    marked = ops.equal_runs(c, "doc_id", "text")
    return marked.groupBy("doc_id", "run_shard", "run_no", "text").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("cues")).where("cues >= 2").drop("run_shard", "run_no")


QUERIES = {
    f.__name__: f
    for f in (
        interval_coverage, gap_tolerance, repair_ranges, interval_overlap_join, outside_ranges_anti, range_cuts, non_overlapping_first,
        asof_target, containing_else_next, cue_dedupe, overlap_duplicates, run_length_spans, static_runs,
    )
}

_TOL = """
pz AS (SELECT doc_id, CASE WHEN lag(end_ms) OVER w IS NOT NULL THEN greatest(0, start_ms - lag(end_ms) OVER w) END AS p
       FROM cu WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY idx, id)),
tol AS (SELECT doc_id, (CASE WHEN median(p) IS NULL THEN 12000 ELSE greatest(12000, least(30000, median(p) * 8)) END)::BIGINT AS tolerance_ms FROM pz GROUP BY doc_id)"""
_GRP = f"""SELECT doc_id, idx AS group_idx, {sql_ms('"start"')} AS a, {sql_ms('"end"')} AS b FROM report_groups WHERE status <> 'match'"""
_CH = f"""ch AS (SELECT DISTINCT episode_id, id AS chapter_id, segment_id, {sql_ms('"start"')} AS at_ms FROM chapters)"""

ORACLE = {
    "interval_coverage": f"""WITH {CUES}, w AS (SELECT *, max(end_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cu WHERE end_ms > start_ms)
SELECT doc_id, sum(end_ms - start_ms)::BIGINT AS raw_ms, sum(greatest(0, end_ms - greatest(start_ms, coalesce(m, start_ms))))::BIGINT AS covered_ms, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM w GROUP BY doc_id""",
    "gap_tolerance": f"WITH {CUES}, {_TOL} SELECT doc_id, tolerance_ms FROM tol",
    "repair_ranges": f"""WITH {CUES}, {_TOL},
v AS (SELECT *, max(end_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cu WHERE end_ms > start_ms),
cand AS (SELECT doc_id, m AS s, start_ms AS e, 'internal_gap' AS r FROM v JOIN tol USING (doc_id) WHERE start_ms - m >= tolerance_ms
  UNION ALL SELECT doc_id, start_ms, end_ms, 'low_confidence' FROM cu JOIN subtitle_docs d USING (doc_id)
  WHERE coalesce(cu.low_confidence, false) OR coalesce(cu.confidence / CASE WHEN d.confidence_scale = 'percent' THEN 100.0 ELSE 1.0 END < 0.8, false)),
al AS (SELECT doc_id, start_ms AS s, end_ms AS e, NULL AS r FROM cu UNION ALL SELECT * FROM cand),
cl AS (SELECT doc_id, greatest(s, 0) AS s, least(e, {sql_ms('duration_seconds')}) AS e, r FROM al JOIN subtitle_docs USING (doc_id) WHERE s IS NOT NULL AND e IS NOT NULL AND duration_seconds > 0 AND isfinite(duration_seconds)),
i1 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cl WHERE e > s),
i2 AS (SELECT *, sum(CASE WHEN m IS NULL OR s >= m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e, r ROWS UNBOUNDED PRECEDING) AS k FROM i1),
k1 AS (SELECT doc_id, k, min(s) AS s, max(e) AS e, list(r) FILTER (r IS NOT NULL) AS rs, count(*) FILTER (r IS NULL) AS n FROM i2 GROUP BY doc_id, k HAVING count(r) > 0),
i3 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM k1),
i4 AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM i3)
SELECT doc_id, min(s) AS start_ms, max(e) AS end_ms, list_sort(list_distinct(flatten(list(rs)))) AS reasons, sum(n)::BIGINT AS cues FROM i4 GROUP BY doc_id, g""",
    "interval_overlap_join": f"""WITH {CUES}, {SEGMENTS}
SELECT d.doc_id, sg.id AS segment_id, count(*) AS cues, min(cu.id) AS first_cue, max(cu.id) AS last_cue, count(*) > 64 AS overflow
FROM sg JOIN subtitle_docs d USING (episode_id) JOIN cu ON cu.doc_id = d.doc_id AND sg.start_ms <= cu.end_ms + 250 AND cu.start_ms <= sg.end_ms + 250
WHERE sg.end_ms >= sg.start_ms AND cu.end_ms >= cu.start_ms GROUP BY d.doc_id, sg.id""",
    "outside_ranges_anti": f"""WITH {CUES}, g AS ({_GRP}) SELECT doc_id, id FROM cu WHERE end_ms >= start_ms AND NOT EXISTS
(SELECT 1 FROM g WHERE g.doc_id = cu.doc_id AND g.b >= g.a AND cu.start_ms < g.b AND cu.end_ms > g.a)""",
    "range_cuts": f"""WITH {CUES}, g AS ({_GRP}) SELECT cu.doc_id, cu.id, group_idx FROM cu JOIN g ON g.doc_id = cu.doc_id AND g.b >= g.a AND cu.end_ms >= cu.start_ms
AND cu.start_ms < g.b AND cu.end_ms > g.a AND (cu.start_ms < g.a OR cu.end_ms > g.b)""",
    "non_overlapping_first": f"""WITH {SEGMENTS}, e AS (SELECT *, start_ms + 200 AS a, least(end_ms - 200, start_ms + 6200) AS b FROM sg WHERE speaker_id IS NOT NULL),
f AS (SELECT * FROM e WHERE b - a >= 2000 AND NOT EXISTS (SELECT 1 FROM sg o WHERE o.episode_id = e.episode_id AND o.id <> e.id AND o.end_ms >= o.start_ms AND o.start_ms < e.b AND o.end_ms > e.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, speaker_id ORDER BY idx, id) AS n FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY idx, id) AS reference FROM r WHERE n = 1)
SELECT episode_id, reference::INTEGER AS reference, speaker_id, id AS segment_id, a AS start_ms, b AS end_ms FROM t WHERE reference <= 4""",
    "asof_target": f"""WITH {SEGMENTS}, {_CH}
SELECT ch.episode_id, ch.chapter_id, coalesce(max(n.idx), max(s.idx), 0) AS segment_idx FROM ch
LEFT JOIN sg n ON n.episode_id = ch.episode_id AND n.id = ch.segment_id
LEFT JOIN sg s ON s.episode_id = ch.episode_id AND greatest(coalesce(s.start_ms, 0), 0) // 1000 <= greatest(coalesce(ch.at_ms, 0), 0) // 1000 GROUP BY ALL""",
    "containing_else_next": f"""WITH {SEGMENTS}, {_CH}, q AS (SELECT * FROM sg WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL)
SELECT episode_id, chapter_id, coalesce(
 (SELECT min(idx) FROM q WHERE q.episode_id = ch.episode_id AND q.start_ms <= ch.at_ms AND ch.at_ms < q.end_ms),
 (SELECT min_by(idx, start_ms * 1000000 + idx) FROM q WHERE q.episode_id = ch.episode_id AND q.start_ms >= ch.at_ms),
 (SELECT max(idx) FROM q WHERE q.episode_id = ch.episode_id)) AS segment_idx
FROM ch WHERE at_ms IS NOT NULL AND episode_id IN (SELECT episode_id FROM q)""",
    "cue_dedupe": f"""WITH {CUES}, a AS (SELECT *, CASE WHEN text = lag(text) OVER w THEN 0 ELSE 1 END AS f FROM cu WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY idx, id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY idx, id ROWS UNBOUNDED PRECEDING) AS r FROM a),
c AS (SELECT *, max(end_ms) OVER (PARTITION BY doc_id, r ORDER BY idx, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b),
d AS (SELECT *, sum(CASE WHEN m IS NULL OR start_ms >= m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, r ORDER BY idx, id ROWS UNBOUNDED PRECEDING) AS k FROM c)
SELECT doc_id, arg_min(id, idx) AS first_id, arg_min(start_ms, idx) AS start_ms, max(end_ms) AS end_ms, count(*) AS cues FROM d GROUP BY doc_id, r, k""",
    "overlap_duplicates": f"""WITH {CUES}, a AS (SELECT *, max(end_ms) OVER (PARTITION BY doc_id, text ORDER BY idx, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cu WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL)
SELECT doc_id, id FROM a WHERE start_ms < m""",
    "run_length_spans": f"""WITH {SEGMENTS}, a AS (SELECT *, CASE WHEN review_status = lag(review_status) OVER (PARTITION BY episode_id ORDER BY idx, id) THEN 0 ELSE 1 END AS f FROM sg),
b AS (SELECT *, sum(f) OVER (PARTITION BY episode_id ORDER BY idx, id ROWS UNBOUNDED PRECEDING) AS r FROM a)
SELECT episode_id, review_status, min(idx) AS first_idx, count(*) AS segments, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(length(text))::BIGINT AS chars FROM b GROUP BY episode_id, r, review_status""",
    "static_runs": f"""WITH {CUES}, a AS (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY doc_id ORDER BY idx, id) THEN 0 ELSE 1 END AS f FROM cu),
b AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY idx, id ROWS UNBOUNDED PRECEDING) AS r FROM a)
SELECT doc_id, text, min(idx) AS first_idx, count(*) AS cues FROM b GROUP BY doc_id, r, text HAVING count(*) >= 2""",
}
