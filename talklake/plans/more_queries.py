"""Remaining rules and small operators: recogniser rows, chunk checks, labels, versions, paging by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talklake.functions import text as T
from talklake.operators.catalog import catalog_problems
from talklake.operators.chunks import plan_problems, stitch
from talklake.operators.frames import spans, without_static
from talklake.operators.versioning import compare_versions
from talklake.plans.base import SEGMENTS, segments, sql_ms, timed
from talklake.plans.page_queries import CHUNK_KINDS, chunk_plan
from talklake.runtime import finite, millis, table


def asr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser rows that say something, cut to the length of their attempt; rows that end over a quarter of a second late are marked."""
    e = table(spark, sf_dir, "asr_events").where("type = 'transcript.text.segment'").select("stream_id", "attempt", "id", millis("start").alias("start_ms"), millis("end").alias("end_ms"), "text").distinct()
    length = e.groupBy("stream_id", "attempt").agg(F.max("start_ms").alias("duration_ms"))
    met = e.where(T.strip(F.coalesce("text", F.lit(""))) != "").join(length, ["stream_id", "attempt"])
    late = F.coalesce(F.col("end_ms") > F.col("duration_ms") + 250, F.lit(True))
    return met.select("stream_id", "attempt", "id", "start_ms", F.when(F.col("end_ms").isNotNull(), F.least("end_ms", "duration_ms")).alias("end_ms"), late.alias("late"))


def chunk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of the chunk plans (none is expected), and their chunks by kind of boundary."""
    plan = chunk_plan(spark, sf_dir)
    lengths = timed(segments(spark, sf_dir)).groupBy("episode_id").agg(F.max("end_ms").alias("duration_ms"))
    bad = plan_problems(plan, lengths, "episode_id", 300_000).groupBy(F.col("problem").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return plan.groupBy(F.col("boundary").alias("kind")).agg(F.count(F.lit(1)).alias("n")).unionByName(bad)


def stitched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut back into the rows of their chunks and stitched again: counts and time per episode."""
    s = timed(segments(spark, sf_dir)).select("episode_id", "id", "start_ms", "end_ms", "speaker_id", F.length("text").alias("chars"))
    plan = chunk_plan(spark, sf_dir).where("boundary <> 'too_long'")
    cells = plan.select("*", F.explode(F.sequence(F.floor(F.col("start_ms") / 300_000), F.floor((F.col("end_ms") - 1) / 300_000))).alias("h"))
    at = s.withColumn("h", F.floor(F.col("start_ms") / 300_000)).alias("s").join(cells.alias("c"), ["episode_id", "h"]).where((F.col("s.start_ms") >= F.col("c.start_ms")) & (F.col("s.start_ms") < F.col("c.end_ms")))
    rows = at.select("episode_id", F.col("c.chunk").alias("chunk"), F.col("s.id").alias("row_no"), (F.col("s.start_ms") - F.col("c.start_ms")).alias("start_ms"), (F.col("s.end_ms") - F.col("c.start_ms")).alias("end_ms"), F.col("speaker_id").alias("speaker"), F.col("chars").alias("text"))
    refs = rows.where("speaker = 'speaker-1'").select("episode_id", "chunk", "speaker", F.lit("voice-1").alias("label")).distinct()
    out = stitch(rows, plan, refs, "episode_id")
    return out.groupBy("episode_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("unmatched").alias("unmatched"), F.min("start_ms").alias("first_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


def control_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by presence of control and of unseen characters."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", T.has_control("text").alias("control"), F.regexp_replace("text", "[\n\r\t]", "").rlike(r"[\p{Cc}\p{Cf}]").alias("unseen"))


def deep_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address of every chapter's moment in its episode's source."""
    e = table(spark, sf_dir, "episodes").select(F.col("id").alias("episode_id"), F.col("source.url").alias("url")).dropDuplicates(["episode_id"])
    c = table(spark, sf_dir, "chapters").select("episode_id", "id", "start").distinct()
    return c.join(e, "episode_id").select("episode_id", "id", T.deep_link("url", "start", "cast.example").alias("link"))


def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and whole minutes of every episode."""
    e = table(spark, sf_dir, "episodes").select("id", "published_at", "duration_seconds").distinct()
    return e.select("id", T.date_label("published_at").alias("day"), T.minutes_label("duration_seconds").alias("minutes"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five segments after a given one in every episode (top-k after a cursor)."""
    s = segments(spark, sf_dir).select("episode_id", "idx", "id")
    cursor = s.where("id = 'seg-00004'").select("episode_id", F.col("idx").alias("after"))
    later = s.join(cursor, "episode_id").where("idx > after")
    place = F.row_number().over(Window.partitionBy("episode_id").orderBy("idx", "id"))  # limited before the shuffle
    return later.withColumn("n", place).where("n <= 5").select("episode_id", "idx", "id")


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser labels of every attempt, once each, with the place where they first come."""
    e = table(spark, sf_dir, "asr_events").where("speaker is not null")
    return e.groupBy("stream_id", "attempt", "speaker").agg(F.min("seq").alias("first_seq"))


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dotted versions and their order."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", (F.col("p_size") % 3).cast("string"), F.col("p_size").cast("string"), F.lit("0")).alias("version"))
    return p.select("p_partkey", "version", F.array_join(T.version_key("version").cast("array<string>"), ".").alias("plain"), (T.version_key("version") >= T.version_key(F.lit("1.10"))).alias("recent"))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second copy of the speakers, with some names and roles altered and some rows missing, changes."""
    p = table(spark, sf_dir, "speakers").select("episode_id", "id", "name", "role").distinct()
    after = p.where(F.length("name") % 7 != 0).withColumn("role", F.when(F.col("role") == "", F.lit("guest")).otherwise(F.col("role")))
    return compare_versions(p, after, ["episode_id", "id"], ["name", "role"]).select("episode_id", "id", F.array_join("changed", ",").alias("changed"))


def three_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of which rows differ in all they hold, in what is edited, and in what is reviewed."""
    e = table(spark, sf_dir, "episodes").withColumn("artifacts", F.to_json("artifacts"))
    edited = ["id", "title", "description", "duration_seconds", "summary", "status"]
    told = e.select("id", T.fingerprint(*edited, "revision", "artifacts").alias("a"), T.fingerprint(*edited, "revision").alias("b"), T.fingerprint(*edited).alias("c"))
    return told.groupBy("id").agg(F.count_distinct("a").alias("whole"), F.count_distinct("b").alias("edited"), F.count_distinct("c").alias("reviewed"))


def catalogue_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a catalogue of nations in which some names are shared or reserved."""
    n = table(spark, sf_dir, "nation")
    c = n.select(
        F.when(F.col("n_nationkey") == 3, F.lit("bad id")).when(F.col("n_nationkey") == 5, F.lit("n4")).otherwise(F.concat(F.lit("n"), "n_nationkey")).alias("id"), F.col("n_name").alias("title"),
        F.when(F.col("n_nationkey") == 7, F.array(F.lit(" Brazil "), F.lit("INBOX"))).otherwise(F.array()).alias("aliases"), F.when(F.col("n_nationkey") % 6 != 0, F.array(F.lit("s"))).alias("sources"),
    )
    return catalog_problems(c, ["inbox"])


def frame_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames, one a second: the type and a fixed mark are the text; spans of equal neighbouring texts after the mark is taken out."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    f = e.select(F.lit(0).alias("user_id"), F.col("event_id").cast("int").alias("frame_idx"), F.concat_ws("\n", "event_type", F.lit("logo")).alias("text"), F.col("event_id").cast("double").alias("time"), F.col("value").alias("confidence"), F.lit(False).alias("low"))
    clean = without_static(f, "user_id", 1.0)
    return spans(clean, "user_id", 1.0).groupBy("text").agg(F.count(F.lit(1)).alias("spans"), F.sum("samples").cast("long").alias("samples"))


def finite_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues by state of their confidence."""
    c = table(spark, sf_dir, "cues")
    state = F.when(F.col("confidence").isNull(), "none").when(~finite("confidence"), "not_finite").when(F.col("confidence") < 0, "negative").otherwise("valid")
    return c.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("cues"))


QUERIES = {
    f.__name__: f
    for f in (
        asr_rows, chunk_check, stitched_rows, control_characters, deep_links, date_labels, keyset_page, ordered_distinct, version_order, snapshot_changes, three_fingerprints, catalogue_check,
        frame_spans, finite_confidence,
    )
}

ORACLE = {
    "asr_rows": f"""WITH e AS (SELECT DISTINCT stream_id, attempt, id, {sql_ms('"start"')} AS s, {sql_ms('"end"')} AS e, text FROM asr_events WHERE type = 'transcript.text.segment'),
d AS (SELECT stream_id, attempt, max(s) AS l FROM e GROUP BY ALL)
SELECT stream_id, attempt, id, s AS start_ms, CASE WHEN e IS NOT NULL THEN least(e, l) END AS end_ms, coalesce(e > l + 250, true) AS late FROM e JOIN d USING (stream_id, attempt) WHERE regexp_replace(coalesce(text, ''), '[\\s\\p{{Z}}]+', '', 'g') <> ''""",
    "control_characters": r"""SELECT doc_id, regexp_matches(text, '[\x00-\x1f\x7f]') AS control, regexp_matches(regexp_replace(text, '[\n\r\t]', '', 'g'), '[\p{Cc}\p{Cf}]') AS unseen FROM documents WHERE text IS NOT NULL""",
    "deep_links": """WITH e AS (SELECT DISTINCT ON (id) id AS episode_id, source.url AS url FROM episodes), c AS (SELECT DISTINCT episode_id, id, CASE WHEN "start" IS NOT NULL AND isfinite("start") AND "start" >= 0 THEN floor("start")::BIGINT ELSE 0 END AS s FROM chapters)
SELECT episode_id, c.id, CASE WHEN regexp_matches(url, '^https?://cast\\.example/') THEN url || '?t=' || s ELSE url END AS link FROM c JOIN e USING (episode_id)""",
    "date_labels": """WITH e AS (SELECT DISTINCT id, published_at, duration_seconds FROM episodes), d AS (SELECT *, CASE WHEN regexp_full_match(published_at, '[0-9]{8}') THEN published_at[1:4] || '-' || published_at[5:6] || '-' || published_at[7:8] ELSE left(published_at, 10) END AS x FROM e)
SELECT id, CASE WHEN try_cast(x AS DATE) IS NOT NULL AND length(x) = 10 THEN replace(x, '-', '.') END AS day, CASE WHEN duration_seconds > 0 AND isfinite(duration_seconds) THEN ceil(duration_seconds / 60)::BIGINT ELSE 0 END AS minutes FROM d""",
    "keyset_page": f"""WITH {SEGMENTS}, c AS (SELECT episode_id, idx AS a FROM sg WHERE id = 'seg-00004'), r AS (SELECT sg.*, row_number() OVER (PARTITION BY episode_id ORDER BY idx, id) AS n FROM sg JOIN c USING (episode_id) WHERE idx > a)
SELECT episode_id, idx, id FROM r WHERE n <= 5""",
    "ordered_distinct": "SELECT stream_id, attempt, speaker, min(seq) AS first_seq FROM asr_events WHERE speaker IS NOT NULL GROUP BY ALL",
    "version_order": """SELECT p_partkey, (p_size % 3) || '.' || p_size || '.0' AS version, (p_size % 3) || '.' || p_size AS plain, p_size % 3 > 1 OR (p_size % 3 = 1 AND p_size >= 10) AS recent FROM part""",
    "snapshot_changes": """SELECT DISTINCT episode_id, id, CASE WHEN length(name) % 7 = 0 THEN 'removed' ELSE 'role' END AS changed FROM speakers WHERE length(name) % 7 = 0 OR role = ''""",
    "catalogue_check": """WITH c AS (SELECT CASE n_nationkey WHEN 3 THEN 'bad id' WHEN 5 THEN 'n4' ELSE 'n' || n_nationkey END AS id, n_nationkey AS k, lower(n_name) AS t FROM nation)
SELECT 'bad id' AS id, 'id_invalid' AS problem UNION ALL SELECT 'n4', 'id_repeated' UNION ALL SELECT id, 'sources_count' FROM c WHERE k % 6 = 0 UNION ALL SELECT 'n7', 'name_reserved'
UNION ALL SELECT 'n7', 'name_taken' FROM c WHERE t = 'brazil' AND k <> 7 UNION ALL SELECT id, 'name_taken' FROM c WHERE t = 'brazil' AND k <> 7""",
    "finite_confidence": "SELECT CASE WHEN confidence IS NULL THEN 'none' WHEN NOT isfinite(confidence) THEN 'not_finite' WHEN confidence < 0 THEN 'negative' ELSE 'valid' END AS state, count(*) AS cues FROM cues GROUP BY 1",
    "chunk_check": CHUNK_KINDS,
    "three_fingerprints": """SELECT id, count(DISTINCT (id, title, description, duration_seconds, summary, status, revision, artifacts::VARCHAR)) AS whole, count(DISTINCT (id, title, description, duration_seconds, summary, status, revision)) AS edited,
count(DISTINCT (id, title, description, duration_seconds, summary, status)) AS reviewed FROM episodes GROUP BY id""",
    "frame_spans": """WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (ORDER BY event_id) AND event_id - lag(event_id) OVER (ORDER BY event_id) = 1 THEN 0 ELSE 1 END AS f FROM events),
b AS (SELECT *, sum(f) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS r FROM a) SELECT event_type AS text, count(DISTINCT r) AS spans, count(*) AS samples FROM b GROUP BY event_type""",
}
