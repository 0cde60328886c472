"""Budgeted pages, blocks, batches and chunk plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.functions.text import comparison_text
from talklake.operators.chunks import plan_chunks
from talklake.operators.intervals import interval_gaps
from talklake.operators.sequence import idx_shard, next_fit, rank
from talklake.plans.base import SEGMENTS, segments, timed
from talklake.runtime import table


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return rank(s, ["episode_id"], idx_shard(), [F.col("idx").asc_nulls_last(), F.col("id")], "r")


def reader_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of at most 8 KiB of text or 200 segments."""
    s = _ranked(spark, sf_dir).select("episode_id", "r", F.octet_length("text").alias("bytes"))
    return next_fit(s, "episode_id", "r", "bytes", 8_192, 200)


def alignment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of at most 64 segments, 30 seconds and 4,096 characters."""
    s = rank(timed(segments(spark, sf_dir)), ["episode_id"], idx_shard(), [F.col("idx").asc_nulls_last(), F.col("id")], "r")
    s = s.select("episode_id", "r", F.length("text").alias("chars"), "start_ms", "end_ms")
    return next_fit(s, "episode_id", "r", "chars", 4_096, 64, "start_ms", "end_ms", 30_000.0)


def edit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of segments whose JSON rows, line ends included, hold at most 6,000 characters."""
    s = _ranked(spark, sf_dir)
    row = F.to_json(F.struct("id", "start_ms", "end_ms", "speaker_id", "text"), {"ignoreNullFields": "false"})
    return next_fit(s.select("episode_id", "r", (F.length(row) + 1).alias("chars")), "episode_id", "r", "chars", 6_000, 400)


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most five minutes of every episode, cut in a pause of the last 30 seconds where there is one."""
    s = timed(segments(spark, sf_dir)).select("episode_id", "start_ms", "end_ms")
    lengths = s.groupBy("episode_id").agg(F.max("end_ms").alias("duration_ms"))
    pauses = interval_gaps(s, ["episode_id"])
    return plan_chunks(lengths, pauses, "episode_id", 300_000, 30_000)


def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader page of every chapter that names a segment."""
    pages = reader_pages(spark, sf_dir).select("episode_id", "page", "first_rank", "last_rank")
    at = _ranked(spark, sf_dir).select("episode_id", F.col("id").alias("segment_id"), "r")
    c = table(spark, sf_dir, "chapters").where("segment_id is not null").select("episode_id", F.col("id").alias("chapter_id"), "segment_id").distinct()
    placed = c.join(at, ["episode_id", "segment_id"])
    # Pages hold at most 200 rows, so a rank meets the pages of its own and the neighbouring stretch.
    stretch = F.explode(F.sequence(F.floor(F.col("first_rank") / 200), F.floor(F.col("last_rank") / 200))).alias("h")
    cells = pages.select("*", stretch)
    met = placed.withColumn("h", F.floor(F.col("r") / 200)).join(cells, ["episode_id", "h"]).where(F.col("r").between(F.col("first_rank"), F.col("last_rank")))
    return met.select("episode_id", "chapter_id", "page", F.col("r").alias("segment_index"))


def forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments within two seconds of a forced chunk boundary."""
    cut = chunk_plan(spark, sf_dir).where("boundary = 'forced'").select("episode_id", "end_ms")
    cells = F.explode(F.sequence(F.floor((F.col("end_ms") - 2000) / 4000), F.floor((F.col("end_ms") + 2000) / 4000))).alias("h")
    near = cut.select("episode_id", F.col("end_ms").alias("cut_ms"), cells)
    s = segments(spark, sf_dir).where("start_ms is not null").select("episode_id", "id", "start_ms", F.floor(F.col("start_ms") / 4000).alias("h"))
    return s.join(near, ["episode_id", "h"]).where(F.abs(F.col("start_ms") - F.col("cut_ms")) <= 2000).select("episode_id", "id", "cut_ms").distinct()


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters per page in comparison form, to check pages against each other."""
    s = _ranked(spark, sf_dir).select("episode_id", "r", F.length(comparison_text("text")).cast("long").alias("chars"))
    pages = reader_pages(spark, sf_dir)
    cells = pages.select("*", F.explode(F.sequence(F.floor(F.col("first_rank") / 200), F.floor(F.col("last_rank") / 200))).alias("h"))
    met = s.withColumn("h", F.floor(F.col("r") / 200)).join(cells, ["episode_id", "h"]).where(F.col("r").between(F.col("first_rank"), F.col("last_rank")))
    return met.groupBy("episode_id", "page").agg(F.sum("chars").alias("chars"))


QUERIES = {f.__name__: f for f in (reader_pages, alignment_blocks, edit_batches, chunk_plan, chapter_pages, forced_boundaries, page_texts)}


def _greedy(rows: str, fits: str) -> str:
    """Recursive statement of next-fit: rows (k, r, z, a, b) in order; ``fits`` decides on the open page (c rows, t total, f first start)."""
    return f"""WITH RECURSIVE {SEGMENTS}, q AS ({rows}),
g AS (SELECT k, r, 0::BIGINT AS page, 1::BIGINT AS c, z AS t, a AS f FROM q WHERE r = 0
UNION ALL SELECT q.k, q.r, CASE WHEN {fits} THEN g.page ELSE g.page + 1 END, CASE WHEN {fits} THEN g.c + 1 ELSE 1 END, CASE WHEN {fits} THEN g.t + q.z ELSE q.z END, CASE WHEN {fits} THEN g.f ELSE q.a END
FROM g JOIN q ON q.k = g.k AND q.r = g.r + 1)"""


_R = "row_number() OVER (PARTITION BY episode_id ORDER BY idx, id) - 1 AS r"
_PAGES = "SELECT k AS episode_id, page, min(r) AS first_rank, max(r) AS last_rank, max(t)::BIGINT AS page_size FROM g GROUP BY k, page"
ORACLE = {
    "reader_pages": _greedy(f"SELECT episode_id AS k, {_R}, strlen(text)::BIGINT AS z, 0::BIGINT AS a, 0::BIGINT AS b FROM sg", "g.t + q.z <= 8192 AND g.c < 200") + _PAGES,
    "alignment_blocks": _greedy(
        f"SELECT episode_id AS k, {_R}, length(text)::BIGINT AS z, start_ms AS a, end_ms AS b FROM sg WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL", "g.t + q.z <= 4096 AND g.c < 64 AND q.b - g.f <= 30000"
    ) + _PAGES,
}
ORACLE["chapter_pages"] = ORACLE["reader_pages"].removesuffix(_PAGES) + f""", w AS (SELECT episode_id, id, {_R} FROM sg)
SELECT DISTINCT c.episode_id, c.id AS chapter_id, g.page, w.r AS segment_index FROM chapters c JOIN w ON w.episode_id = c.episode_id AND w.id = c.segment_id JOIN g ON g.k = c.episode_id AND g.r = w.r"""

_CUT = """CASE WHEN d - {0} <= 300000 THEN d ELSE coalesce(list_max(list_transform(list_filter(list_transform(ps, lambda x: {{'a': x.a, 'b': x.b, 't': greatest({0} + 270000, least({0} + 300000, (x.a + x.b) // 2))}}), lambda y: y.t BETWEEN y.a AND y.b), lambda z: z.t)), {0} + 300000) END"""
_PLAN = f"""WITH RECURSIVE {SEGMENTS}, v AS (SELECT * FROM sg WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
w AS (SELECT *, max(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v WHERE end_ms > start_ms),
pz AS (SELECT episode_id, list({{'a': m, 'b': start_ms}}) AS ps FROM w WHERE start_ms > m GROUP BY episode_id),
dz AS (SELECT episode_id AS k, max(end_ms) AS d, coalesce(any_value(ps), []) AS ps FROM v LEFT JOIN pz USING (episode_id) GROUP BY episode_id),
r AS (SELECT k, d, ps, 0 AS chunk, 0::BIGINT AS s, {_CUT.format('0')} AS e FROM dz WHERE d > 0 UNION ALL SELECT k, d, ps, chunk + 1, e, {_CUT.format('e')} FROM r WHERE e < d),
pl AS (SELECT k AS episode_id, chunk, s AS start_ms, e AS end_ms, CASE WHEN d - s <= 300000 THEN 'end' WHEN len(list_filter(ps, lambda x: greatest(s + 270000, least(s + 300000, (x.a + x.b) // 2)) BETWEEN x.a AND x.b)) > 0 THEN 'silence' ELSE 'forced' END AS boundary FROM r)"""
ORACLE["chunk_plan"] = _PLAN + " SELECT episode_id, chunk, start_ms, end_ms, boundary FROM pl"
ORACLE["forced_boundaries"] = _PLAN + " SELECT DISTINCT sg.episode_id, sg.id, pl.end_ms AS cut_ms FROM sg JOIN pl USING (episode_id) WHERE boundary = 'forced' AND abs(sg.start_ms - pl.end_ms) <= 2000"
CHUNK_KINDS = _PLAN + " SELECT boundary AS kind, count(*) AS n FROM pl GROUP BY boundary"
