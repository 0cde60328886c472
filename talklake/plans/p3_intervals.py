"""Problem 3: covered periods and gaps of subtitle tracks, from their cues and report groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.operators.intervals import covered_periods, interval_gaps
from talklake.runtime import millis, table


def track_intervals(cues: DataFrame, groups: DataFrame) -> DataFrame:
    """(source_table, doc_id, start_ms, end_ms, cue_ids) of cues and report groups.

    A group's bound that is null or not finite becomes the smallest start (largest end) of the valid cues
    named in its cue_ids, if there are any; a bound that is there is kept. A bound that stays missing is null.
    """
    timed = cues.select("doc_id", "id", millis("start").alias("start_ms"), millis("end").alias("end_ms"))
    own = timed.select(F.lit("cues").alias("source_table"), "doc_id", "start_ms", "end_ms", F.array("id").alias("cue_ids"))
    grouped = groups.select("doc_id", "idx", millis("start").alias("start_ms"), millis("end").alias("end_ms"), "cue_ids")
    whole = grouped.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    broken = grouped.where(F.col("start_ms").isNull() | F.col("end_ms").isNull())
    named = broken.select("doc_id", "idx", "start_ms", "end_ms", "cue_ids", F.explode_outer("cue_ids").alias("id"))
    valid = timed.where(F.col("end_ms") > F.col("start_ms")).groupBy("doc_id", "id").agg(F.min("start_ms").alias("_a"), F.max("end_ms").alias("_b"))
    mended = (
        named.join(valid, ["doc_id", "id"], "left")
        .groupBy("doc_id", "idx", "start_ms", "end_ms", "cue_ids")
        .agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
        .select("doc_id", F.coalesce("start_ms", "_a").alias("start_ms"), F.coalesce("end_ms", "_b").alias("end_ms"), "cue_ids")
    )
    both = whole.select("doc_id", "start_ms", "end_ms", "cue_ids").unionByName(mended)
    return own.unionByName(both.select(F.lit("report_groups").alias("source_table"), "doc_id", "start_ms", "end_ms", "cue_ids"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of every track, for cues and report groups separately."""
    rows = track_intervals(table(spark, sf_dir, "cues"), table(spark, sf_dir, "report_groups"))
    return interval_gaps(rows, ["source_table", "doc_id"])


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered periods of every track with the cue_ids in each."""
    rows = track_intervals(table(spark, sf_dir, "cues"), table(spark, sf_dir, "report_groups"))
    return covered_periods(rows, ["source_table", "doc_id"], "cue_ids")


QUERIES = {"p3_found": p3_found, "p3_periods": p3_periods}

_MS = "round(greatest(least({0} * 1000.0, 4e15), -4e15))::BIGINT"
_FIN = "({0} IS NOT NULL AND isfinite({0}))"


def _ms(c: str) -> str:
    return f"CASE WHEN {_FIN.format(c)} THEN {_MS.format(c)} END"


_ROWS = f"""
WITH c AS (SELECT doc_id, id, {_ms('"start"')} AS s, {_ms('"end"')} AS e FROM cues),
v AS (SELECT DISTINCT doc_id, id, s, e FROM c WHERE e > s),
g AS (SELECT doc_id, idx, {_ms('"start"')} AS s, {_ms('"end"')} AS e, cue_ids FROM report_groups),
x AS (SELECT DISTINCT doc_id, idx, unnest(cue_ids) AS id FROM g),
m AS (SELECT x.doc_id, x.idx, min(v.s) AS a, max(v.e) AS b FROM x JOIN v USING (doc_id, id) GROUP BY x.doc_id, x.idx),
r AS (SELECT 'cues' AS source_table, doc_id, s, e, [id] AS ids FROM c
      UNION ALL
      SELECT 'report_groups', g.doc_id, coalesce(g.s, m.a), coalesce(g.e, m.b), g.cue_ids FROM g LEFT JOIN m USING (doc_id, idx)),
w AS (SELECT *, max(e) OVER (PARTITION BY source_table, doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
      FROM r WHERE e > s)
"""

ORACLE = {
    "p3_found": _ROWS + "SELECT source_table, doc_id, p AS gap_start_ms, s AS gap_end_ms FROM w WHERE s > p",
    "p3_periods": _ROWS + """,
n AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY source_table, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM w),
b AS (SELECT source_table, doc_id, k, min(s) AS period_start_ms, max(e) AS period_end_ms FROM n GROUP BY ALL),
i AS (SELECT DISTINCT source_table, doc_id, k, s // 600000 AS h, unnest(ids) AS id FROM n),
h AS (SELECT DISTINCT source_table, doc_id, k, s // 600000 AS h FROM n)
SELECT source_table, doc_id, period_start_ms, period_end_ms, (h - period_start_ms // 600000)::INTEGER AS part,
       coalesce(list_sort(list(id) FILTER (id IS NOT NULL)), []) AS cue_ids
FROM h JOIN b USING (source_table, doc_id, k) LEFT JOIN i USING (source_table, doc_id, k, h)
GROUP BY source_table, doc_id, period_start_ms, period_end_ms, h
""",
}
