"""Structural assessment of subtitle tracks as reason codes, from relational measures only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talklake.functions.text import alphanumeric, language
from talklake.operators.cues import coverage, gap_tolerance, overlapping_repeats, repair_ranges
from talklake.operators.intervals import interval_gaps
from talklake.operators.ranges import overlap_join

# Thresholds of the assessment.
MIN_COVERAGE, MIN_DENSITY, MAX_REPAIR, MAX_RANGES, MIN_CONFIDENCE = 0.70, 0.5, 0.20, 5, 0.80
HARD = [
    "invalid_structure", "subtitles_unavailable", "empty_cues", "unknown_duration", "unknown_language", "language_mismatch", "text_language_mismatch",
    "empty_text_content", "invalid_timing", "timing_out_of_bounds", "duplicate_cues", "invalid_confidence", "excessive_overlap", "sparse_long_cue",
    "sparse_text", "sparse_cues", "insufficient_coverage", "repair_limit_exceeded",
]
SOFT = ["low_confidence", "missing_start", "missing_end", "internal_gap"]


def assess(cues: DataFrame, tracks: DataFrame, wanted: str) -> DataFrame:
    """(doc_id, usable, repairable, reasons, ranges) of every track for the wanted language.

    ``cues``: (doc_id, idx, id, start_ms, end_ms, text, confidence, low_confidence); ``tracks``: (doc_id, status, language,
    confidence_scale, duration_ms), one row per doc_id. Cues without both bounds make the structure invalid and are left out of the measures, so
    that a damaged track still gets its other reasons. Without a duration the measures that need one are not judged.
    """
    k = "doc_id"
    whole = cues.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    t = tracks.select(k, "status", "language", "confidence_scale", F.when(F.col("duration_ms") > 0, F.col("duration_ms")).alias("duration_ms"))
    read = whole.join(t.select(k, "confidence_scale"), k).withColumn("letters", alphanumeric("text"))
    most = F.when(F.col("confidence_scale") == "percent", 100.0).otherwise(1.0)
    length = F.col("end_ms") - F.col("start_ms")
    n = F.length("letters")
    low = F.coalesce(F.col("low_confidence"), F.lit(False)) | F.coalesce(F.col("confidence") / most < MIN_CONFIDENCE, F.lit(False))
    count = lambda p: F.sum(F.length(F.regexp_replace("letters", p, "")))
    per = read.groupBy(k).agg(
        F.count(F.lit(1)).alias("cues"), F.sum(n).alias("chars"), count(r"[^\p{L}]").alias("alpha"), count(r"[^\x{3400}-\x{9fff}]").alias("han"), count(r"[^A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]").alias("latin"),
        F.bool_or(n == 0).alias("no_text"), F.bool_or(length <= 0).alias("no_length"), F.max("end_ms").alias("last_ms"), F.min_by("start_ms", F.struct("idx", "id")).alias("first_ms"),
        F.bool_or(F.col("confidence").isNotNull() & (F.col("confidence_scale").isNull() | (F.col("confidence") > most))).alias("bad_confidence"), F.bool_or(low).alias("low"),
        F.bool_or((length >= 20_000) & (n * 1000 < MIN_DENSITY * length)).alias("sparse_long"), F.sum(F.greatest(length, F.lit(0))).alias("raw_ms"),
    )
    damaged = cues.groupBy(k).agg(F.bool_or(F.col("start_ms").isNull() | F.col("end_ms").isNull()).alias("damaged"))
    again = read.where(n >= 12).groupBy(k, F.xxhash64("letters").alias("h"), n.alias("n")).agg(F.count(F.lit(1)).alias("c")).groupBy(k).agg(F.sum((F.col("c") - 1) * F.col("n")).alias("repeated"))
    shown = overlapping_repeats(read.select(k, "idx", "id", "start_ms", "end_ms", F.col("letters").alias("text")), k).select(k).distinct().withColumn("shown_twice", F.lit(True))
    plain = whole.select(k, "idx", "id", "start_ms", "end_ms")
    cover = coverage(plain, k).select(k, "covered_ms")
    tolerance = gap_tolerance(plain, k)
    holes = interval_gaps(plain, [k]).join(tolerance, k).where(F.col("gap_end_ms") - F.col("gap_start_ms") >= F.col("tolerance_ms"))
    edge = F.when(F.col("duration_ms").isNotNull(), F.greatest(F.lit(8_000), F.least(F.lit(30_000), F.col("duration_ms") * 0.02)))
    ends = per.join(t, k).where(F.col("duration_ms").isNotNull())
    cand = (
        read.where(low).select(k, "start_ms", "end_ms", F.lit("low_confidence").alias("reason"))
        .unionByName(holes.select(k, F.col("gap_start_ms").alias("start_ms"), F.col("gap_end_ms").alias("end_ms"), F.lit("internal_gap").alias("reason")))
        .unionByName(ends.where(F.col("first_ms") > edge).select(k, F.lit(0).cast("long").alias("start_ms"), F.col("first_ms").alias("end_ms"), F.lit("missing_start").alias("reason")))
        .unionByName(ends.where(F.col("duration_ms") - F.col("last_ms") > edge).select(k, F.col("last_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit("missing_end").alias("reason")))
    )
    ranges = repair_ranges(plain, cand, t, k)
    spans = ranges.groupBy(k).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("repair_ms"), F.count(F.lit(1)).alias("ranges"))
    # Covered time after repair: cues and ranges together.
    after = coverage(plain.select(k, "start_ms", "end_ms").unionByName(ranges.select(k, "start_ms", "end_ms")), k).select(k, F.col("covered_ms").alias("after_ms"))
    gap_seen = holes.select(k).distinct().withColumn("gap", F.lit(True))
    m = t.join(damaged, k, "left")
    for side in (per, again, shown, cover, spans, after, gap_seen):
        m = m.join(side, k, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    d, chars = F.col("duration_ms"), F.coalesce("chars", F.lit(0))
    spoken = language(F.col("language"))
    codes: dict[str, Column] = {
        "invalid_structure": yes(F.col("damaged")),
        "subtitles_unavailable": ~yes(F.col("status") == "available"),
        "empty_cues": F.coalesce("cues", F.lit(0)) == 0,
        "unknown_duration": d.isNull(),
        "unknown_language": spoken.isNull(),
        "language_mismatch": yes(spoken != wanted),
        "text_language_mismatch": yes(F.when(F.lit(wanted) == "zh", F.col("han") < 0.20 * F.col("alpha")).when(F.lit(wanted) == "en", F.col("latin") < 0.60 * F.col("alpha"))),
        "empty_text_content": yes(F.col("no_text")),
        "invalid_timing": yes(F.col("no_length")),
        "timing_out_of_bounds": yes(F.col("last_ms") > d + 1000),
        "duplicate_cues": yes(F.col("shown_twice")) | yes(F.col("repeated") > 0.20 * F.greatest(chars, F.lit(1))),
        "invalid_confidence": yes(F.col("bad_confidence")),
        "low_confidence": yes(F.col("low")),
        "excessive_overlap": yes(F.col("raw_ms") - F.col("covered_ms") > 0.20 * F.col("raw_ms")),
        "sparse_long_cue": yes(F.col("sparse_long")),
        "sparse_text": d.isNotNull() & yes((chars * 1000 < MIN_DENSITY * d) | (chars < F.least(F.lit(8), d / 1000))),
        "sparse_cues": yes((d >= 120_000) & (F.col("cues") < F.ceil(d / 60_000))),
        "missing_start": yes(F.col("first_ms") > edge),
        "missing_end": yes(d - F.col("last_ms") > edge),
        "internal_gap": d.isNotNull() & yes(F.col("gap")),
        "insufficient_coverage": yes(F.col("covered_ms") < MIN_COVERAGE * d) & (F.col("ranges").isNull() | yes(F.col("after_ms") < MIN_COVERAGE * d)),
        "repair_limit_exceeded": yes((F.col("repair_ms") > MAX_REPAIR * d) | (F.col("ranges") > MAX_RANGES)),
    }
    empty = codes["subtitles_unavailable"] | codes["empty_cues"]
    early = {"invalid_structure", "subtitles_unavailable", "empty_cues"}
    listed = F.array_sort(F.array_compact(F.array(*[F.when(c if code in early else c & ~empty, F.lit(code)) for code, c in codes.items()])))
    told = m.select(k, listed.alias("reasons"), F.coalesce("ranges", F.lit(0)).alias("ranges"))
    hard = F.exists("reasons", lambda r: r.isin(*HARD))
    return told.select(k, (F.size("reasons") == 0).alias("usable"), ((F.col("ranges") > 0) & ~hard).alias("repairable"), "reasons", F.col("ranges").cast("long").alias("ranges"))


def replace_ranges(cues: DataFrame, ranges: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, start, end, text, source): cues that touch no range, and the rows given for the ranges, cut to their end.

    All times in seconds. ``rows`` are (key, range_start, range_end, start, end, text) with times from the start of the range; a row
    that ends up to a quarter of a second late is cut, later ones are left out. Order the result by start, end.
    """
    kept = overlap_join(cues, ranges, key, "strict", how="left_anti").select(key, "start", "end", "text", F.lit("cue").alias("source"))
    room = F.col("range_end") - F.col("range_start")
    good = rows.where((F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= room + 0.25))
    new = good.select(key, (F.col("range_start") + F.least("start", room)).alias("start"), (F.col("range_start") + F.least("end", room)).alias("end"), "text", F.lit("repair").alias("source"))
    return kept.unionByName(new)
