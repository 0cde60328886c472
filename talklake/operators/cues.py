"""Operators on subtitle cues and other rows with a start and an end in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talklake.operators.intervals import SHARD_MS, interval_gaps
from talklake.operators.runs import mark_runs
from talklake.operators.sequence import idx_shard, islands, prefix
from talklake.runtime import ensure_checkpoint_dir


def time_shard(col: str = "start_ms") -> Column:
    """Shard of a time column; rows without a time come last."""
    return F.floor(F.coalesce(F.col(col), F.lit(2**62)) / F.lit(SHARD_MS)).cast("long")


def coverage(rows: DataFrame, key: str) -> DataFrame:
    """(key, raw_ms, covered_ms, first_ms, last_ms) of the rows with a positive length."""
    valid = rows.where(F.col("end_ms") > F.col("start_ms"))
    gaps = interval_gaps(valid, [key]).groupBy(F.col(key).alias("_k")).agg(F.sum(F.col("gap_end_ms") - F.col("gap_start_ms")).alias("_gap"))
    whole = valid.groupBy(key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("raw_ms"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))
    met = whole.join(gaps, F.col(key).eqNullSafe(F.col("_k")), "left")
    return met.select(key, "raw_ms", (F.col("last_ms") - F.col("first_ms") - F.coalesce("_gap", F.lit(0))).alias("covered_ms"), "first_ms", "last_ms")


def gap_tolerance(rows: DataFrame, key: str, low: int = 12_000, high: int = 30_000, factor: int = 8) -> DataFrame:
    """(key, tolerance_ms): ``factor`` times the median pause between neighbours in list order, held between low and high.

    Overlaps count as pauses of 0; a key with one row has the low tolerance.
    """
    timed = rows.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    told = prefix(timed, [key], idx_shard(), [F.col("idx").asc_nulls_last(), "id"], {"_before": ("lag", "end_ms")})
    pause = F.when(F.col("_before").isNotNull(), F.greatest(F.lit(0), F.col("start_ms") - F.col("_before")))
    middle = told.groupBy(key).agg(F.median(pause).alias("m"))
    return middle.select(key, F.when(F.col("m").isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col("m") * factor))).otherwise(low).cast("long").alias("tolerance_ms"))


def repair_ranges(cues: DataFrame, candidates: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """(key, start_ms, end_ms, reasons, cues): candidate ranges grown to whole overlapping cues and merged.

    Cues and candidates are cut to [0, duration]. Overlapping ones form islands; islands without a candidate are
    dropped, and kept islands that touch become one. Keys without a duration have no ranges.
    """
    both = (
        cues.select(key, "start_ms", "end_ms", F.lit(None).cast("string").alias("reason"))
        .unionByName(candidates.select(key, "start_ms", "end_ms", "reason"))
        .where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
        .join(durations.where(F.col("duration_ms") > 0).select(key, "duration_ms"), key)
    )
    cut = both.select(key, F.greatest("start_ms", F.lit(0)).alias("start_ms"), F.least("end_ms", "duration_ms").alias("end_ms"), "reason").where(F.col("end_ms") > F.col("start_ms"))
    # Equal rows are kept once with their number, which makes the order total.
    counted = cut.groupBy(key, "start_ms", "end_ms", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    order = ["start_ms", "end_ms", "reason"]
    # Both sets of islands read their input several times; it is written once to the shared checkpoint folder.
    ensure_checkpoint_dir(cues.sparkSession)
    marked = islands(counted.checkpoint(), [key], "start_ms", "end_ms", time_shard(), order, touching=False)
    own = F.col("reason") == ""
    grown = (
        marked.groupBy(key, "island")
        .agg(
            F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
            F.collect_set(F.when(~own, F.col("reason"))).alias("reasons"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("cues"),
        )
        .where(F.size("reasons") > 0)
        .drop("island")
    )
    merged = islands(grown.checkpoint(), [key], "start_ms", "end_ms", time_shard(), ["start_ms", "end_ms"], touching=True)
    return merged.groupBy(key, "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.sum("cues").cast("long").alias("cues"),
    ).drop("island")


def dedupe(cues: DataFrame, key: str) -> DataFrame:
    """(key, first_id, start_ms, end_ms, cues): neighbours of equal text that really overlap become one; touching ones stay."""
    timed = cues.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    runs = mark_runs(timed, [key], idx_shard(), [F.col("idx").asc_nulls_last(), "id"], "text")
    marked = islands(runs, [key, "run_shard", "run_no"], "start_ms", "end_ms", idx_shard(), [F.col("idx").asc_nulls_last(), "id"], touching=False)
    return marked.groupBy(key, "run_shard", "run_no", "island").agg(
        F.min_by("id", F.struct("idx", "id")).alias("first_id"), F.min_by("start_ms", F.struct("idx", "id")).alias("start_ms"),
        F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("cues"),
    ).drop("run_shard", "run_no", "island")


def overlapping_repeats(cues: DataFrame, key: str) -> DataFrame:
    """Cues whose text was seen before in the list with an end after this cue's start."""
    timed = cues.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & F.col("text").isNotNull())
    seen = prefix(timed, [key, "text"], idx_shard(), [F.col("idx").asc_nulls_last(), "id"], {"_reach": ("max", "end_ms")})
    return seen.where(F.col("start_ms") < F.col("_reach")).drop("_reach")


def equal_runs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the run of equal neighbouring values in list order (run_shard, run_no)."""
    return mark_runs(rows, [key], idx_shard(), [F.col("idx").asc_nulls_last(), "id"], value)
