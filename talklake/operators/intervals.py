"""Covered periods and gaps of overlapping intervals (two-level, time-sharded).

Level one clips every interval into fixed time shards and merges inside each shard. An interval that
spans whole shards is kept as a *run of shards* (first, end), so it costs three rows however long it is.
Level two works on one row per (key, shard): it stitches coverage over shard boundaries and finds the
shards that runs cover completely. No step needs all intervals of one key in one task: the first level
is bounded by the distinct start moments in a shard, the second by the number of shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Default shard length. A shard holds at most this many distinct start moments after pre-aggregation.
SHARD_MS = 600_000


def _clip(intervals: DataFrame, keys: Sequence[str], start: str, end: str, shard_ms: int) -> DataFrame:
    """Rows (keys, shard, s, e, run_end): pieces inside one shard, or runs of whole shards (s null)."""
    first = F.floor(F.col(start) / F.lit(shard_ms)).cast("long")
    last = F.floor((F.col(end) - 1) / F.lit(shard_ms)).cast("long")
    s, e = F.col(start), F.col(end)
    none = F.lit(None).cast("long")

    def piece(shard, a, b, run):
        return F.struct(shard.alias("shard"), a.alias("s"), b.alias("e"), run.alias("run_end"))

    edge = lambda k: k * F.lit(shard_ms)
    pieces = F.when(first == last, F.array(piece(first, s, e, none))).otherwise(
        F.array_compact(
            F.array(
                piece(first, s, edge(first + 1), none),
                piece(last, edge(last), e, none),
                F.when(last > first + 1, piece(first + 1, none, none, last)),
            )
        )
    )
    return intervals.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*")


def interval_gaps(
    intervals: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", shard_ms: int = SHARD_MS
) -> DataFrame:
    """Gaps of at least 1 ms between two covered moments, per key: (keys, gap_start_ms, gap_end_ms).

    ``start`` and ``end`` are whole milliseconds. Rows with a null bound or ``end <= start`` cover
    nothing; intervals that touch leave no gap; repeated and nested intervals change nothing. A null key
    is a key of its own. Empty input gives an empty result. Columns other than the keys and the two bounds are ignored.
    """
    keys = list(keys)
    rows = intervals.where(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    clipped = _clip(rows, keys, "_s", "_e", shard_ms)
    by = [*keys, "shard"]
    # Pre-aggregated before the shuffle: the furthest end of each distinct start.
    distinct = clipped.groupBy(*by, "s").agg(F.max("e").alias("e"), F.max("run_end").alias("run_end"))
    in_shard = Window.partitionBy(*by).orderBy(F.col("s").asc_nulls_first())
    seen = in_shard.rowsBetween(Window.unboundedPreceding, -1)
    local = distinct.select("*", F.max("e").over(seen).alias("before"))
    # One row per shard: its covered bounds, the runs that begin here, and its own gaps.
    shards = local.groupBy(*by).agg(
        F.min("s").alias("lo"),
        F.max("e").alias("hi"),
        F.max("run_end").alias("run_end"),
        F.collect_list(F.when(F.col("s") > F.col("before"), F.struct(F.col("before").alias("a"), F.col("s").alias("b")))).alias("gaps"),
    )
    order = Window.partitionBy(*keys).orderBy("shard")
    upto, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    run = F.max("run_end").over(upto)  # shards before this number are covered by a run
    run_before = F.max("run_end").over(past)
    reach = F.greatest(F.max("hi").over(past), run_before * F.lit(shard_ms))
    begin = F.when(F.col("run_end").isNotNull(), F.col("shard") * F.lit(shard_ms)).otherwise(F.col("lo"))
    stitched = shards.select(
        *keys,
        F.coalesce(run > F.col("shard"), F.lit(False)).alias("whole"),
        reach.alias("reach"),
        begin.alias("begin"),
        "gaps",
    )
    across = F.when(F.col("begin") > F.col("reach"), F.array(F.struct(F.col("reach").alias("a"), F.col("begin").alias("b"))))
    inside = F.when(~F.col("whole"), F.col("gaps"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return (
        stitched.select(*keys, F.explode(F.concat(F.coalesce(across, none), F.coalesce(inside, none))).alias("g"))
        .select(*keys, F.col("g.a").alias("gap_start_ms"), F.col("g.b").alias("gap_end_ms"))
    )


def sharded_last(
    points: DataFrame, probes: DataFrame, keys: Sequence[str], at: str, value: str, out: str, shard_ms: int = SHARD_MS
) -> DataFrame:
    """For each probe, ``value`` of the last point of its key with ``point.at <= probe.at`` (null if none).

    Points and probes meet inside time shards; what lies before a shard is carried by one row per shard.
    ``points`` hold one value per (keys, at).
    """
    keys = list(keys)
    shard = F.floor(F.col(at) / F.lit(shard_ms)).cast("long")
    pts = points.select(*keys, F.col(at).alias("_at"), F.col(value).alias("_v")).withColumn("_shard", F.floor(F.col("_at") / F.lit(shard_ms)).cast("long"))
    tagged = probes.withColumn("_shard", shard)
    summary = pts.groupBy(*keys, "_shard").agg(F.max_by("_v", "_at").alias("_v")).unionByName(
        tagged.select(*keys, "_shard").distinct().withColumn("_v", F.lit(None).cast(points.schema[value].dataType))
    ).groupBy(*keys, "_shard").agg(F.max("_v").alias("_v"))
    over = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, "_shard", F.last("_v", ignorenulls=True).over(over).alias("_carry"))
    both = tagged.withColumns({"_probe": F.lit(1), "_t": F.col(at), "_v": F.lit(None).cast(points.schema[value].dataType)}).unionByName(
        pts.withColumns({"_probe": F.lit(0)}).withColumnRenamed("_at", "_t"), allowMissingColumns=True
    )
    here = Window.partitionBy(*keys, "_shard").orderBy("_t", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_v", ignorenulls=True).over(here)).where(F.col("_probe") == 1)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_shard"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = found.alias("l").join(carried.alias("r"), cond, "left")
    return joined.select(*[F.col(f"l.{c}") for c in probes.columns], F.coalesce(F.col("l._here"), F.col("r._carry")).alias(out))


def covered_periods(
    intervals: DataFrame,
    keys: Sequence[str],
    ids: str,
    start: str = "start_ms",
    end: str = "end_ms",
    shard_ms: int = SHARD_MS,
) -> DataFrame:
    """Continuous covered periods with the ids of the intervals in each.

    ``ids`` is an array column. Result: (keys, period_start_ms, period_end_ms, part, ids). A period's ids
    come in parts, one per time shard in which intervals of the period begin, numbered by ``part``, so
    that no list grows without bound; ids are sorted and distinct within a part. Invalid rows (see
    ``interval_gaps``) belong to no period. Null id lists add no ids.
    """
    keys = list(keys)
    valid = intervals.where(F.col(end) > F.col(start)).select(*keys, F.col(ids).alias("_ids"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    gaps = interval_gaps(valid, keys, "_s", "_e", shard_ms)
    bounds = valid.groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_e").alias("_hi"))
    starts = gaps.select(*keys, F.col("gap_end_ms").alias("_at")).unionByName(bounds.select(*keys, F.col("_lo").alias("_at")))
    starts = starts.withColumn("_start", F.col("_at"))
    # A period's end is the next gap's start: the same search with time reversed.
    ends = gaps.select(*keys, F.col("gap_start_ms").alias("_at")).unionByName(bounds.select(*keys, F.col("_hi").alias("_at")))
    ends = ends.select(*keys, (-F.col("_at")).alias("_at"), F.col("_at").alias("_end"))
    # Parts first: one row per (key, shard, distinct start) is enough to find the period.
    grouped = valid.groupBy(*keys, F.col("_s").alias("_at")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col("_ids"), F.array().cast("array<string>")))))).alias("_ids")
    )
    placed = sharded_last(starts, grouped, keys, "_at", "_start", "period_start_ms", shard_ms)
    parts = placed.withColumn("_part", F.floor(F.col("_at") / F.lit(shard_ms)).cast("long")).groupBy(*keys, "period_start_ms", "_part").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias(ids)
    )
    probes = parts.withColumn("_at", -F.col("period_start_ms") - 1)
    closed = sharded_last(ends, probes, keys, "_at", "_end", "period_end_ms", shard_ms)
    first = F.floor(F.col("period_start_ms") / F.lit(shard_ms)).cast("long")
    return closed.select(*keys, "period_start_ms", "period_end_ms", (F.col("_part") - first).cast("int").alias("part"), ids)
