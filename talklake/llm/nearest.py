"""Nearest-in-time pairing by expanding rings (problem 5).

Each ring has a radius. Time is cut twice into buckets of four radii, the second cut shifted by half a bucket, so that every
moment lies at least one radius inside a bucket of one of the two cuts. A left row looks into that bucket only: within
the radius the best of its rows is provably the nearest. Left rows that found nothing that near go on to a ring of twice the radius,
until it reaches the tolerance. The right side is reduced to one row per bucket before it is joined, so a left row meets one row per
ring: no pairs are emitted, and a key that holds most rows is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widths(first_ms: int, tolerance_ms: int) -> list[int]:
    """Ring radii: doubled from the first until the tolerance is reached (the last one equals it)."""
    out = [max(1, min(first_ms, tolerance_ms))]
    while out[-1] < tolerance_ms:
        out.append(min(out[-1] * 2, tolerance_ms))
    return out


def _cell(time: str, radius: int, shifted: int) -> Column:
    """Number of the bucket; those of the shifted cut are odd."""
    return (F.floor((F.col(time) + F.lit(2 * radius * shifted)) / F.lit(4 * radius)) * 2 + shifted).cast("long")


def _buckets(right: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """(keys, _rb, own): the candidates of every bucket of both cuts."""
    both = F.explode(F.array(_cell("_at", radius, 0), _cell("_at", radius, 1)))
    return right.select(*keys, both.alias("_rb"), F.struct("_at", "_value").alias("x")).groupBy(*keys, "_rb").agg(F.collect_list("x").alias("own"))


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ms: str,
    right_ms: str,
    right_value: Column,
    tolerance_ms: int,
    first_ms: int = 375,
    out: str = "nearest",
) -> DataFrame:
    """``left`` with ``out``: the right value whose time is nearest, or null if none is within the tolerance.

    At equal distance the earlier time wins, at equal times the smallest ``right_value`` (a struct that
    begins with what orders the rows; keep it and ``left`` narrow, both are shuffled). Rows whose time or
    key is null find nothing and stand for nothing. The left columns are kept as they are, whatever their names.
    """
    keys = list(keys)
    cols = left.columns
    r = right.where(F.col(right_ms).isNotNull())
    for k in keys:
        r = r.where(F.col(k).isNotNull())
    # One row per key and moment: more cannot be told apart by time.
    r = r.select(*keys, F.col(right_ms).alias("_at"), right_value.alias("_value"))
    r = r.groupBy(*keys, "_at").agg(F.min("_value").alias("_value"))
    row = F.struct(*[F.col(c) for c in cols])
    todo = left.select(row.alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_ms).alias("_t"))
    blind = F.col("_t").isNull()
    for i in range(len(keys)):
        blind = blind | F.col(f"_k{i}").isNull()
    value_type = r.schema["_value"].dataType
    done = [todo.where(blind).select("_row", F.lit(None).cast(value_type).alias(out))]
    todo = todo.where(~blind)
    rings = widths(first_ms, tolerance_ms)
    for n, radius in enumerate(rings):
        buckets = _buckets(r, keys, radius).select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_rb", "own")
        # The cut in which the row's moment lies in the middle half of its bucket.
        middle = F.pmod(F.col("_t"), F.lit(4 * radius)).between(radius, 3 * radius - 1)
        cell = F.when(middle, _cell("_t", radius, 0)).otherwise(_cell("_t", radius, 1))
        on = [F.col(f"_k{i}") == F.col(f"_r{i}") for i in range(len(keys))] + [F.col("_b") == F.col("_rb")]
        joined = todo.withColumn("_b", cell).join(buckets, on, "left")
        near = lambda c: F.struct(F.abs(c["_at"] - F.col("_t")).alias("d"), c["_at"].alias("_at"), c["_value"].alias("v"))
        ranked = joined.select("_row", *[f"_k{i}" for i in range(len(keys))], "_t", F.array_min(F.transform("own", near)).alias("best"))
        hit = F.coalesce(F.col("best.d") <= F.lit(radius), F.lit(False))
        if n == len(rings) - 1:
            done.append(ranked.select("_row", F.when(hit, F.col("best.v")).alias(out)))
        else:
            # Accepted and unresolved rows come from the same exchanges, which Spark reuses.
            done.append(ranked.where(hit).select("_row", F.col("best.v").alias(out)))
            todo = ranked.where(~hit).drop("best")
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.select("_row.*", out)
