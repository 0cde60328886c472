"""Runs of equal neighbouring values in an ordered sequence, found shard by shard and stitched together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_runs(rows: DataFrame, keys: Sequence[str], shard: Column, order: Sequence[str | Column], value: str) -> DataFrame:
    """``rows`` with (run_shard, run_no): equal for the rows of one run, different for others of the key.

    Neighbours belong to one run if their ``value`` is equal and not null; a null value is a run of its own.
    ``shard`` must not decrease along ``order``. Runs are found inside a shard and joined over shard boundaries
    by one row per shard, so a key with very many rows is spread over its shards. A null key is a key of its own.
    """
    keys = list(keys)
    tagged = rows.withColumn("run_shard", shard)
    inside = Window.partitionBy(*keys, "run_shard").orderBy(*order)
    new = F.when(F.col(value) == F.lag(value).over(inside), 0).otherwise(1)
    numbered = tagged.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    ends = numbered.groupBy(*keys, "run_shard").agg(
        F.min_by(value, "run_no").alias("_first"), F.max_by(value, "run_no").alias("_last"), F.max("run_no").alias("_n")
    )
    over = Window.partitionBy(*keys).orderBy("run_shard")
    ends = ends.withColumn("_joins", F.coalesce(F.col("_first") == F.lag("_last").over(over), F.lit(False)))
    own = (F.col("_n") > 1) | ~F.col("_joins")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    stitch = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("run_shard").alias("_shard"),
        "_joins",
        F.last(F.when(own, F.col("run_shard")), ignorenulls=True).over(before).alias("_head"),
        F.last(F.when(own, F.col("_n")), ignorenulls=True).over(before).alias("_head_no"),
    ).where("_joins")
    same = F.col("run_shard") == F.col("_shard")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = numbered.join(stitch, same, "left")
    moved = F.coalesce(F.col("_joins") & (F.col("run_no") == 1), F.lit(False))
    return joined.select(
        *rows.columns,
        F.when(moved, F.col("_head")).otherwise(F.col("run_shard")).alias("run_shard"),
        F.when(moved, F.col("_head_no")).otherwise(F.col("run_no")).alias("run_no"),
    )
