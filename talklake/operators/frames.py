"""Text read from video frames: spans of equal text, and lines that never leave the picture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talklake.operators.sequence import idx_shard, prefix


def spans(frames: DataFrame, key: str, interval: float, slack: float = 1e-5) -> DataFrame:
    """(key, start, end, text, samples, confidence, low): neighbouring frames of equal text whose times follow each other by ``interval``.

    ``frames``: (key, frame_idx, time, text, confidence, low). Frames without text end a span and belong to none; a span ends one interval after its last frame.
    """
    order = ["frame_idx"]
    shard = idx_shard("frame_idx")
    told = prefix(frames, [key], shard, order, {"_t": ("lag", "time"), "_x": ("lag", "text")})
    same = F.coalesce((F.col("text") == F.col("_x")) & (F.abs(F.col("time") - F.col("_t") - interval) <= slack), F.lit(False))
    numbered = prefix(told.withColumn("_new", F.when(same, 0).otherwise(1)), [key], shard, order, {"_run": ("sum", "_new")})
    seen = numbered.where(F.coalesce("text", F.lit("")) != "")
    return seen.groupBy(key, "_run", "text").agg(
        F.min("time").alias("start"), (F.max("time") + interval).alias("end"), F.count(F.lit(1)).alias("samples"), F.round(F.avg("confidence"), 2).alias("confidence"), F.bool_or(F.coalesce("low", F.lit(False))).alias("low")
    ).drop("_run")


def without_static(frames: DataFrame, key: str, interval: float, seconds: float = 30.0, samples: int = 20) -> DataFrame:
    """``frames`` without the lines that stay through an unbroken run of at least ``samples`` frames and ``seconds``.

    A line counts once per frame. A line is taken out only of the frames of such a run. Frames keep their row even if no line is left.
    """
    lines = frames.select(key, "frame_idx", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line <> ''")
    told = prefix(lines, [key, "line"], idx_shard("frame_idx"), ["frame_idx"], {"_f": ("lag", "frame_idx")})
    apart = F.coalesce(F.col("frame_idx") != F.col("_f") + 1, F.lit(True)).cast("int")
    runs = prefix(told.withColumn("_new", apart), [key, "line"], idx_shard("frame_idx"), ["frame_idx"], {"_run": ("sum", "_new")})
    fixed = runs.groupBy(key, "line", "_run").agg(F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b")).where((F.col("n") >= samples) & (F.col("n") * interval >= seconds))
    held = runs.join(fixed.select(key, "line", "_run"), [key, "line", "_run"], "left_semi").groupBy(key, "frame_idx").agg(F.collect_set("line").alias("_static"))
    met = frames.join(held, [key, "frame_idx"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("_static"), x), F.lit(False))), "\n")
    return met.select(*[kept.alias("text") if c == "text" else F.col(c) for c in frames.columns])
