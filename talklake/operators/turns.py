"""Reading turns: neighbouring segments of one known speaker, with their text joined as a reader would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talklake.functions.text import strip
from talklake.operators.runs import mark_runs
from talklake.operators.sequence import idx_shard, prefix

ORDER = ("idx", "id")


def _order() -> list[Column]:
    return [F.col("idx").asc_nulls_last(), F.col("id")]


def reading_turns(segments: DataFrame, speakers: DataFrame, key: str = "episode_id") -> DataFrame:
    """``segments`` with the turn of each (run_shard, run_no).

    A speaker that is null or not among the key's speakers never shares a turn. Order is by idx, then id.
    """
    known = speakers.select(F.col(key).alias("_k"), F.col("id").alias("_who")).distinct()
    match = F.col(key).eqNullSafe(F.col("_k")) & (F.col("speaker_id") == F.col("_who"))
    return mark_runs(segments.join(known, match, "left").drop("_k"), [key], idx_shard(), _order(), "_who")


def join_prefix(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``rows`` with ``piece``: the stripped text with the blank, if any, that joins it to the text before.

    A blank goes between a Latin letter, digit or closing mark and a Latin letter or digit; other scripts join directly.
    Rows of blanks only give an empty piece and do not count as the text before. Rows need key, run_shard, run_no, idx and id.
    """
    clean = rows.withColumn("_t", strip(F.coalesce(F.col(text), F.lit(""))))
    told = prefix(clean, [key, "run_shard", "run_no"], idx_shard(), _order(), {"_left": ("last", F.when(F.col("_t") != "", F.col("_t")))})
    gap = F.col("_left").rlike(r"""[A-Za-z0-9.,!?;:)"']$""") & F.col("_t").rlike("^[A-Za-z0-9]")
    return told.withColumn("piece", F.concat(F.when(F.coalesce(gap, F.lit(False)), " ").otherwise(""), "_t")).drop("_t", "_left")


def turn_text(rows: DataFrame, key: str = "episode_id") -> DataFrame:
    """(key, first_idx, part, text): the joined text of every turn, in parts of one shard of positions each."""
    shard = idx_shard()
    parts = join_prefix(rows, key).groupBy(key, "run_shard", "run_no", shard.alias("_s")).agg(
        F.min("idx").alias("_i"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "id", "piece"))), lambda x: x["piece"]), "").alias("text")
    )
    first = rows.groupBy(key, "run_shard", "run_no").agg(F.min("idx").alias("first_idx"))
    return parts.join(first, [key, "run_shard", "run_no"]).select(key, "first_idx", (F.col("_s") - F.col("run_shard")).cast("int").alias("part"), "text")
