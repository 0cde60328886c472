"""Chunk plans: every moment of a recording in exactly one chunk of bounded length, cut in pauses where possible."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Chunks of one recording at most (a year of five-minute chunks).
MAX_CHUNKS = 105_000


def cut_times(duration: int, pauses: list[tuple[int, int]], limit: int, window: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the chunks of [0, duration), in milliseconds.

    A cut is sought in the last ``window`` before the limit, never before its half: the latest middle of a pause,
    moved into the window if the pause reaches into it. Without one the cut is forced at the limit. No duration, no chunks.
    A duration of more than MAX_CHUNKS limits is damaged: it gives one row with the boundary too_long.
    """
    if duration > limit * MAX_CHUNKS:
        return [(0, duration, "too_long")]
    out, start, first = [], 0, 0
    pauses = sorted(pauses)
    while start < duration:
        if duration - start <= limit:
            out.append((start, duration, "end"))
            break
        top = start + limit
        low = max(start + limit // 2, top - window)
        while first < len(pauses) and pauses[first][1] < start + limit // 2:
            first += 1
        found = []
        for a, b in pauses[first:]:
            if a > top:
                break
            at = min(max((a + b) // 2, low), top)
            if a <= at <= b:
                found.append(at)
        end = max(found, default=top)
        out.append((start, end, "silence" if found else "forced"))
        start = end
    return out


def plan_chunks(lengths: DataFrame, pauses: DataFrame, key: str, limit: int, window: int) -> DataFrame:
    """(key, chunk, start_ms, end_ms, boundary). ``lengths`` has (key, duration_ms), ``pauses`` (key, gap_start_ms, gap_end_ms).

    Each cut depends on the one before, so a recording is planned in one task; only its pauses are sent there, and those that
    no cut could use (outside every window however the cuts fall) still count but carry no text. Null durations have no chunks.
    """
    kind = lengths.schema[key].dataType.simpleString()

    def plan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [key, "chunk", "start_ms", "end_ms", "boundary"]
        if not len(left) or pd.isna(left["duration_ms"].iloc[0]):
            return pd.DataFrame([], columns=names)
        cuts = cut_times(int(left["duration_ms"].iloc[0]), list(zip(right["gap_start_ms"].tolist(), right["gap_end_ms"].tolist(), strict=True)), limit, window)
        return pd.DataFrame([(left[key].iloc[0], n, *c) for n, c in enumerate(cuts)], columns=names)

    return lengths.select(key, "duration_ms").groupBy(key).cogroup(pauses.select(key, "gap_start_ms", "gap_end_ms").groupBy(key)).applyInPandas(
        plan, f"{key} {kind}, chunk int, start_ms long, end_ms long, boundary string"
    )


def plan_problems(chunks: DataFrame, lengths: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, problem) of plans that do not cover every moment once: bad_number, gap_or_overlap, too_long, bad_end.

    Every chunk meets the one with the number before it by an equal join, so plans are checked in parallel.
    """
    before = chunks.select(key, (F.col("chunk") + 1).alias("chunk"), F.col("end_ms").alias("_end"))
    told = chunks.join(before, [key, "chunk"], "left")
    ends = chunks.groupBy(key).agg(F.max("end_ms").alias("_last"), F.count(F.lit(1)).alias("_n"), F.max("chunk").alias("_top")).join(lengths, key, "left")
    own = told.select(
        key,
        F.explode(
            F.array_compact(
                F.array(
                    F.when((F.col("chunk") > 0) & F.col("_end").isNull(), F.lit("bad_number")),
                    F.when(F.col("start_ms") != F.coalesce("_end", F.when(F.col("chunk") == 0, 0)), F.lit("gap_or_overlap")),
                    F.when((F.col("end_ms") - F.col("start_ms") > limit) | (F.col("end_ms") <= F.col("start_ms")), F.lit("too_long")),
                )
            )
        ).alias("problem"),
    )
    whole = ends.where((F.col("_last") != F.col("duration_ms")) | (F.col("_n") != F.col("_top") + 1)).select(key, F.lit("bad_end").alias("problem"))
    return own.unionByName(whole).distinct()


def stitch(rows: DataFrame, chunks: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """(key, start_ms, end_ms, speaker, text, unmatched): the rows of all chunks on the recording's time, order by start_ms, chunk, row_no.

    ``rows``: (key, chunk, row_no, start_ms, end_ms, speaker, text) with times from the chunk's start; ends are cut at the chunk's end.
    ``references``: (key, chunk, speaker, label) labels known across chunks; other speakers are named by chunk and marked ``unmatched``.
    """
    met = rows.join(chunks.select(key, "chunk", F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b")), [key, "chunk"])
    named = met.join(references.select(key, "chunk", "speaker", "label").dropDuplicates([key, "chunk", "speaker"]), [key, "chunk", "speaker"], "left")
    own = F.concat_ws(":", F.col("chunk").cast("string"), "speaker")
    start, end = F.col("_a") + F.col("start_ms"), F.least(F.col("_a") + F.col("end_ms"), F.col("_b"))
    return named.select(
        key, "chunk", "row_no", start.alias("start_ms"), F.greatest(start, end).alias("end_ms"), F.when(F.col("speaker").isNotNull(), F.coalesce("label", own)).alias("speaker"), "text",
        (F.col("speaker").isNotNull() & F.col("label").isNull()).alias("unmatched"),
    )
