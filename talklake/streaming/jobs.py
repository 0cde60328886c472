"""Structured Streaming forms: the recogniser's event stream and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

OUT = "stream_id string, attempt int, segments int, state string"
STATE = "seen map<string,string>, digest string, last double, segments int, state string"


def attempts_stream(events: DataFrame) -> DataFrame:
    """One row per attempt when it ends (complete, text_differs, id_repeated, not_in_order).

    ``events`` is a stream of (stream_id, attempt, seq, type, id, start, text). Rows arrive in order of seq within a batch group; a redelivered
    row (same id and text) is ignored. The state of an attempt holds the ids seen, a running digest of the text without blanks, and the last start.
    """

    import hashlib

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, parts, last, n, now = state.get if state.exists else ({}, "", float("-inf"), 0, "open")
        seen = dict(seen)
        ended = False
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples(index=False):
                if now == "ended":
                    continue
                if r.type == "transcript.text.segment":
                    bare = "".join((r.text or "").split())
                    mark = hashlib.md5(bare.encode()).hexdigest()
                    if r.id in seen:
                        now = now if seen[r.id] == mark else "id_repeated"
                        continue
                    if r.start < last and now == "open":
                        now = "not_in_order"
                    seen[r.id], last, n = mark, r.start, n + 1
                    parts += bare
                elif r.type == "transcript.text.done":
                    full = "".join((r.text or "").split())
                    result = now if now != "open" else "complete" if full == parts else "text_differs"
                    ended, now = True, "ended"
        state.update((seen if now != "ended" else {}, parts if now != "ended" else "", last, n, now))
        if ended:
            yield pd.DataFrame([(key[0], key[1], n, result)], columns=["stream_id", "attempt", "segments", "state"])

    cols = events.select("stream_id", "attempt", "seq", "type", "id", "start", "text")
    return cols.groupBy("stream_id", "attempt").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def sessions_stream(events: DataFrame, key: str, time: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream: (key, start, end, events). ``time`` is a timestamp; rows later than the watermark are left out."""
    s = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def deduplicated_stream(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Redelivered rows of a stream once, as long as they come within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
