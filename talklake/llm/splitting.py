"""Splitting oversized items at natural boundaries by structure-tree packing (problem 2).

A text is parsed into a tree (sections under headings, paragraphs, lines or list items, sentences), an
episode into chapters, turns, stretches between pauses and segments. Siblings are merged from the bottom up as long as
they fit; only a node that is too large is entered. Consecutive pieces overlap by a fixed amount.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talklake.llm.sentences import sentence_units

TEXT_LIMIT, TEXT_OVERLAP = 1_200, 100
SEGMENT_LIMIT, SEGMENT_OVERLAP = 200, 5

_HEADING = re.compile(r"(?m)^(?=#{1,6}\s|={3,}|\d+(?:\.\d+)+\s)")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_BLANKS = re.compile(r"\s+")
_LINE = re.compile(r"\n\s*")


def pack(bounds: list[list[int]], start: int, end: int, budget: Callable[[int], int], level: int = 0) -> list[int]:
    """Cut positions of [start, end) (the last one is ``end``).

    ``bounds[level]`` are the sorted boundaries of a level, coarse levels first; a finer level holds those of
    the coarser ones. ``budget(at)`` is the room of a piece that begins at ``at``. Siblings are merged while
    they fit; a node that doesn't fit is packed by its children. What has no boundary is cut at the budget.
    """
    if end - start <= budget(start):
        return [end]
    if level == len(bounds):
        cuts, at = [], start
        while end - at > budget(at):
            at += budget(at)
            cuts.append(at)
        return [*cuts, end]
    marks = bounds[level]
    edges = [*marks[bisect_left(marks, start + 1) : bisect_left(marks, end)], end]
    cuts: list[int] = []
    begin = at = start
    for edge in edges:
        if edge - begin <= budget(begin):
            at = edge  # merged with its siblings
            continue
        if at > begin:
            cuts.append(at)
            begin = at
        if edge - begin <= budget(begin):
            at = edge
            continue
        inner = pack(bounds, begin, edge, budget, level + 1)
        cuts += inner[:-1]
        begin = cuts[-1] if cuts else begin
        at = edge
    return [*cuts, end]


def split_text(text: str | None, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, unbroken) of the pieces of a text; none for null or empty text, one if it fits.

    Pieces have at most ``limit`` code points, each begins ``overlap`` before the end of the one before it, and
    they end at natural boundaries (ends of sentences, line breaks) where there are any. A stretch without a
    boundary that fits the limit but not with the whole overlap stays whole, and its overlap is shorter. ``unbroken`` is 1 on the
    pieces of a stretch longer than the limit, which is cut at blanks, or failing that at any place.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text), 0)]
    sections = [m.start() for m in _HEADING.finditer(text) if m.start()]
    paragraphs = sorted({*sections, *(m.end() for m in _PARAGRAPH.finditer(text))})
    lines = sorted({*paragraphs, *(m.end() for m in _LINE.finditer(text))})
    units = sentence_units(text)
    natural = sorted({*lines, *(s for s, _ in units[1:]), len(text)})
    long: list[tuple[int, int]] = []
    at = 0
    for edge in natural:
        if len(text[at:edge].strip()) > limit:
            long.append((at, edge))
        at = edge
    words = sorted({*natural, *(m.end() for s, e in long for m in _BLANKS.finditer(text, s, e))})
    stretch_end = dict(long)

    def budget(begin: int) -> int:
        if not begin:
            return limit
        i = bisect_left(natural, begin + 1)
        whole = natural[i] - begin if i < len(natural) else 0
        return whole if limit - overlap < whole <= limit else limit - overlap

    cuts = pack([sections, paragraphs, lines, natural, words], 0, len(text), budget)
    out, begin = [], 0
    starts = sorted(stretch_end)
    for cut in cuts:
        i = bisect_left(starts, cut)
        unbroken = int(i > 0 and stretch_end[starts[i - 1]] > begin)
        out.append((max(0, begin - overlap, cut - limit) if begin else 0, cut, unbroken))
        begin = cut
    return out


def text_pieces(rows: DataFrame, keys: list[str], text: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> DataFrame:
    """(keys, piece, start_pos, end_pos, unbroken, text) of all rows whose text exceeds the limit.

    Only the keys and the text are read; short, empty and null texts are dropped before Python sees them.
    Repeated rows give repeated pieces.
    """
    large = rows.where(F.length(text) > limit).select(*keys, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in large.schema.fields[:-1])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                t = row[-1]
                out += [(*row[:-1], n, s, e, u, t[s:e]) for n, (s, e, u) in enumerate(split_text(t, limit, overlap))]
            yield pd.DataFrame(out, columns=[*b.columns[:-1], "piece", "start_pos", "end_pos", "unbroken", "text"])

    return large.mapInPandas(cut, f"{schema}, piece int, start_pos int, end_pos int, unbroken int, text string")


#: Segments of an episode that are packed together; a multiple of the limit, however long the episode is.
BLOCK = 4_000


def sequence_pieces(
    rows: DataFrame, key: str, limit: int = SEGMENT_LIMIT, overlap: int = SEGMENT_OVERLAP, block: int = BLOCK
) -> DataFrame:
    """Pieces of sequences with more than ``limit`` members: (key, piece_start, piece_end, segment_count, first_id, last_id).

    ``rows`` has (key, id, idx, strength), one row per member; ``strength`` is the level of the boundary before
    it (3 chapter, 2 turn, 1 pause, 0 none). Positions count members from 0 in order of (idx, id), null idx last;
    ``piece_end`` is exclusive and ``piece_start`` includes the overlap; first_id and last_id are those of the
    piece's own members. No step holds a whole sequence: ranks come from counts per stretch of idx, and
    sequences are packed in blocks that end at the strongest boundary near a multiple of ``block``.
    """
    shard = F.floor(F.coalesce(F.col("idx"), F.lit(2**31 - 1)) / F.lit(block)).cast("long")
    sharded = rows.select(F.col(key).alias("_k"), "id", "idx", "strength", shard.alias("_s"))
    counts = sharded.groupBy("_k", "_s").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_k").orderBy("_s")
    ahead = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy("_k"))
    offsets = counts.select("_k", "_s", ahead.alias("_ahead"), total.alias("_total")).where(F.col("_total") > limit).drop("_total")
    local = F.row_number().over(Window.partitionBy("_k", "_s").orderBy(F.col("idx").asc_nulls_last(), "id"))
    ranked = sharded.join(offsets, ["_k", "_s"]).select("_k", "id", "strength", (F.col("_ahead") + local - 1).alias("_r"))
    # A block ends before the strongest boundary among the last members before a multiple of the block size.
    ranked = ranked.withColumn("_b", F.floor(F.col("_r") / F.lit(block)).cast("long"))
    near = ranked.where((F.col("_r") % block >= block - limit + overlap) & (F.col("_r") > 0))
    ends = near.groupBy("_k", "_b").agg(F.max(F.struct("strength", "_r")).alias("_m")).select("_k", "_b", F.col("_m._r").alias("_cut"))
    placed = ranked.join(ends, ["_k", "_b"], "left").select(
        "_k", "id", "strength", "_r", F.when(F.col("_r") >= F.col("_cut"), F.col("_b") + 1).otherwise(F.col("_b")).alias("_b")
    )

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        ranks, ids, strengths = pdf["_r"].tolist(), pdf["id"].tolist(), pdf["strength"].tolist()
        first = ranks[0]
        bounds = [[r for r, s in zip(ranks, strengths, strict=True) if s >= level] for level in (3, 2, 1)]
        cuts = pack(bounds, first, ranks[-1] + 1, lambda at: limit - overlap if at else limit)
        out, begin = [], first
        for c in cuts:
            out.append((pdf["_k"].iloc[0], max(0, begin - overlap), c, c - max(0, begin - overlap), ids[begin - first], ids[c - 1 - first]))
            begin = c
        return pd.DataFrame(out, columns=["_k", "piece_start", "piece_end", "segment_count", "first_id", "last_id"])

    kind = rows.schema[key].dataType.simpleString()
    id_kind = rows.schema["id"].dataType.simpleString()
    schema = f"_k {kind}, piece_start long, piece_end long, segment_count int, first_id {id_kind}, last_id {id_kind}"
    return placed.groupBy("_k", "_b").applyInPandas(cut, schema).withColumnRenamed("_k", key)
