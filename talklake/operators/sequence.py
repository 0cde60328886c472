"""Ordered operators on sequences of any length: prefixes, neighbours, ranks, islands, next-fit pages.

A window over a whole key puts that key's rows into one task. Here the rows of a key are cut into shards of the order,
the window runs inside a shard, and what comes before a shard is carried by one row per shard.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard where sequences are cut by position.
SHARD_ROWS = 4_096


def idx_shard(idx: str = "idx", rows: int = SHARD_ROWS) -> Column:
    """Shard of a position column; rows without a position come last."""
    return F.floor(F.coalesce(F.col(idx).cast("long"), F.lit(2**53)) / F.lit(rows)).cast("long")


def _key_match(keys: Sequence[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def prefix(rows: DataFrame, keys: Sequence[str], shard: Column, order: Sequence[str | Column], outs: Mapping[str, tuple[str, str | Column]]) -> DataFrame:
    """``rows`` with columns computed from the rows before, in the order given within each key.

    ``outs`` maps a new name to (kind, column): ``lag`` the value of the row before; ``last`` the last value before that is not
    null; ``max`` the largest value before; ``sum`` the sum of the values before and of the row itself. A row with nothing
    before it gets null (the first sum is the row's own). ``shard`` must not decrease along ``order``, which must be total
    for a reproducible result. Null keys are a key of their own.
    """
    keys = list(keys)
    tagged = rows.withColumns({"_shard": shard} | {f"_in_{o}": F.col(c) if isinstance(c, str) else c for o, (_, c) in outs.items()})
    inside = Window.partitionBy(*keys, "_shard").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    through = inside.rowsBetween(Window.unboundedPreceding, 0)
    local, summary = {}, [F.max("_n").alias("_n")]
    for o, (kind, _) in outs.items():
        c = F.col(f"_in_{o}")
        local[f"_w_{o}"] = {"lag": lambda c=c: F.lag(c).over(inside), "last": lambda c=c: F.last(c, ignorenulls=True).over(before), "max": lambda c=c: F.max(c).over(before), "sum": lambda c=c: F.sum(c).over(through)}[kind]()
        summary.append(
            {"lag": lambda c=c, o=o: F.max_by(F.struct(c.alias("v")), "_n").alias(f"_s_{o}"), "last": lambda c=c, o=o: F.max_by(c, F.when(c.isNotNull(), F.col("_n"))).alias(f"_s_{o}"), "max": lambda c=c, o=o: F.max(c).alias(f"_s_{o}"), "sum": lambda c=c, o=o: F.sum(c).alias(f"_s_{o}")}[kind]()
        )
    numbered = tagged.withColumns({"_n": F.row_number().over(inside)} | local)
    per = numbered.groupBy(*keys, "_shard").agg(*summary)
    over = Window.partitionBy(*keys).orderBy("_shard")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(
        *keys,
        "_shard",
        *[
            {"lag": lambda o=o: F.lag(f"_s_{o}").over(over)["v"], "last": lambda o=o: F.last(f"_s_{o}", ignorenulls=True).over(past), "max": lambda o=o: F.max(f"_s_{o}").over(past), "sum": lambda o=o: F.sum(f"_s_{o}").over(past)}[kind]().alias(f"_c_{o}")
            for o, (kind, _) in outs.items()
        ],
    )
    met = numbered.alias("l").join(carried.alias("r"), _key_match([*keys, "_shard"], "l", "r"), "left")
    result = [F.col(f"l.{c}") for c in rows.columns]
    for o, (kind, _) in outs.items():
        w, c = F.col(f"l._w_{o}"), F.col(f"r._c_{o}")
        value = {
            "lag": F.when(F.col("l._n") == 1, c).otherwise(w),
            "last": F.coalesce(w, c),
            "max": F.greatest(w, c),
            "sum": F.coalesce(w, F.lit(0)) + F.coalesce(c, F.lit(0)),
        }[kind]
        result.append(value.alias(o))
    return met.select(*result)


def rank(rows: DataFrame, keys: Sequence[str], shard: Column, order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """``rows`` with their position from 0 within the key."""
    numbered = prefix(rows.withColumn("_one", F.lit(1).cast("long")), keys, shard, order, {out: ("sum", "_one")})
    return numbered.withColumn(out, F.col(out) - 1).drop("_one")


def islands(
    rows: DataFrame, keys: Sequence[str], start: str, end: str, shard: Column, order: Sequence[str | Column], touching: bool, out: str = "island"
) -> DataFrame:
    """``rows`` with the number (from 1) of the island of overlapping intervals that each belongs to.

    With ``touching`` intervals that only touch are one island, else a shared moment is needed. ``order`` must begin
    with ``start``.
    """
    seen = prefix(rows, keys, shard, order, {"_reach": ("max", end)})
    apart = F.col(start) > F.col("_reach") if touching else F.col(start) >= F.col("_reach")
    flagged = seen.withColumn("_new", F.when(F.col("_reach").isNull() | apart, 1).otherwise(0))
    return prefix(flagged, keys, shard, order, {out: ("sum", "_new")}).drop("_reach", "_new")


#: Rows of a shard of next_fit; each shard also sees ``max_rows`` rows of the next.
PAGE_SHARD = 65_536


def next_fit(
    rows: DataFrame, key: str, rank_col: str, size: str, max_size: int, max_rows: int, start: str | None = None, end: str | None = None, max_span: float | None = None, shard: int = PAGE_SHARD
) -> DataFrame:
    """(key, page, first_rank, last_rank, page_size): greedy pages of consecutive rows.

    A page takes rows while their sizes sum to at most ``max_size``, their number is at most ``max_rows`` and, if given, the
    last row's ``end`` is at most ``max_span`` after the first row's ``start``; it always takes one row. Where a page that
    begins at a row ends depends on at most ``max_rows`` rows after it, so that is found shard by shard; a shard
    then maps each possible entry to the entry of the next, and only these maps are followed in order. Null sizes count 0.
    """
    if shard < max_rows:
        raise ValueError("a shard must hold a page")
    span = start is not None and end is not None and max_span is not None
    cols = [F.col(key).alias("_k"), F.col(rank_col).cast("long").alias("_r"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_s")]
    cols += [F.col(start).cast("double").alias("_a"), F.col(end).cast("double").alias("_e")] if span else []
    base = rows.select(*cols).withColumn("_h", F.floor(F.col("_r") / shard).cast("long"))
    ahead = base.where((F.col("_r") % shard < max_rows) & (F.col("_h") > 0)).withColumn("_h", F.col("_h") - 1)
    shards = base.unionByName(ahead)

    def follow(pdf: pd.DataFrame) -> tuple[int, list[int], list[int]]:
        """First rank, and for each row of the shard the row where the next page begins."""
        pdf = pdf.sort_values("_r")
        ranks, sizes = pdf["_r"].tolist(), pdf["_s"].tolist()
        first, n = ranks[0], len(ranks)
        limit = (pdf["_h"].iloc[0] + 1) * shard - first
        a, e = (pdf["_a"].tolist(), pdf["_e"].tolist()) if span else ([], [])
        nxt, j, total = [], 0, 0
        for i in range(min(n, limit)):
            if span:
                j, total = i, 0
            elif j <= i:
                j, total = i, 0
            while j < n and (j == i or (j - i < max_rows and total + sizes[j] <= max_size and (not span or e[j] - a[i] <= max_span))):
                total += sizes[j]
                j += 1
            nxt.append(j)
            if not span:
                total -= sizes[i]
        return first, nxt, sizes

    kind = rows.schema[key].dataType.simpleString()

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        first, nxt, _ = follow(pdf)
        n = len(nxt)
        leave = [0] * n
        for i in range(n - 1, -1, -1):
            leave[i] = nxt[i] if nxt[i] >= n else leave[nxt[i]]
        entries = range(min(n, max_rows)) if first else range(1)
        return pd.DataFrame({"_k": pdf["_k"].iloc[0], "_h": pdf["_h"].iloc[0], "entry": [first + i for i in entries], "leave": [first + leave[i] for i in entries]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        to = dict(zip(pdf["entry"], pdf["leave"], strict=True))
        at, seen = 0, []
        while at in to:
            seen.append((pdf["_k"].iloc[0], at // shard, at))
            at = to[at]
        return pd.DataFrame(seen, columns=["_k", "_h", "entry"])

    ways = shards.groupBy("_k", "_h").applyInPandas(maps, f"_k {kind}, _h long, entry long, leave long")
    entered = ways.groupBy("_k").applyInPandas(chain, f"_k {kind}, _h long, entry long")

    def pages(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["_k", "first_rank", "last_rank", "page_size"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=names)
        first, nxt, sizes = follow(left)
        at, out = int(right["entry"].iloc[0]) - first, []
        while at < len(nxt):
            out.append((left["_k"].iloc[0], first + at, first + nxt[at] - 1, sum(sizes[at : nxt[at]])))
            at = nxt[at]
        return pd.DataFrame(out, columns=names)

    cut = shards.groupBy("_k", "_h").cogroup(entered.groupBy("_k", "_h")).applyInPandas(pages, f"_k {kind}, first_rank long, last_rank long, page_size long")
    numbered = rank(cut, ["_k"], F.floor(F.col("first_rank") / shard).cast("long"), ["first_rank"], "page")
    return numbered.select(F.col("_k").alias(key), "page", "first_rank", "last_rank", "page_size")
