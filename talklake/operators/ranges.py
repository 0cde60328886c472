"""Joins of intervals by overlap, with the kind of overlap always named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bucket length in seconds. Rows that span more than WIDE buckets are matched at a coarser level.
BUCKET = 32.0
WIDE = 8


def overlaps(mode: str, a_start: Column, a_end: Column, b_start: Column, b_end: Column, tolerance: float = 0.0) -> Column:
    """``tolerant``: within ``tolerance``, bounds included; ``strict``: a shared stretch; ``touching``: bounds included."""
    if mode == "tolerant":
        return (a_start <= b_end + tolerance) & (b_start <= a_end + tolerance)
    if mode == "strict":
        return (a_start < b_end) & (a_end > b_start)
    if mode == "touching":
        return (a_start <= b_end) & (b_start <= a_end)
    raise ValueError(mode)


def _level(start: Column, end: Column, pad: float) -> Column:
    """The finest level at which an interval spans at most WIDE + 1 buckets."""
    return F.ceil(F.log2(F.greatest((end - start + 2 * pad) / F.lit(BUCKET * WIDE), F.lit(1.0)))).cast("int")


def _cells(start: Column, end: Column, own: Column, others: list[int], pad: float) -> Column:
    """(level, bucket) cells of an interval at its own level and at the coarser ones of the other side."""

    def at(level: Column) -> Column:
        width = F.lit(BUCKET) * F.pow(F.lit(2.0), level)
        return F.transform(F.sequence(F.floor((start - pad) / width).cast("long"), F.floor((end + pad) / width).cast("long")), lambda b: F.struct(level.alias("level"), b.alias("bucket")))

    coarser = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > own)
    return F.flatten(F.transform(F.concat(F.array(own), coarser), at))


def overlap_join(left: DataFrame, right: DataFrame, key: str, mode: str, tolerance: float = 0.0, how: str = "inner") -> DataFrame:
    """Pairs of rows of one key whose intervals overlap. Both sides have (key, start, end) and own names for the rest.

    Every interval lies in a few cells of its own length class and of the longer classes that the other side has; a pair meets in a cell
    of the longer one's class. A key with very many rows is spread over its cells, and long intervals cost as many cells as short
    ones. ``how`` is inner (right's start and end are dropped, each pair comes once), left_semi or left_anti. Rows with a null or not finite
    bound (or one beyond 1e15 seconds), an end before the start or a null key meet nothing.
    """
    ok = lambda: F.col("start").isNotNull() & F.col("end").isNotNull() & (F.abs(F.col("start")) < 1e15) & (F.abs(F.col("end")) < 1e15) & (F.col("end") >= F.col("start"))
    pad = tolerance if mode == "tolerant" else 0.0
    good = ok() & F.col(key).isNotNull()
    r = right.where(good).select(F.col(key).alias("_rk"), F.col("start").alias("_rs"), F.col("end").alias("_re"), *[c for c in right.columns if c not in (key, "start", "end")])
    r = r.withColumn("_rl", _level(F.col("_rs"), F.col("_re"), pad))
    # Whether a row meets any depends on its key and bounds only, so those stand for it.
    probe = left if how == "inner" else left.select(key, "start", "end").distinct()
    lx = probe.where(good).withColumn("_ll", _level(F.col("start"), F.col("end"), pad))
    classes = lambda df, c: sorted(x[0] for x in df.select(c).distinct().collect())  # noqa: E731  # at most 50 length classes
    lc, rc = classes(lx, "_ll"), classes(r, "_rl")
    lx = lx.withColumn("_look", F.explode(_cells(F.col("start"), F.col("end"), F.col("_ll"), rc, pad)))
    r = r.withColumn("_cell", F.explode(_cells(F.col("_rs"), F.col("_re"), F.col("_rl"), lc, pad)))
    on = (F.col(key) == F.col("_rk")) & (F.col("_look.level") == F.col("_cell.level")) & (F.col("_look.bucket") == F.col("_cell.bucket"))
    cond = on & (F.col("_cell.level") == F.greatest("_ll", "_rl")) & overlaps(mode, F.col("start"), F.col("end"), F.col("_rs"), F.col("_re"), tolerance)
    if how == "inner":
        width = F.lit(BUCKET) * F.pow(F.lit(2.0), F.col("_cell.level"))
        # A pair may share several cells: it counts in the first that both lie in.
        own = F.col("_cell.bucket") == F.greatest(F.floor((F.col("start") - pad) / width), F.floor((F.col("_rs") - pad) / width)).cast("long")
        return lx.join(r, cond).where(own).drop("_look", "_cell", "_rk", "_rs", "_re", "_rl", "_ll")
    hit = lx.join(r, cond, "left_semi").select(key, "start", "end").distinct()
    return left.join(hit, [key, "start", "end"], how).select(*left.columns)
