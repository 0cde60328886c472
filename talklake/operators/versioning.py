"""Patches, fingerprints, retention and reconciliation of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talklake.functions.text import fingerprint


def apply_patch(base: DataFrame, patch: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``base`` with the patched fields, and ``changed``.

    A patch row has ``has_<field>`` beside each field: only fields that are there replace, even by null. Patch rows without a
    base row are left out (see unknown_targets). Keys must be unique in the patch.
    """
    p = patch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f).alias(f"_p_{f}") for f in fields], *[F.coalesce(F.col(f"has_{f}"), F.lit(False)).alias(f"_h_{f}") for f in fields])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    met = base.join(p, cond, "left")
    has = {f: F.coalesce(F.col(f"_h_{f}"), F.lit(False)) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | (has[f] & ~F.col(f).eqNullSafe(F.col(f"_p_{f}")))
    new = {f: F.when(has[f], F.col(f"_p_{f}")).otherwise(F.col(f)) for f in fields}
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns], changed.alias("changed"))


def unknown_targets(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of patch rows that have no base row."""
    return patch.select(*keys).distinct().join(base.select(*keys), list(keys), "left_anti")


def with_fingerprint(rows: DataFrame, cols: Sequence[str], out: str = "digest") -> DataFrame:
    """``rows`` with the digest of the named columns, in that order."""
    return rows.withColumn(out, fingerprint(*cols))


def valid_receipts(rows: DataFrame, receipts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Receipts (keys, digest) whose row still has that digest."""
    return receipts.join(rows.select(*keys, "digest"), [*keys, "digest"], "left_semi")


def retain(rows: DataFrame, key: str, version: str, last: int, important: Column) -> DataFrame:
    """``rows`` with ``keep``: the first version of a key, its last ones and every important one.

    The first and the last are found by top-k aggregation, so no key is sorted as a whole.
    """
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    recent = rows.select(key, version).distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).select(key, version, F.lit(True).alias("_recent"))
    first = rows.groupBy(key).agg(F.min(version).alias(version)).withColumn("_first", F.lit(True))
    met = rows.join(recent, [key, version], "left").join(first, [key, version], "left")
    keep = F.coalesce("_first", "_recent", F.lit(False)) | F.coalesce(important, F.lit(False))
    return met.select(*rows.columns, keep.alias("keep"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, state) of two copies with a digest: same, differs, left_only or right_only."""
    l = left.select(*keys, F.col("digest").alias("_l"))  # noqa: E741
    r = right.select(*keys, F.col("digest").alias("_r"))
    state = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("_l") == F.col("_r"), "same").otherwise("differs")
    return l.join(r, list(keys), "full").select(*keys, state.alias("state"))


def evictable(media: DataFrame, owners: DataFrame, cutoff: Column) -> DataFrame:
    """(path, reason): what may go (expired, unowned) or why it stays (removed, external, pinned, undelivered, recent).

    ``media`` has (path, last_used, removed, external_input), ``owners`` (path, owner, pinned, delivered).
    """
    per = owners.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("pinned").alias("_pinned"), F.bool_or(~F.col("delivered")).alias("_waiting"))
    told = media.join(per, "path", "left")
    reason = (
        F.when(F.col("removed"), "removed").when(F.col("external_input"), "external").when(F.col("_pinned"), "pinned").when(F.col("_waiting"), "undelivered")
        .when(F.col("last_used") > cutoff, "recent").when(F.col("_n").isNull(), "unowned").otherwise("expired")
    )
    return told.select("path", reason.alias("reason"))


def compare_versions(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, changed): the names of the fields that differ between two versions of a row; added and removed rows name themselves so."""
    l = before.select(*keys, F.struct(*fields).alias("_l"))  # noqa: E741
    r = after.select(*keys, F.struct(*fields).alias("_r"))
    met = l.join(r, list(keys), "full")
    names = F.array_compact(F.array(*[F.when(~F.col(f"_l.{f}").eqNullSafe(F.col(f"_r.{f}")), F.lit(f)) for f in fields]))
    changed = F.when(F.col("_l").isNull(), F.array(F.lit("added"))).when(F.col("_r").isNull(), F.array(F.lit("removed"))).otherwise(names)
    return met.select(*keys, changed.alias("changed")).where(F.size("changed") > 0)
