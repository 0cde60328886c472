"""Resolving names against a catalogue, and searching a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talklake.functions.text import name_key, slug

# The slot for what has no series, and the outcomes of resolving.
INBOX = "inbox"


def resolve(requests: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, series_id, outcome) for requests (key, want_id, want_title) against catalogue rows (id, title, aliases).

    Nothing asked gives the inbox. An id that is there wins unless the title belongs to another row; a title or alias that is there
    gives its row unless another id was asked for; an unknown id alone is an error; an unknown title makes a new id, which is an
    error if it is taken. Names are compared as name_key; a name that two rows share resolves to nothing (ambiguous).
    """
    names = catalog.select("id", F.explode(F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    by_name = names.select(name_key("n").alias("_name"), "id").distinct().groupBy("_name").agg(F.min("id").alias("_by_name"), F.count(F.lit(1)).alias("_owners"))
    ids = catalog.select(F.col("id").alias("_id")).distinct()
    asked = requests.withColumns({"_name": name_key("want_title"), "_new": slug("want_title")})
    met = asked.join(ids, F.col("want_id") == F.col("_id"), "left").join(by_name, "_name", "left").join(ids.select(F.col("_id").alias("_taken")), F.col("_new") == F.col("_taken"), "left")
    no_id, no_title = F.coalesce("want_id", F.lit("")) == "", F.coalesce("want_title", F.lit("")) == ""
    hit, named = F.col("_id").isNotNull(), F.col("_by_name").isNotNull()
    outcome = (
        F.when(no_id & no_title, "inbox")
        .when(hit & named & (F.col("_owners") == 1) & (F.col("_by_name") != F.col("_id")), "conflict")
        .when(hit, "by_id")
        .when(named & (F.col("_owners") > 1), "ambiguous")
        .when(named & ~no_id, "conflict")
        .when(named, "by_name")
        .when(~no_id & no_title, "unknown_id")
        .when(F.col("_taken").isNotNull(), "id_taken")
        .otherwise("new")
    )
    told = met.withColumn("outcome", outcome)
    series = (
        F.when(F.col("outcome") == "inbox", INBOX).when(F.col("outcome") == "by_id", F.col("_id")).when(F.col("outcome") == "by_name", F.col("_by_name"))
        .when(F.col("outcome") == "new", F.coalesce(F.when(~no_id, F.col("want_id")), F.col("_new")))
    )
    return told.select(key, series.alias("series_id"), "outcome")


def contains_all(text: Column, query: str) -> Column:
    """Whether a text holds every word of the query as a part, case aside; an empty query matches all."""
    low = F.lower(text)
    out = F.lit(True)
    for term in query.lower().split():
        out = out & F.coalesce(F.contains(low, F.lit(term)), F.lit(False))
    return out


def search_parts(parts: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Keys whose text, given in several parts, holds every word of the query in some part."""
    terms = query.lower().split()
    if not terms:
        return parts.select(key).distinct()
    low = F.lower(F.col(text))
    flags = [F.bool_or(F.coalesce(F.contains(low, F.lit(t)), F.lit(False))).alias(f"_t{i}") for i, t in enumerate(terms)]
    found = parts.groupBy(key).agg(*flags)
    for i in range(len(terms)):
        found = found.where(f"_t{i}")
    return found.select(key)


# Bounds of a catalogue.
MAX_ROWS, MAX_SOURCES = 5_000, 20


def catalog_problems(catalog: DataFrame, reserved: list[str]) -> DataFrame:
    """(id, problem) of catalogue rows (id, title, aliases, sources): id_invalid, id_repeated, title_blank, name_reserved, name_taken, sources_count.

    Names are compared as name_key over all rows; a name that one row has twice is also taken. Too many rows give one row with id null.
    """
    ident = F.coalesce(F.col("id").rlike("^[A-Za-z0-9_-]{1,100}$"), F.lit(False))
    size = F.coalesce(F.size("sources"), F.lit(0))
    own = catalog.select(
        "id",
        F.explode(F.array_compact(F.array(F.when(~ident, F.lit("id_invalid")), F.when(F.coalesce(name_key("title"), F.lit("")) == "", F.lit("title_blank")), F.when((size < 1) | (size > MAX_SOURCES), F.lit("sources_count"))))).alias("problem"),
    )
    twice = catalog.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("id_repeated").alias("problem"))
    names = catalog.select("id", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("id", name_key("n").alias("_name")).where("_name <> ''")
    shared = names.groupBy("_name").agg(F.count(F.lit(1)).alias("c"), F.collect_set("id").alias("ids")).where("c > 1").select(F.explode("ids").alias("id"), F.lit("name_taken").alias("problem"))
    kept = names.where(F.col("_name").isin([r.casefold() for r in reserved])).select("id", F.lit("name_reserved").alias("problem"))
    many = catalog.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_ROWS).select(F.lit(None).cast("string").alias("id"), F.lit("too_many_rows").alias("problem"))
    return own.unionByName(twice).unionByName(shared).unionByName(kept).unionByName(many).distinct()
