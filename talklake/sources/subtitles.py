"""Caption and transcript files (SRT, VTT, JSON) as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.functions.text import clock_seconds, collapse, strip, strip_tags, unescape_html, voice

_TIMING = r"^\s*([0-9:.,]+)\s+-->\s+([0-9:.,]+)(?:\s.*)?$"
_GOOD_CLOCK = r"^(?:\d+:)?[0-5]?\d:[0-5]\d[.,]\d{1,3}$"


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, raw) of every text file under a folder, without byte order mark, line ends as one sign."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), raw.alias("raw"))


def timed_blocks(docs: DataFrame) -> DataFrame:
    """(path, idx, start, end, speaker, text, problem) of the blocks of SRT or VTT files (path, raw).

    ``problem`` is null for a good cue, else no_timing, several_timings, timing_misplaced, bad_clock, empty_text or end_before_start. The WEBVTT head and
    NOTE, STYLE and REGION blocks are no cues. Empty files give no rows.
    """
    blocks = docs.select("path", F.posexplode(F.split("raw", r"\n[ \t]*\n")).alias("block", "body"))
    lines = F.filter(F.split("body", "\n"), lambda x: strip(x) != "")
    told = blocks.withColumn("lines", lines).where((F.size("lines") > 0) & ~F.col("lines")[0].rlike(r"^(WEBVTT|NOTE|STYLE|REGION)(\s|$)"))
    at = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(_TIMING), i)), lambda i: i.isNotNull())
    told = told.withColumn("at", at)
    first = F.try_element_at("at", F.lit(1))
    timing = F.try_element_at("lines", first + 1)
    told = told.withColumns({"a": F.regexp_extract(timing, _TIMING, 1), "b": F.regexp_extract(timing, _TIMING, 2), "n": first})
    body = F.array_join(F.slice("lines", F.coalesce(F.col("n"), F.lit(0)) + 2, F.size("lines")), "\n")
    told = told.withColumns({"who": strip(unescape_html(voice(body))), "text": collapse(unescape_html(strip_tags(body))), "start": clock_seconds("a"), "end": clock_seconds("b")})
    good = lambda c: F.col(c).rlike(_GOOD_CLOCK)
    problem = (
        F.when(F.size("at") == 0, "no_timing").when(F.size("at") > 1, "several_timings").when(F.col("n") > 1, "timing_misplaced").when(~(good("a") & good("b")), "bad_clock")
        .when(F.coalesce("text", F.lit("")) == "", "empty_text").when(F.col("end") < F.col("start"), "end_before_start")
    )
    idx = F.col("block").alias("idx")
    return told.select("path", idx, "start", "end", F.when(F.col("who") != "", F.col("who")).alias("speaker"), "text", problem.alias("problem"))


def preflight(rows: DataFrame) -> DataFrame:
    """(path, cues, bad, accepted) per file of timed_blocks: a file is accepted if it has cues and none is bad."""
    per = rows.groupBy("path").agg(F.count(F.lit(1)).alias("cues"), F.count("problem").alias("bad"))
    return per.withColumn("accepted", F.col("bad") == 0)


def _pick(keys: Column, row: str, names: list[str], kind: str) -> Column:
    """Value of the first key that is there, even if it is null."""
    out = F.lit(None).cast(kind)
    for n in reversed(names):
        out = F.when(F.array_contains(keys, n), F.try_variant_get(F.col(row), f"$.{n}", kind)).otherwise(out)
    return out


def json_rows(docs: DataFrame) -> DataFrame:
    """(path, idx, start, end, speaker, text, problem) of JSON transcripts (path, raw).

    A file is an array of rows or an object with ``segments`` or ``body``. The keys text/content, start/from, end/to and speaker_id/speaker stand
    for each other; which is there decides, not which is null. Files with repeated keys or without rows give one row with problem ``not_json`` or ``no_rows``.
    Rows whose text is blank are left out.
    """
    parsed = docs.withColumn("v", F.try_parse_json("raw"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.segments", "array<variant>"), F.try_variant_get("v", "$.body", "array<variant>"))
    told = parsed.withColumn("items", items)
    broken = told.where(F.col("v").isNull() | F.col("items").isNull()).select(
        "path", F.lit(0).alias("idx"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("speaker"),
        F.lit(None).cast("string").alias("text"), F.when(F.col("v").isNull(), "not_json").otherwise("no_rows").alias("problem"),
    )
    rows = told.where(F.col("items").isNotNull()).select("path", F.posexplode("items").alias("idx", "row"))
    rows = rows.withColumn("keys", F.coalesce(F.json_object_keys(F.to_json("row")), F.array().cast("array<string>")))
    out = rows.select(
        "path", "idx", _pick(F.col("keys"), "row", ["start", "from"], "double").alias("start"), _pick(F.col("keys"), "row", ["end", "to"], "double").alias("end"),
        _pick(F.col("keys"), "row", ["speaker_id", "speaker"], "string").alias("speaker"), _pick(F.col("keys"), "row", ["text", "content"], "string").alias("text"),
        F.array_contains(F.col("keys"), "text").alias("has"), F.array_contains(F.col("keys"), "content").alias("had"),
    )
    problem = F.when((F.col("has") | F.col("had")) & F.col("text").isNull(), "text_not_string").when(F.col("start").isNull() | F.col("end").isNull(), "bounds_missing")
    named = F.when(F.lower(strip("speaker")).isin("unknown", "none", "null", ""), F.lit(None)).otherwise(F.col("speaker"))
    kept = out.where(problem.isNotNull() | (strip(F.coalesce("text", F.lit(""))) != ""))
    return kept.select("path", "idx", "start", "end", named.alias("speaker"), strip("text").alias("text"), problem.alias("problem")).unionByName(broken)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all SRT, VTT and JSON files under a folder."""
    srt = timed_blocks(files(spark, path, "*.{srt,vtt,SRT,VTT}"))
    return srt.unionByName(json_rows(files(spark, path, "*.{json,JSON}")))


def strict_json(col: str | Column) -> Column:
    """Whether a text is JSON without repeated keys and without numbers that are not finite."""
    return F.try_parse_json(col).isNotNull()
