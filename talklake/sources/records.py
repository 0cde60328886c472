"""Other landed inputs: OCR tables, decoder logs, forms, stored records in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.functions.text import strip

PART_BYTES = 4_194_304


def ocr_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text, confidence, low) from OCR tables in TSV: words joined by line, confidence weighted by length.

    Only word rows (level 5) with text and a score of 0 or more count; quotes are literal. ``low`` marks lines with a word under 35.
    """
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
    t = spark.read.option("sep", "\t").option("quote", "").option("header", "true").schema(schema).csv(path).select("*", F.col("_metadata.file_path").alias("path"))
    w = t.where((F.col("level") == 5) & (F.col("conf") >= 0) & (strip(F.coalesce("text", F.lit(""))) != ""))
    n = F.length("text")
    return w.groupBy("path", "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.round(F.sum(F.col("conf") * n) / F.sum(n), 2).alias("confidence"), F.bool_or(F.col("conf") < 35).alias("low"),
    ).select("path", F.struct("block_num", "par_num", "line_num").alias("line"), "text", "confidence", "low")


def silences(logs: DataFrame) -> DataFrame:
    """(path, start, end) of the pauses that a decoder log (path, raw) reports; a pause without an end is left out."""
    starts = F.regexp_extract_all("raw", F.lit(r"silence_start:\s*(-?[0-9.]+)"), F.lit(1))
    ends = F.regexp_extract_all("raw", F.lit(r"silence_end:\s*([0-9.]+)"), F.lit(1))
    pairs = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    return logs.select("path", F.explode(pairs).alias("p")).select("path", F.greatest(F.expr("try_cast(p.a as double)"), F.lit(0.0)).alias("start"), F.expr("try_cast(p.b as double)").alias("end"))


def duration(logs: DataFrame) -> DataFrame:
    """(path, seconds) from the decoder log's length; null if it has none."""
    m = lambda i: F.regexp_extract("raw", r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", i)
    return logs.select("path", F.when(m(1) != "", m(1).cast("double") * 3600 + m(2).cast("double") * 60 + m(3).cast("double")).alias("seconds"))


def form_fields(bodies: DataFrame, allowed: list[str]) -> DataFrame:
    """(id, fields, accepted) of forms (id, body) with ``### Name`` sections: accepted if the names are exactly the allowed ones, each once."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.regexp_replace("body", "\r\n?", "\n")), r"\n### "), 2, 1000)
    names = F.transform(parts, lambda p: strip(F.substring_index(p, "\n", 1)))
    values = F.transform(parts, lambda p: strip(F.when(F.contains(p, F.lit("\n")), F.substring(p, F.instr(p, "\n") + 1, 1_000_000_000)).otherwise("")))
    told = bodies.select("id", names.alias("n"), values.alias("v"))
    good = (F.size("n") == len(allowed)) & (F.array_sort("n") == F.array(*[F.lit(x) for x in sorted(allowed)]))
    return told.select("id", F.when(F.size(F.array_distinct("n")) == F.size("n"), F.map_from_arrays("n", "v")).alias("fields"), F.coalesce(good, F.lit(False)).alias("accepted"))


def to_parts(records: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, part, parts, byte_length, sha256, part_sha256, content) of records (id, content binary). An empty record is one empty part."""
    n = F.greatest(F.ceil(F.octet_length("content") / F.lit(part_bytes)).cast("int"), F.lit(1))
    told = records.select("id", "content", n.alias("parts"), F.octet_length("content").alias("byte_length"), F.sha2("content", 256).alias("sha256"))
    cut = told.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    piece = F.substring("content", F.col("part") * part_bytes + 1, F.lit(part_bytes))
    return cut.select("id", "part", "parts", "byte_length", "sha256", F.sha2(piece, 256).alias("part_sha256"), piece.alias("content"))


def from_parts(parts: DataFrame, max_parts: int = 256) -> DataFrame:
    """(id, content, problem) joined from to_parts rows; problem names what does not agree (missing_part, part_digest, length, digest, too_many)."""
    per = parts.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("part", "content"))).alias("p"), F.max("parts").alias("parts"), F.max("byte_length").alias("byte_length"), F.max("sha256").alias("sha256"),
        F.bool_and(F.sha2("content", 256) == F.col("part_sha256")).alias("ok"),
    )
    whole = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["content"]))
    told = per.withColumn("content", whole)
    numbered = F.transform("p", lambda x: x["part"]) == F.sequence(F.lit(0), F.col("parts") - 1)
    problem = (
        F.when(F.col("parts") > max_parts, "too_many").when(~numbered, "missing_part").when(~F.col("ok"), "part_digest")
        .when(F.octet_length("content") != F.col("byte_length"), "length").when(F.sha2("content", 256) != F.col("sha256"), "digest")
    )
    return told.select("id", F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(number, raw, problem) of files named issue-N.json under a folder: not_named, not_json, or number_differs from provenance.issue."""
    f = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    n = F.expr(r"try_cast(regexp_extract(path, 'issue-([0-9]+)\\.json$', 1) as bigint)")
    told = f.withColumns({"number": n, "v": F.try_parse_json("raw")})
    inner = F.try_variant_get("v", "$.provenance.issue", "bigint")
    problem = F.when(F.col("number").isNull(), "not_named").when(F.col("v").isNull(), "not_json").when(~F.coalesce(inner == F.col("number"), F.lit(False)), "number_differs")
    return told.select("path", "number", "raw", problem.alias("problem"))
