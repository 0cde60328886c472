"""Text functions over documents, tracks, episodes and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.functions import text as T
from talklake.plans.base import CUES, cues
from talklake.runtime import table


def comparison_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose edited text reads otherwise than the raw text, apart from format."""
    s = table(spark, sf_dir, "segments").select("episode_id", "id", T.comparison_text("raw_text").alias("raw"), T.comparison_text("text").alias("edited")).distinct()
    return s.where(~F.col("raw").eqNullSafe(F.col("edited"))).select("episode_id", "id", F.length("raw").cast("long").alias("raw_chars"), F.length("edited").cast("long").alias("edited_chars"))


def repeated_text_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, characters of texts of at least 12 that repeat an earlier one, against all characters."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("source", "text")
    per = d.groupBy("source", F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    again = F.when(F.col("n") >= 12, (F.col("c") - 1) * F.col("n")).otherwise(0)
    return per.groupBy("source").agg(F.sum(again).cast("long").alias("repeated"), F.sum(F.col("c") * F.col("n")).cast("long").alias("characters"))


def script_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han and Latin letters of every document against all letters and digits."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    count = lambda p: F.length(F.regexp_replace("text", p, "")).cast("long")
    return d.select("doc_id", count(r"[^\x{3400}-\x{9fff}]").alias("han"), count(r"[^A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]").alias("latin"), count(r"[^\p{L}\p{N}]").alias("letters"))


def language_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per short language name."""
    d = table(spark, sf_dir, "documents").select(T.language("lang").alias("language"))
    return d.groupBy("language").agg(F.count(F.lit(1)).alias("documents"))


def clock_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both clock forms of every chapter's start."""
    c = table(spark, sf_dir, "chapters").select("episode_id", "id", "start").distinct()
    return c.select("episode_id", "id", T.clock("start").alias("long_form"), T.short_clock("start").alias("short_form"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of episodes and their references, and whether they pass the plain and the strict rule."""
    e = table(spark, sf_dir, "episodes")
    own = e.select("id", F.col("source.url").alias("url"))
    refs = e.select("id", F.explode("references").alias("r")).select("id", F.col("r.url").alias("url"))
    u = own.unionByName(refs).where("url is not null").distinct()
    return u.select("id", "url", (T.safe_url("url") != "").alias("plain"), T.strict_url("url").alias("strict"))


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue texts with markup escaped, and stripped again."""
    c = cues(spark, sf_dir).select("doc_id", "id", "text")
    marked = F.concat(F.lit("<b>"), T.escape_html("text"), F.lit("</b>"))
    return c.select("doc_id", "id", T.unescape_html(T.strip_tags(marked)).alias("text"), F.length(T.escape_markdown("text")).cast("long").alias("markdown_chars"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of keys of every event's properties, and whether they are well formed."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return e.select("event_id", F.coalesce(F.size(F.json_object_keys("props")), F.lit(0)).cast("long").alias("keys"), F.try_parse_json("props").isNotNull().alias("well_formed"))


def sparse_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of at least 4 seconds with fewer than 2 letters and digits per second."""
    c = cues(spark, sf_dir).where("end_ms - start_ms >= 4000")
    n = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    return c.where(n * 1000 < 2 * (F.col("end_ms") - F.col("start_ms"))).select("doc_id", "id", n.cast("long").alias("letters"))


def part_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in parts of at most 4,096 bytes, with the digest of each part."""
    d = table(spark, sf_dir, "documents").where("text is not null and text <> ''").select("doc_id", F.encode("text", "utf-8").alias("b")).distinct()
    offs = F.explode(F.sequence(F.lit(0), F.octet_length("b") - 1, F.lit(4096))).alias("o")
    p = d.select("doc_id", "b", offs).select("doc_id", (F.col("o") / 4096).cast("int").alias("part"), F.substring("b", F.col("o") + 1, F.lit(4096)).alias("piece"))
    return p.select("doc_id", "part", F.octet_length("piece").cast("long").alias("bytes"), F.sha2("piece", 256).alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (comparison_texts, repeated_text_fraction, script_fraction, language_normalize, clock_format, url_rules, html_strip, json_props, sparse_cues, part_split)
}

_SEC = 'CASE WHEN "start" IS NOT NULL AND isfinite("start") AND "start" >= 0 THEN floor("start")::BIGINT ELSE 0 END'
ORACLE = {
    "repeated_text_fraction": """WITH a AS (SELECT source, length(text) AS n, count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY source, text)
SELECT source, sum(CASE WHEN n >= 12 THEN (c - 1) * n ELSE 0 END)::BIGINT AS repeated, sum(c * n)::BIGINT AS characters FROM a GROUP BY source""",
    "script_fraction": r"""SELECT doc_id, length(regexp_replace(text, '[^\x{3400}-\x{9fff}]', '', 'g')) AS han, length(regexp_replace(text, '[^A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]', '', 'g')) AS latin,
length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS letters FROM documents WHERE text IS NOT NULL""",
    "language_normalize": """WITH a AS (SELECT split_part(regexp_replace(replace(lower(lang), '_', '-'), '^ai-', ''), '-', 1) AS b FROM documents)
SELECT CASE WHEN b IN ('cmn', 'zho', 'chi') THEN 'zh' WHEN b = 'eng' THEN 'en' WHEN trim(b) = '' THEN NULL ELSE b END AS language, count(*) AS documents FROM a GROUP BY 1""",
    "clock_format": f"""WITH a AS (SELECT DISTINCT episode_id, id, {_SEC} AS s FROM chapters)
SELECT episode_id, id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS long_form,
CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS short_form FROM a""",
    "url_rules": r"""WITH a AS (SELECT id, source.url AS url FROM episodes UNION ALL SELECT id, r.url FROM (SELECT id, unnest("references") AS r FROM episodes)),
b AS (SELECT DISTINCT id, url FROM a WHERE url IS NOT NULL)
SELECT id, url, regexp_matches(url, '^\s*https?://[^/\s]+') AS plain, regexp_matches(url, '^https?://[^/@\s\\]+(/[^\s\\]*)?$') AS strict FROM b""",
    "html_strip": rf"""WITH {CUES} SELECT doc_id, id, text, length(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_\[\]#])', '\\\1', 'g')) AS markdown_chars FROM cu""",
    "json_props": "SELECT event_id, coalesce(len(json_keys(props)), 0)::BIGINT AS keys, json_valid(props) AS well_formed FROM events",
    "sparse_cues": rf"""WITH {CUES}, a AS (SELECT *, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS n FROM cu WHERE end_ms - start_ms >= 4000)
SELECT doc_id, id, n AS letters FROM a WHERE n * 1000 < 2 * (end_ms - start_ms)""",
}
