"""Search, catalogue, rollups, documents and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talklake.functions.text import clock, collapse, escape_markdown, language
from talklake.operators.catalog import contains_all, resolve, search_parts
from talklake.operators.sequence import idx_shard
from talklake.operators.turns import reading_turns, turn_text
from talklake.operators.versioning import apply_patch, evictable, reconcile, retain, valid_receipts, with_fingerprint
from talklake.plans.base import SEGMENTS, segments, tracks
from talklake.plans.turn_queries import TURN_TEXTS
from talklake.runtime import table


def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all words of a query."""
    return table(spark, sf_dir, "documents").where(contains_all(F.col("text"), "Reel  storm")).select("doc_id", "source")


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search text of every episode in parts: what describes it, then its segments by stretches of positions."""
    e = table(spark, sf_dir, "episodes").dropDuplicates(["id"])
    names = table(spark, sf_dir, "speakers").groupBy(F.col("episode_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), "\n").alias("names"))
    head = e.join(names, "id", "left").select(
        F.col("id").alias("episode_id"), F.lit(-1).cast("long").alias("part"), F.concat_ws("\n", "title", "description", F.col("series.title"), F.array_join("summary", "\n"), "names").alias("hay")
    )
    s = segments(spark, sf_dir).select("episode_id", "idx", "id", "text", idx_shard().alias("part"))
    body = s.groupBy("episode_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "id", "text"))), lambda x: x["text"]), "\n").alias("hay"))
    return head.unionByName(body)


def search_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes whose search text holds all words of a query."""
    return search_parts(search_index(spark, sf_dir), "episode_id", "hay", "tape NIGHT archivist")


def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most recent episodes by publication text."""
    e = table(spark, sf_dir, "episodes").select("id", "published_at").distinct()
    return e.orderBy(F.desc("published_at"), "id").limit(6)


def series_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes and whole minutes of every series, with its first title."""
    e = table(spark, sf_dir, "episodes").where("series.id is not null").dropDuplicates(["id"])
    ms = F.sum(F.coalesce(F.round(F.col("duration_seconds") * 1000).cast("long"), F.lit(0)))
    return e.groupBy(F.col("series.id").alias("series_id")).agg(F.count(F.lit(1)).alias("episodes"), F.ceil(ms / 60000).cast("long").alias("minutes"), F.min_by("series.title", "id").alias("title"))


def catalog_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as requests against a catalogue of regions, through ids, titles and aliases."""
    r = table(spark, sf_dir, "region")
    catalog = r.select(F.concat(F.lit("region-"), "r_regionkey").alias("id"), F.col("r_name").alias("title"), F.array(F.lower("r_name"), F.concat(F.lit("the "), "r_name")).alias("aliases"))
    n = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey") % 5
    asked = n.select(
        "n_nationkey",
        F.when(k.isin(0, 3), F.concat(F.lit("region-"), "r_regionkey")).when(k == 4, F.lit("region-99")).alias("want_id"),
        F.when(k == 1, F.concat(F.lit("  THE  "), "r_name")).when(k == 2, F.col("n_name")).when(k == 3, F.lit("Asia")).alias("want_title"),
    )
    return resolve(asked, catalog, "n_nationkey").select("n_nationkey", "outcome", F.when(F.col("outcome") != "new", F.col("series_id")).alias("series_id"))


def override_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region of every nation, overridden for some, else its own."""
    n = table(spark, sf_dir, "nation")
    overrides = n.where("n_nationkey % 4 = 0").select("n_nationkey", ((F.col("n_regionkey") + 1) % 5).alias("o"))
    r = table(spark, sf_dir, "region")
    met = n.join(overrides, "n_nationkey", "left").withColumn("r_regionkey", F.coalesce("o", "n_regionkey"))
    return met.join(r, "r_regionkey", "left").select("n_nationkey", F.coalesce("r_name", F.lit("none")).alias("region"), F.col("o").isNotNull().alias("overridden"))


def track_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tracks of every episode, at most four: Chinese first, then manual before unknown before automatic."""
    t = tracks(spark, sf_dir).where("episode_id is not null")
    origin = F.when(F.col("origin") == "manual", 0).when(F.col("origin") == "unknown", 1).otherwise(2)
    keyed = t.select("episode_id", F.struct(F.when(language("language") == "zh", 0).otherwise(1).alias("z"), origin.alias("o"), "doc_id").alias("k"))
    best = keyed.groupBy("episode_id").agg(F.slice(F.array_sort(F.collect_list("k")), 1, 4).alias("b"))  # a few tracks per episode
    return best.select("episode_id", F.posexplode("b").alias("place", "k")).select("episode_id", "place", F.col("k.doc_id").alias("doc_id"))


def library_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card of every episode that is no demonstration: short description and first summary."""
    e = table(spark, sf_dir, "episodes").where("not is_demo").dropDuplicates(["id"])
    return e.select("id", "title", F.left("description", F.lit(280)).alias("description"), F.left(F.try_element_at("summary", F.lit(1)), F.lit(280)).alias("summary"), F.col("series.id").alias("series_id"))


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode as lines of a Markdown document, with keys that order them: title, people, chapters, turns."""
    e = table(spark, sf_dir, "episodes").dropDuplicates(["id"])
    title = e.select(F.col("id").alias("episode_id"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("line_no"), F.lit(0).alias("part"), F.concat(F.lit("# "), escape_markdown(collapse("title"))).alias("line"))
    p = table(spark, sf_dir, "speakers").select("episode_id", "idx", "name", "role").distinct()
    people = p.select("episode_id", F.lit(1).alias("block"), F.col("idx").cast("long").alias("line_no"), F.lit(0).alias("part"), F.concat(F.lit("- "), escape_markdown("name"), F.when(F.col("role") != "", F.concat(F.lit(" · "), "role")).otherwise("")).alias("line"))
    c = table(spark, sf_dir, "chapters").select("episode_id", "idx", "title", "start").distinct()
    chapters = c.select("episode_id", F.lit(2).alias("block"), F.col("idx").cast("long").alias("line_no"), F.lit(0).alias("part"), F.concat(F.lit("- "), clock("start"), F.lit(" "), escape_markdown(collapse("title"))).alias("line"))
    s = segments(spark, sf_dir).select("episode_id", "idx", "id", "speaker_id", "text")
    t = turn_text(reading_turns(s, table(spark, sf_dir, "speakers")))
    turns = t.select("episode_id", F.lit(3).alias("block"), F.col("first_idx").cast("long").alias("line_no"), "part", escape_markdown("text").alias("line"))
    return title.unionByName(people).unionByName(chapters).unionByName(turns)


def retention_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of a customer: the first, the last ten and the urgent ones are kept."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return retain(o, "o_custkey", "o_orderkey", 10, F.col("o_orderpriority") == "1-URGENT").groupBy("o_custkey").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))


def copy_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of the orders, one with holes and changes, compared by digest."""
    o = with_fingerprint(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey", "o_orderpriority"])
    a = o.where("o_orderkey % 7 <> 0")
    b = o.where("o_orderkey % 5 <> 0").withColumn("digest", F.when(F.col("o_orderkey") % 11 == 0, F.lit("changed")).otherwise(F.col("digest")))
    return reconcile(a, b, ["o_orderkey"]).groupBy("state").agg(F.count(F.lit(1)).alias("orders"))


def patched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments after a patch that sets some texts, removes some speakers and leaves the rest."""
    s = segments(spark, sf_dir).select("episode_id", "id", "speaker_id", "text", "review_status")
    patch = s.where("review_status = 'needs_review'").select(
        "episode_id", "id", F.concat("text", F.lit(" (checked)")).alias("text"), F.lit(None).cast("string").alias("speaker_id"), F.lit(True).alias("has_text"), (F.length("text") % 2 == 0).alias("has_speaker_id")
    )
    done = apply_patch(s, patch, ["episode_id", "id"], ["text", "speaker_id"])
    return done.select("episode_id", "id", "speaker_id", F.md5("text").alias("text_md5"), F.when(F.col("changed"), "edited").otherwise(F.col("review_status")).alias("review_status"), "changed")


def fingerprint_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of documents that still hold after some texts have changed."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    receipts = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("digest")).alias("digest"))
    return valid_receipts(d, receipts, ["doc_id"])


def stale_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of an earlier build that the present one no longer makes."""
    e = table(spark, sf_dir, "episodes")
    before = e.select(F.concat(F.lit("episodes/"), "id", F.lit(".json")).alias("path"))
    now = e.where("status = 'published'").select(F.concat(F.lit("episodes/"), "id", F.lit(".json")).alias("path"))
    return before.subtract(now)


def media_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as media files: what may be removed and why the rest stays."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    media = e.select(F.col("event_id").alias("path"), F.col("us").alias("last_used"), (F.col("event_id") % 17 == 0).alias("removed"), (F.col("event_id") % 13 == 0).alias("external_input"))
    owners = e.where("event_type <> 'view'").select(F.col("event_id").alias("path"), F.col("user_id").alias("owner"), (F.col("event_type") == "error").alias("pinned"), (F.col("event_id") % 2 == 0).alias("delivered"))
    cutoff = e.agg(((F.max("us") + F.min("us")) / 2).cast("long").alias("cutoff"))
    told = media.crossJoin(F.broadcast(cutoff))  # one row
    return evictable(told, owners, F.col("cutoff")).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


def classify_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with the reference tagged as series replaced by the present series, and whether that changes anything."""
    e = table(spark, sf_dir, "episodes").dropDuplicates(["id"]).select("id", "series", "references")
    kept = F.filter(F.coalesce("references", F.array().cast("array<struct<title:string,url:string,note:string>>")), lambda r: ~F.coalesce(r["note"] == "series", F.lit(False)))
    own = F.when(F.col("series.id").isNotNull(), F.array(F.struct(F.col("series.title").alias("title"), F.lit("").alias("url"), F.lit("series").alias("note"))))
    new = F.concat(kept, F.coalesce(own, F.array().cast("array<struct<title:string,url:string,note:string>>")))
    return e.select("id", F.size(new).cast("long").alias("references_after"), (~new.eqNullSafe(F.col("references"))).alias("changed"))


QUERIES = {
    f.__name__: f
    for f in (
        search_and, search_index, search_episodes, recent_topk, series_rollup, catalog_resolve, override_join, track_preference, library_cards, markdown_lines,
        retention_policy, copy_reconcile, patched_segments, fingerprint_receipts, stale_outputs, media_eviction, classify_references,
    )
}

_ESC = r"regexp_replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_\[\]#])', '\\\1', 'g')"
_HAY = """hd AS (SELECT e.id AS episode_id, -1::BIGINT AS part, concat_ws(chr(10), title, description, series.title, array_to_string(summary, chr(10)), n.names) AS hay
 FROM (SELECT DISTINCT ON (id) * FROM episodes) e LEFT JOIN (SELECT episode_id, string_agg(DISTINCT name, chr(10) ORDER BY name) AS names FROM speakers GROUP BY episode_id) n ON n.episode_id = e.id),
hay AS (SELECT * FROM hd UNION ALL SELECT episode_id, idx // 4096, string_agg(text, chr(10) ORDER BY idx, id) FROM sg GROUP BY episode_id, idx // 4096)"""
ORACLE = {
    "search_and": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'reel') AND contains(lower(text), 'storm')",
    "search_index": f"WITH {SEGMENTS}, {_HAY} SELECT episode_id, part, hay FROM hay",
    "search_episodes": f"""WITH {SEGMENTS}, {_HAY} SELECT episode_id FROM hay GROUP BY episode_id HAVING bool_or(contains(lower(hay), 'tape')) AND bool_or(contains(lower(hay), 'night')) AND bool_or(contains(lower(hay), 'archivist'))""",
    "recent_topk": "SELECT DISTINCT id, published_at FROM episodes ORDER BY published_at DESC NULLS LAST, id LIMIT 6",
    "series_rollup": """WITH e AS (SELECT DISTINCT ON (id) * FROM episodes WHERE series.id IS NOT NULL)
SELECT series.id AS series_id, count(*) AS episodes, ceil(sum(coalesce(round(duration_seconds * 1000)::BIGINT, 0)) / 60000.0)::BIGINT AS minutes, arg_min(series.title, id) AS title FROM e GROUP BY series.id""",
    "override_join": """SELECT n.n_nationkey, coalesce(r_name, 'none') AS region, n.n_nationkey % 4 = 0 AS overridden FROM nation n
LEFT JOIN region ON r_regionkey = CASE WHEN n.n_nationkey % 4 = 0 THEN (n.n_regionkey + 1) % 5 ELSE n.n_regionkey END""",
    "catalog_resolve": """WITH q AS (SELECT n_nationkey, n_nationkey % 5 AS k, n_name, r_regionkey, r_name, 'region-' || r_regionkey AS rid FROM nation JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT *, (SELECT 'region-' || r_regionkey FROM region WHERE lower(r_name) = lower(q.n_name)) AS own, (SELECT 'region-' || r_regionkey FROM region WHERE lower(r_name) = 'asia') AS asia FROM q)
SELECT n_nationkey, CASE k WHEN 0 THEN 'by_id' WHEN 1 THEN 'by_name' WHEN 2 THEN CASE WHEN own IS NULL THEN 'new' ELSE 'by_name' END WHEN 3 THEN CASE WHEN rid = asia THEN 'by_id' ELSE 'conflict' END ELSE 'unknown_id' END AS outcome,
CASE k WHEN 0 THEN rid WHEN 1 THEN rid WHEN 2 THEN own WHEN 3 THEN CASE WHEN rid = asia THEN rid END END AS series_id FROM a""",
    "track_preference": """WITH a AS (SELECT episode_id, doc_id, split_part(regexp_replace(replace(lower(language), '_', '-'), '^ai-', ''), '-', 1) AS l, origin FROM subtitle_docs WHERE episode_id IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY CASE WHEN l IN ('zh', 'cmn', 'zho', 'chi') THEN 0 ELSE 1 END, CASE origin WHEN 'manual' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, doc_id) - 1 AS place FROM a)
SELECT episode_id, place::INTEGER AS place, doc_id FROM b WHERE place < 4""",
    "library_cards": """SELECT id, title, left(description, 280) AS description, left(summary[1], 280) AS summary, series.id AS series_id FROM (SELECT DISTINCT ON (id) * FROM episodes WHERE NOT is_demo)""",
    "retention_policy": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS l FROM orders)
SELECT o_custkey, count(*) FILTER (f = 1 OR l <= 10 OR o_orderpriority = '1-URGENT') AS kept, count(*) FILTER (NOT (f = 1 OR l <= 10 OR o_orderpriority = '1-URGENT')) AS dropped FROM a GROUP BY o_custkey""",
    "copy_reconcile": """SELECT CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'differs' ELSE 'same' END WHEN o_orderkey % 7 <> 0 THEN 'left_only' ELSE 'right_only' END AS state,
count(*) AS orders FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 <> 0 GROUP BY 1""",
    "patched_segments": f"""WITH {SEGMENTS}, a AS (SELECT *, review_status = 'needs_review' AS p, review_status = 'needs_review' AND length(text) % 2 = 0 AS q FROM sg),
b AS (SELECT *, p OR (q AND speaker_id IS NOT NULL) AS changed FROM a)
SELECT episode_id, id, CASE WHEN NOT q THEN speaker_id END AS speaker_id, md5(CASE WHEN p THEN text || ' (checked)' ELSE text END) AS text_md5, CASE WHEN changed THEN 'edited' ELSE review_status END AS review_status, changed FROM b""",
    "fingerprint_receipts": "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0",
    "stale_outputs": "SELECT 'episodes/' || id || '.json' AS path FROM episodes EXCEPT SELECT 'episodes/' || id || '.json' FROM episodes WHERE status = 'published'",
    "media_eviction": """WITH c AS (SELECT (max(epoch_us(ts)) + min(epoch_us(ts))) // 2 AS cut FROM events)
SELECT CASE WHEN event_id % 17 = 0 THEN 'removed' WHEN event_id % 13 = 0 THEN 'external' WHEN event_type = 'error' THEN 'pinned' WHEN event_type <> 'view' AND event_id % 2 <> 0 THEN 'undelivered'
WHEN epoch_us(ts) > cut THEN 'recent' WHEN event_type = 'view' THEN 'unowned' ELSE 'expired' END AS reason, count(*) AS files FROM events, c GROUP BY 1""",
    "classify_references": """WITH e AS (SELECT DISTINCT ON (id) id, series, "references" AS r FROM episodes)
SELECT id, (len(list_filter(coalesce(r, []), lambda x: coalesce(x.note, '') <> 'series')) + CASE WHEN series.id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS references_after, series.id IS NOT NULL OR r IS NULL OR len(list_filter(r, lambda x: coalesce(x.note, '') = 'series')) > 0 AS changed FROM e""",
    "markdown_lines": TURN_TEXTS + r""", md AS (SELECT episode_id, 3 AS block, first_idx::BIGINT AS line_no, part, text AS l FROM tt
UNION ALL SELECT id, 0, 0, 0, trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g')) FROM (SELECT DISTINCT ON (id) * FROM episodes)
UNION ALL SELECT DISTINCT episode_id, 2, idx, 0, trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g')) || chr(0) || printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
 FROM (SELECT *, CASE WHEN "start" IS NOT NULL AND isfinite("start") AND "start" >= 0 THEN floor("start")::BIGINT ELSE 0 END AS s FROM chapters)
UNION ALL SELECT DISTINCT episode_id, 1, idx, 0, name || chr(0) || role FROM speakers),
es AS (SELECT *, """ + _ESC.format("split_part(l, chr(0), 1)") + """ AS x, split_part(l, chr(0), 2) AS y FROM md)
SELECT episode_id, block, line_no, part, CASE block WHEN 0 THEN '# ' || x WHEN 1 THEN '- ' || x || CASE WHEN y <> '' THEN ' · ' || y ELSE '' END WHEN 2 THEN '- ' || y || ' ' || x ELSE x END AS line FROM es""",
}
