import random

from pyspark.sql import functions as F

from talklake.functions import text as T
from talklake.operators.catalog import catalog_problems
from talklake.operators.chunks import plan_problems, stitch
from talklake.operators.frames import spans, without_static
from talklake.operators.versioning import compare_versions


def test_links_labels_versions(spark):
    cases = [("https://cast.example/a?t=5&x=1#m", "https://cast.example/a?x=1&t=61#m"), ("http://www.cast.example/", "http://www.cast.example/?t=61"), ("https://other.example/a?t=5", "https://other.example/a?t=5"), ("https://notcast.example/", "https://notcast.example/"), (None, ""), ("x", "")]
    df = spark.createDataFrame([(u, w, 61.9) for u, w in cases], "u string, w string, s double").select("u", "w", T.deep_link("u", "s", "cast.example").alias("o"))
    assert all((r.o or "") == r.w for r in df.collect())
    dates = {"20240131": "2024.01.31", "2024-02-29T08:00:00Z": "2024.02.29", "2023-02-29": None, "": None, "soon": None}
    got = {r.d: r.o for r in spark.createDataFrame([(d,) for d in dates], "d string").select("d", T.date_label("d").alias("o")).collect()}
    assert got == dates
    v = spark.createDataFrame([("v1.2.0",), ("1.2",), ("1.10rc1",), ("x.1",), ("0.0",)], "v string").select(T.version_key("v").alias("o"))
    assert [r.o for r in v.collect()] == [[1, 2], [1, 2], [1, 10], None, []]
    m = spark.createDataFrame([(61.0,), (60.0,), (None,), (float("nan"),), (-5.0,)], "s double").select(T.minutes_label("s").alias("o"))
    assert [r.o for r in m.collect()] == [2, 1, 0, 0, 0]
    c = spark.createDataFrame([("a\u0007",), ("a​",), (None,)], "s string").select(T.has_control("s").alias("a"), T.has_control("s", True).alias("b"))
    assert [tuple(r) for r in c.collect()] == [(True, True), (False, True), (False, False)]


FRAME = "k string, frame_idx int, time double, text string, confidence double, low boolean"


def test_frame_spans(spark):
    rows = [("a", 0, 0.0, "x", 80.0, False), ("a", 1, 0.5, "x", 90.0, True), ("a", 2, 1.0, "", 0.0, False), ("a", 3, 1.5, "x", 70.0, None), ("a", 4, 2.5, "x", 60.0, False), ("a", 5, 3.0, None, None, None)]
    got = sorted(tuple(r) for r in spans(spark.createDataFrame(rows, FRAME), "k", 0.5).collect())
    assert got == [("a", "x", 0.0, 1.0, 2, 85.0, True), ("a", "x", 1.5, 2.0, 1, 70.0, False), ("a", "x", 2.5, 3.0, 1, 60.0, False)]


def test_static_lines(spark):
    rnd = random.Random(1)
    rows = [("a", i, i * 1.0, "\n".join(["logo"] * (i != 25) + [f"w{rnd.randrange(3)}"] + ["logo"] * (i == 3)), 1.0, False) for i in range(70)]
    out = {r.frame_idx: r.text for r in without_static(spark.createDataFrame(rows, FRAME), "k", 1.0).collect()}
    assert all(("logo" in out[i]) == (i < 25) for i in range(70) if i != 25) and len(out) == 70  # 25 frames are too few seconds, 44 are enough


def test_plan_problems_and_stitching(spark):
    plan = "k string, chunk int, start_ms long, end_ms long"
    chunks = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 10, 20), ("b", 0, 0, 10), ("b", 1, 11, 50), ("b", 3, 50, 60)], plan)
    lengths = spark.createDataFrame([("a", 20), ("b", 61)], "k string, duration_ms long")
    got = sorted(tuple(r) for r in plan_problems(chunks, lengths, "k", 20).collect())
    assert got == [("b", "bad_end"), ("b", "bad_number"), ("b", "gap_or_overlap"), ("b", "too_long")]
    rows = spark.createDataFrame([("a", 0, 0, 1, 5, "A", "x"), ("a", 1, 0, 2, 15, "A", "y"), ("a", 1, 1, 3, 4, None, "z"), ("a", 1, 2, 3, 4, "B", "w")], "k string, chunk int, row_no int, start_ms long, end_ms long, speaker string, text string")
    refs = spark.createDataFrame([("a", 0, "A", "v1"), ("a", 1, "A", "v1"), ("a", 1, "A", "v1")], "k string, chunk int, speaker string, label string")
    got = sorted((r.start_ms, r.end_ms, r.speaker or "", r.text, r.unmatched) for r in stitch(rows, chunks, refs, "k").collect())
    assert got == [(1, 5, "v1", "x", False), (12, 20, "v1", "y", False), (13, 14, "", "z", False), (13, 14, "1:B", "w", True)]


def test_catalogue_and_versions(spark):
    cat = spark.createDataFrame([("a", "One", ["Uno"], ["s"]), ("a", "Two", None, ["s"]), ("b!", " ", [], None), ("c", "ｕｎｏ", ["Inbox"], ["s"])], "id string, title string, aliases array<string>, sources array<string>")
    assert sorted(tuple(r) for r in catalog_problems(cat, ["Inbox"]).collect()) == [("a", "id_repeated"), ("a", "name_taken"), ("b!", "id_invalid"), ("b!", "sources_count"), ("b!", "title_blank"), ("c", "name_reserved"), ("c", "name_taken")]
    l = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "i int, a string, b int")  # noqa: E741
    r = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (4, "w", 1)], "i int, a string, b int")
    assert {x.i: x.changed for x in compare_versions(l, r, ["i"], ["a", "b"]).collect()} == {1: ["b"], 3: ["removed"], 4: ["added"]}
    assert compare_versions(l.limit(0), r.limit(0), ["i"], ["a"]).count() == 0
    assert l.select(F.lit(1)).count() == 3
