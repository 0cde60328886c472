from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talklake.functions import text as T
from talklake.operators.catalog import contains_all, resolve, search_parts
from talklake.operators.chunks import cut_times
from talklake.operators.versioning import apply_patch, evictable, reconcile, retain, unknown_targets, valid_receipts, with_fingerprint


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f("v")).first()[0]


def test_comparison_text_keeps_values_apart(spark):
    cases = {"a, b!": "ab", "1.5": "1.5", "1 . 5": "1.5", "5—10": "5—10", "1 23": "1 23", "１２ ３": "12 3", "3 。x": "3x", "not — ok": "notok", "": "", "　": "", "20%": "20%", "-3": "-3"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", T.comparison_text("v").alias("o"))
    assert {r.v: r.o for r in df.collect()} == cases
    assert one(spark, None, T.comparison_text) is None


def test_scalars(spark):
    assert one(spark, "\n　 x \t", T.strip) == "x" and one(spark, " a \n b ", T.collapse) == "a b"
    for raw, want in (("ai-zh", "zh"), ("zh_Hans", "zh"), ("CMN", "zh"), ("eng", "en"), ("pt-BR", "pt"), ("  ", None), (None, None)):
        assert one(spark, raw, T.language) == want
    assert one(spark, "  Straße  X", T.name_key) == "strasse x"
    for raw, a, b in ((3725.9, "01:02:05", "1:02:05"), (65.0, "00:01:05", "01:05"), (None, "00:00:00", "00:00"), (float("nan"), "00:00:00", "00:00"), (360000.0, "100:00:00", "100:00:00")):
        assert one(spark, raw, T.clock, "double") == a and one(spark, raw, T.short_clock, "double") == b
    assert one(spark, "01:02:03,500", T.clock_seconds) == 3723.5 and one(spark, "x:1", T.clock_seconds) is None
    assert one(spark, "a<b>&*", T.escape_markdown) == "a&lt;b&gt;&amp;\\*" and one(spark, "<v.x Bo>hi</v>", T.voice) == "Bo"
    for raw, plain, strict in (("https://a.b/c", True, True), ("http://u@a.b", True, False), ("ftp://a.b", False, False), ("https://a b", False, False), (None, False, False)):
        assert (one(spark, raw, T.safe_url) not in ("", None)) == plain and one(spark, raw, T.strict_url) == strict
    assert one(spark, "My Title!", T.slug).startswith("my-title-") and one(spark, "a b", T.identifier) is False


def test_fingerprint_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, ""), ("", None), ("", "")], "a string, b string").select(T.fingerprint("a", "b").alias("f"))
    assert len({r.f for r in df.collect()}) == 3


def test_resolve_decisions(spark):
    cat = spark.createDataFrame([("s1", "One", ["Uno"]), ("s2", "Two", None), ("s3", "Uno", [])], "id string, title string, aliases array<string>")
    asks = [(1, None, None), (2, "s1", None), (3, "s1", "Two"), (4, None, " two "), (5, "s2", "One"), (6, None, "UNO"), (7, "zz", None), (8, None, "New Show"), (9, "zz", "Two"), (10, "s1", "One")]
    got = {r.k: (r.series_id, r.outcome) for r in resolve(spark.createDataFrame(asks, "k int, want_id string, want_title string"), cat, "k").collect()}
    assert {k: v[1] for k, v in got.items()} == {1: "inbox", 2: "by_id", 3: "conflict", 4: "by_name", 5: "conflict", 6: "ambiguous", 7: "unknown_id", 8: "new", 9: "conflict", 10: "by_id"}
    assert got[4][0] == "s2" and got[8][0].startswith("new-show-") and got[3][0] is None


def test_search(spark):
    df = spark.createDataFrame([("a", "Night TAPE"), ("a", "archive"), ("b", "tape"), ("c", None)], "k string, t string")
    assert [r.k for r in df.where(contains_all(F.col("t"), "tape night")).collect()] == ["a"]
    assert df.where(contains_all(F.col("t"), "  ")).count() == 4
    assert [r.k for r in search_parts(df, "k", "t", "Archive tape").collect()] == ["a"] and search_parts(df, "k", "t", "").count() == 3


def test_patch_tells_absent_from_null(spark):
    base = spark.createDataFrame([("e", "1", "x", "s"), ("e", "2", "y", "s"), ("e", "3", None, None)], "k string, id string, text string, who string")
    patch = spark.createDataFrame([("e", "1", None, None, False, True), ("e", "2", "y", None, True, False), ("e", "9", "z", None, True, True)], "k string, id string, text string, who string, has_text boolean, has_who boolean")
    got = {r.id: (r.text, r.who, r.changed) for r in apply_patch(base, patch, ["k", "id"], ["text", "who"]).collect()}
    assert got == {"1": ("x", None, True), "2": ("y", "s", False), "3": (None, None, False)}
    assert [tuple(r) for r in unknown_targets(base, patch, ["k", "id"]).collect()] == [("e", "9")]


def test_versions(spark):
    rows = spark.createDataFrame([("e", v, v == 5) for v in range(20)], "k string, v int, key boolean")
    assert sorted(r.v for r in retain(rows, "k", "v", 3, F.col("key")).where("keep").collect()) == [0, 5, 17, 18, 19]
    a = with_fingerprint(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "i int, t string"), ["t"])
    b = with_fingerprint(spark.createDataFrame([(2, "y"), (3, "q"), (4, "w")], "i int, t string"), ["t"])
    assert {r.i: r.state for r in reconcile(a, b, ["i"]).collect()} == {1: "left_only", 2: "same", 3: "differs", 4: "right_only"}
    assert [r.i for r in valid_receipts(a, b.select("i", "digest"), ["i"]).collect()] == [2]
    media = spark.createDataFrame([(p, float(i), p == "r", p == "x") for i, p in enumerate("rxpuoe")] + [("n", 99.0, False, False)], "path string, last_used double, removed boolean, external_input boolean")
    owners = spark.createDataFrame([("p", "1", True, True), ("u", "1", False, False), ("u", "2", False, True), ("e", "1", False, True)], "path string, owner string, pinned boolean, delivered boolean")
    assert {r.path: r.reason for r in evictable(media, owners, F.lit(50.0)).collect()} == {"r": "removed", "x": "external", "p": "pinned", "u": "undelivered", "o": "unowned", "e": "expired", "n": "recent"}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4000), st.lists(st.tuples(st.integers(0, 4000), st.integers(0, 90)), max_size=12), st.integers(20, 400), st.integers(0, 60))
def test_chunks_cover_every_moment_once(length, pauses, limit, window):
    cuts = cut_times(length, [(a, a + n) for a, n in pauses], limit, window)
    assert [c[0] for c in cuts[1:]] == [c[1] for c in cuts[:-1]] and (not cuts) == (length == 0)
    assert all(0 < b - a <= limit for a, b, _ in cuts) and (not cuts or cuts[0][0] == 0 and cuts[-1][1] == length)
    for a, b, kind in cuts:
        if kind == "silence":
            assert b - a >= limit // 2 and any(p <= b <= p + n for p, n in pauses)
