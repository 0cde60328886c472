import random

from talklake.operators.cues import coverage, dedupe, gap_tolerance, overlapping_repeats, repair_ranges
from talklake.operators.ranges import overlap_join

CUE = "k string, idx int, id string, start_ms long, end_ms long, text string"


def fixed_point(cands, cues, length):
    """Ranges grown and merged until nothing changes, as the rule is stated."""
    rs = [[max(0, a), min(length, b)] for a, b in cands if min(length, b) > max(0, a)]
    while True:
        before = sorted(map(tuple, rs))
        for r in rs:
            for s, e in cues:
                if s < r[1] and e > r[0]:
                    r[0], r[1] = max(0, min(r[0], s)), min(length, max(r[1], e))
        merged = []
        for r in sorted(rs):
            if merged and r[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], r[1])
            else:
                merged.append(r)
        rs = merged
        if sorted(map(tuple, rs)) == before:
            return before


def test_repair_ranges_reach_the_fixed_point(spark):
    rows, cand, want = [], [], {}
    for n in range(25):
        rnd = random.Random(n)
        cues = [(s, s + rnd.randrange(1, 9)) for s in (rnd.randrange(0, 60) for _ in range(8))]
        picks = [(s, s + rnd.randrange(1, 6)) for s in (rnd.randrange(-3, 60) for _ in range(3))]
        rows += [(f"k{n}", i, f"c{i}", s, e, "t") for i, (s, e) in enumerate(cues)]
        cand += [(f"k{n}", s, e, "r") for s, e in picks]
        want[f"k{n}"] = fixed_point(picks, cues, 62)
    rows.append(("k0", 99, "n", None, 5, None))
    got = {}
    out = repair_ranges(spark.createDataFrame(rows, CUE), spark.createDataFrame(cand, "k string, start_ms long, end_ms long, reason string"), spark.createDataFrame([(k, 62) for k in want], "k string, duration_ms long"), "k")
    for r in out.collect():
        got.setdefault(r.k, []).append((r.start_ms, r.end_ms))
        assert r.reasons == ["r"]
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_dedupe_merges_overlaps_only(spark):
    df = spark.createDataFrame(
        [("a", 0, "1", 0, 10, "x"), ("a", 1, "2", 5, 12, "x"), ("a", 2, "3", 12, 14, "x"), ("a", 3, "4", 13, 20, "y"), ("a", 4, "5", 13, 20, "x"), ("a", 5, "6", None, 3, "x")], CUE
    )
    assert sorted(tuple(r) for r in dedupe(df, "k").collect()) == [("a", "1", 0, 12, 2), ("a", "3", 12, 14, 1), ("a", "4", 13, 20, 1), ("a", "5", 13, 20, 1)]
    assert [r.id for r in overlapping_repeats(df, "k").orderBy("idx").collect()] == ["2", "5"]


def test_coverage_and_tolerance(spark):
    df = spark.createDataFrame([("a", 0, "1", 0, 1000, ""), ("a", 1, "2", 500, 2000, ""), ("a", 2, "3", 6000, 6000, ""), ("a", 3, "4", 9000, 9500, ""), ("b", 0, "1", 5, 6, None)], CUE)
    assert sorted(tuple(r) for r in coverage(df, "k").collect()) == [("a", 3000, 2500, 0, 9500), ("b", 1, 1, 5, 6)]
    assert {r.k: r.tolerance_ms for r in gap_tolerance(df, "k").collect()} == {"a": 24000, "b": 12000}


def test_overlap_join_modes(spark):
    rnd = random.Random(3)
    make = lambda n, p: [(rnd.choice("ab"), s, s + rnd.choice([0.0, 0.5, 40.0, 3000.0]) * rnd.random(), f"{p}{i}") for i, s in enumerate(rnd.random() * 400 for _ in range(n))]
    left, right = make(40, "l"), make(40, "r")
    right += [("a", None, 3.0, "rn"), ("a", 9.0, 1.0, "rx")]
    ldf, rdf = spark.createDataFrame(left, "k string, start double, end double, l string"), spark.createDataFrame(right, "k string, start double, end double, r string")
    ok = [r for r in right if r[1] is not None and r[2] >= r[1]]
    for mode, test in (("tolerant", lambda a, b: a[1] <= b[2] + 0.25 and b[1] <= a[2] + 0.25), ("strict", lambda a, b: a[1] < b[2] and a[2] > b[1]), ("touching", lambda a, b: a[1] <= b[2] and b[1] <= a[2])):
        want = sorted((a[3], b[3]) for a in left for b in ok if a[0] == b[0] and test(a, b))
        tol = 0.25 if mode == "tolerant" else 0.0
        assert sorted((r.l, r.r) for r in overlap_join(ldf, rdf, "k", mode, tol).collect()) == want
        assert sorted(r.l for r in overlap_join(ldf, rdf, "k", mode, tol, "left_anti").collect()) == sorted({a[3] for a in left} - {w[0] for w in want})
    assert overlap_join(ldf, rdf.limit(0), "k", "strict", how="left_anti").count() == len(left)
