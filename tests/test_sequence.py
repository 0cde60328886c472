import random

from pyspark.sql import functions as F

from talklake.operators.runs import mark_runs
from talklake.operators.sequence import idx_shard, islands, next_fit, prefix, rank


def numbers(seed, n):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", None]), i if rnd.random() < 0.9 else None, f"r{i:03}", rnd.choice([None, 1, 5, 9, 20])) for i in range(n)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2]))


def test_prefix_kinds_match_plain_loops(spark):
    rows = numbers(1, 80)
    df = spark.createDataFrame(rows, "k string, idx int, id string, v int")
    outs = {"p": ("lag", "v"), "l": ("last", "v"), "m": ("max", "v"), "s": ("sum", "v")}
    got = {r.id: (r.p, r.l, r.m, r.s) for r in prefix(df, ["k"], idx_shard("idx", 7), [F.col("idx").asc_nulls_last(), "id"], outs).collect()}
    for k in ("a", "b", None):
        before, total = [], 0
        for r in ordered([r for r in rows if r[0] == k]):
            known = [x for x in before if x is not None]
            total += r[3] or 0
            assert got[r[2]] == (before[-1] if before else None, known[-1] if known else None, max(known, default=None), total)
            before.append(r[3])
    assert len(got) == len(rows)


def test_rank_and_empty(spark):
    rows = numbers(2, 40)
    df = spark.createDataFrame(rows, "k string, idx int, id string, v int")
    got = {r.id: r["rank"] for r in rank(df, ["k"], idx_shard("idx", 5), [F.col("idx").asc_nulls_last(), "id"]).collect()}
    assert got == {r[2]: i for k in ("a", "b", None) for i, r in enumerate(ordered([r for r in rows if r[0] == k]))}
    assert rank(df.limit(0), ["k"], idx_shard(), ["idx", "id"]).count() == 0


def test_runs_are_stitched_over_shards(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        rows = [("a", i, rnd.choice(["x", "x", "x", "y", None])) for i in range(60)]
        df = spark.createDataFrame(rows, "k string, idx int, v string")
        got = {r.idx: (r.run_shard, r.run_no) for r in mark_runs(df, ["k"], idx_shard("idx", 4), ["idx"], "v").collect()}
        for i in range(1, 60):
            assert (got[i] == got[i - 1]) == (rows[i][2] is not None and rows[i][2] == rows[i - 1][2])
        assert len(set(got.values())) == 1 + sum(got[i] != got[i - 1] for i in range(1, 60))


def test_islands_strict_and_touching(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 7, 9), ("a", 12, 13)], "k string, s int, e int")
    shard = F.floor(F.col("s") / 3).cast("long")
    at = lambda t: [r.island for r in islands(df, ["k"], "s", "e", shard, ["s", "e"], t).orderBy("s").collect()]
    assert at(True) == [1, 1, 1, 2] and at(False) == [1, 2, 2, 3]


def greedy(rows, most, count, span=None):
    out, page = [], []
    for r in rows:
        if page and (sum(x[1] for x in page) + r[1] > most or len(page) >= count or (span is not None and r[3] - page[0][2] > span)):
            out.append(page)
            page = []
        page.append(r)
    return [*out, page] if page else out


def test_next_fit_equals_the_loop_over_many_shards(spark):
    for seed, span in ((1, None), (2, 30.0)):
        rnd = random.Random(seed)
        rows, t = [], 0.0
        for i in range(150):
            t += rnd.random() * 6
            rows.append((i, rnd.choice([0, 1, 3, 7, 50]), t, t + rnd.random() * 5))
        df = spark.createDataFrame([("a", *r) for r in rows] + [("b", 0, 500, 0.0, 1.0)], "k string, r long, z int, s double, e double")
        extra = ("s", "e", span) if span else ()
        got = sorted((r.k, r.page, r.first_rank, r.last_rank) for r in next_fit(df, "k", "r", "z", 20, 6, *extra, shard=16).collect())
        want = [("a", n, p[0][0], p[-1][0]) for n, p in enumerate(greedy(rows, 20, 6, span))]
        assert got == [*want, ("b", 0, 0, 0)]
