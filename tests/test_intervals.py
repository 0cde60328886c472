import random

from talklake.operators.intervals import covered_periods, interval_gaps, sharded_last

SCHEMA = "k string, start_ms long, end_ms long, ids array<string>, extra string"


def brute(rows):
    """Covered periods by plain sweeping."""
    out = {}
    for k in {r[0] for r in rows}:
        merged = []
        for s, e, ids in sorted((r[1], r[2], r[3] or []) for r in rows if r[0] == k and r[1] is not None and r[2] is not None and r[2] > r[1]):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] |= set(ids)
            else:
                merged.append([s, e, set(ids)])
        out[k] = merged
    return out


def sample(seed, n, span, longest):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.randrange(-span, span)
        rows.append((rnd.choice(["a", "b", None]), s, s + rnd.choice([0, -3, 1, 5, rnd.randrange(longest)]), [f"c{i}"], "x"))
    rows += [("a", None, 5, ["n"], None), ("a", 5, None, None, None), ("c", 3, 3, [], None)] + rows[:5]
    return rows


def test_gaps_match_sweeping_across_shards(spark):
    for seed, longest in ((1, 8), (2, 60), (3, 300)):
        rows = sample(seed, 60, 300, longest)
        df = spark.createDataFrame(rows, SCHEMA)
        want = {(k, a[1], b[0]) for k, m in brute(rows).items() for a, b in zip(m, m[1:])}
        for shard in (7, 64, 10_000):
            got = [tuple(r) for r in interval_gaps(df, ["k"], shard_ms=shard).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_periods_hold_all_ids(spark):
    rows = sample(4, 50, 200, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in covered_periods(df, ["k"], "ids", shard_ms=16).collect():
        got.setdefault((r.k, r.period_start_ms, r.period_end_ms), set()).update(r.ids)
    assert got == {(k, s, e): ids for k, m in brute(rows).items() for s, e, ids in m}


def test_touching_nested_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 10, None, ""), ("a", 10, 20, [], ""), ("a", 2, 3, ["x"], ""), ("a", 21, 22, ["y"], "")], SCHEMA)
    assert [tuple(r) for r in interval_gaps(df, ["k"]).collect()] == [("a", 20, 21)]
    none = spark.createDataFrame([], SCHEMA)
    assert interval_gaps(none, ["k"]).count() == 0 and covered_periods(none, ["k"], "ids").count() == 0


def test_very_long_interval_costs_three_rows(spark):
    df = spark.createDataFrame([("a", 0, 10**14, ["l"], ""), ("a", 5, 6, ["m"], ""), ("a", 2 * 10**14, 2 * 10**14 + 1, [], "")], SCHEMA)
    assert [tuple(r) for r in interval_gaps(df, ["k"], shard_ms=1000).collect()] == [("a", 10**14, 2 * 10**14)]


def test_sharded_last_matches_search(spark):
    rnd = random.Random(5)
    pts = [("a", t, t * 10) for t in rnd.sample(range(100), 20)]
    asks = [("a", t) for t in range(-5, 110, 3)]
    got = {r.at: r.v for r in sharded_last(spark.createDataFrame(pts, "k string, at long, w long"), spark.createDataFrame(asks, "k string, at long"), ["k"], "at", "w", "v", 9).collect()}
    assert got == {t: max((p[2] for p in pts if p[1] <= t), default=None) for _, t in asks}
