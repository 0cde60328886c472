import random

from pyspark.sql import functions as F

from talklake.llm.nearest import nearest_in_time, widths


def test_widths():
    assert widths(200, 1500) == [200, 400, 800, 1500] and widths(9000, 1500) == [1500] and widths(1, 1) == [1]


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    left = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(-4000, 4000, 37)]), i, "n") for i in range(150)]
    right = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(-5000, 5000, 61)]), f"s{i}", i) for i in range(90)]
    right += [("a", 0, "tie1", 500), ("a", 0, "tie0", 400), ("c", 10**12, "far", 1)] + right[:5]
    left += [("c", 10**12 + 1500, 900, ""), ("c", 10**12 + 1501, 901, ""), *left[:3]]
    ldf = spark.createDataFrame(left, "k string, t long, i int, own string")
    rdf = spark.createDataFrame(right, "k string, u long, id string, rank int")

    def best(k, t):
        near = [(abs(u - t), u, rank, i) for key, u, i, rank in right if k is not None and key == k and u is not None and t is not None and abs(u - t) <= 1500]
        return min(near)[3] if near else None

    for first in (100, 375, 2000):
        out = nearest_in_time(ldf, rdf, ["k"], "t", "u", F.struct("rank", "id"), 1500, first)
        assert out.columns == [*ldf.columns, "nearest"]
        got = [((r.k, r.t, r.i, r.own), r.nearest.id if r.nearest else None) for r in out.collect()]
        assert len(got) == len(left)
        assert all(i == best(row[0], row[1]) for row, i in got)
    assert nearest_in_time(ldf, rdf.limit(0), ["k"], "t", "u", F.struct("id"), 1500).where("nearest is not null").count() == 0
    assert nearest_in_time(ldf.limit(0), rdf, ["k"], "t", "u", F.struct("id"), 1500).count() == 0
