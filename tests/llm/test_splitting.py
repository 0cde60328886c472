import random

from talklake.llm.p2_splitting import boundary_strengths
from talklake.llm.sentences import sentence_units
from talklake.llm.splitting import pack, sequence_pieces, split_text, text_pieces


def test_pack_merges_siblings_and_enters_large_nodes_only():
    assert pack([[10, 20, 30]], 0, 40, lambda at: 20) == [20, 40]
    assert pack([[10, 30], [10, 15, 25, 30]], 0, 40, lambda at: 12) == [10, 15, 25, 30, 40]
    assert pack([[]], 0, 25, lambda at: 10) == [10, 20, 25] and pack([[]], 0, 5, lambda at: 10) == [5]


def check(text, limit, overlap):
    parts = split_text(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    natural = {e for _, e in sentence_units(text)} | {i for i, c in enumerate(text) if c == "\n"}
    for (a, b, u), (c, d, v) in zip(parts, parts[1:]):
        assert d - c <= limit and c <= b < d and b - c <= overlap
        if not (u or v):
            assert b - c == min(overlap, b) or d - b + overlap > limit
            assert any(text[e:b].strip() == "" for e in natural if e <= b), (b, text[b - 20 : b + 5])
    return parts


def test_text_pieces_end_at_sentences():
    rnd = random.Random(1)
    for _ in range(60):
        text = "".join(("Word " * rnd.randrange(1, 30)).strip() + rnd.choice([". ", "! ", ".\n", "?\n\n", ".\n# Head\n"]) for _ in range(40))
        check(text, 300, 40)
    assert split_text("x" * 2500, 1000, 100) == [(0, 1000, 1), (900, 1900, 1), (1800, 2500, 1)]
    assert split_text(None) == [] and split_text("") == [] and split_text("short") == [(0, 5, 0)]
    flags = [u for _, _, u in check("One. " * 100 + "loose words " * 200 + ". Two." * 100, 1200, 100)]
    assert max(flags) == 1 and flags[0] == 0


def test_text_operator(spark):
    df = spark.createDataFrame([("e", "1", "Go. " * 400, 3), ("e", "2", None, 3), ("e", "3", "y" * 1200, 3), ("e", "4", "y" * 1201, 3)], "episode_id string, id string, body string, piece int")
    got = text_pieces(df, ["episode_id", "id"], "body").collect()
    assert {r.id: r.unbroken for r in got} == {"1": 0, "4": 1} and all(len(r.text) <= 1200 for r in got)


def test_sequences_are_cut_in_blocks(spark):
    rnd = random.Random(3)
    rows = [("big", f"s{i:05}", i, rnd.choice([0, 0, 0, 1, 2, 3] if i % 7 else [0])) for i in range(1500)] + [("small", f"s{i}", i, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "episode_id string, id string, idx int, strength int")
    for block in (100, 4000):
        got = sequence_pieces(df, "episode_id", 20, 5, block).where("episode_id = 'big'").orderBy("piece_end").collect()
        at = 0
        for r in got:
            assert r.piece_end - r.piece_start == r.segment_count <= 20 and r.piece_start == max(0, at - 5) and r.first_id == f"s{at:05}" and r.last_id == f"s{r.piece_end - 1:05}"
            at = r.piece_end
        assert at == 1500
    assert sequence_pieces(df, "episode_id", 20, 5).where("episode_id = 'small'").count() == 0
    assert sequence_pieces(df.limit(0), "episode_id").count() == 0


def test_boundary_strengths(spark):
    seg = spark.createDataFrame([("e", "a", 0, 0.0, 1.0, "x"), ("e", "b", 1, 1.0, 2.0, "x"), ("e", "c", 2, 4.0, 5.0, "x"), ("e", "d", 3, 5.0, 6.0, None), ("e", "f", 4, None, None, None), ("e", "a", 0, 0.0, 1.0, "x")], "episode_id string, id string, idx int, start double, end double, speaker_id string")
    ch = spark.createDataFrame([("e", "b"), ("e", None), ("e", "b")], "episode_id string, segment_id string")
    assert {r.id: r.strength for r in boundary_strengths(seg, ch).collect()} == {"a": 2, "b": 3, "c": 1, "d": 2, "f": 1}


def test_the_segment_before_is_found_across_stretches(spark):
    rows = [("e", f"s{i:05}", i, float(i), i + 1.0, "x") for i in (*range(4090, 4100), 8191, 8192, 20000)] + [("e", "t", None, 20001.0, 20002.0, "x"), ("f", "a", 4096, 0.0, 1.0, None)]
    seg = spark.createDataFrame(rows, "episode_id string, id string, idx int, start double, end double, speaker_id string")
    got = {(r.episode_id, r.id): r.strength for r in boundary_strengths(seg, spark.createDataFrame([], "episode_id string, segment_id string")).collect()}
    assert len(got) == len(rows) and {k: v for k, v in got.items() if v} == {("e", "s04090"): 2, ("e", "s08191"): 1, ("e", "s20000"): 1, ("f", "a"): 1}
