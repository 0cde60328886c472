import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talklake.llm.packing import TOKENIZER, differencing, fill_containers, pack_items, pieces, split_by_tokens, tokenizer


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_packing_holds_every_item_once(sizes):
    out = pack_items(sizes, 100)
    assert sorted(i for _, items in out for i in items) == list(range(len(sizes)))
    assert all(s == sum(sizes[i] for i in items) <= 100 for s, items in out)


def test_windows_are_near_equal_and_tight():
    sums = [s for s, _ in differencing([8, 7, 6, 5, 4], 2)]
    assert sums == [16, 14]
    rnd = random.Random(1)
    sizes = [rnd.randrange(20, 900) for _ in range(1000)]
    out = pack_items(sizes, 2048)
    assert len(out) <= 1.02 * -(-sum(sizes) // 2048)
    with pytest.raises(ValueError):
        pack_items([3000], 2048)
    assert pack_items([], 5) == []


@pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer files")
def test_long_texts_are_split_without_loss(spark):
    enc = tokenizer(TOKENIZER)
    rnd = random.Random(2)
    long = "".join(rnd.choice(["word ", "日本語", "🎧", "é", "\n", "<|endoftext|>"]) for _ in range(3000))
    parts = split_by_tokens(long, enc, 64)
    assert "".join(long[s:e] for s, e, _ in parts) == long and all(n == len(enc.encode_ordinary(long[s:e])) <= 64 for s, e, n in parts)
    assert split_by_tokens("hi", enc, 64)[0][:2] == (0, 2) and split_by_tokens("", enc, 64) == []
    rows = [(i, "some text " * rnd.randrange(1, 60), "x") for i in range(200)] + [(500, long, "x"), (501, None, "x"), (502, "", "x"), (None, "no id", "x"), (3, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    got = fill_containers(df, 64, block=50).collect()
    used = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
    assert max(used.values()) <= 64 and {r.doc_id for r in got} == {*range(200), 500}
    texts = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        if r.doc_id == 500:
            texts[r.piece] = long[r.start_pos : r.end_pos]
    assert "".join(texts[k] for k in sorted(texts)) == long
    assert fill_containers(df.limit(0)).count() == 0


@pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="the tokenizer is not here")
def test_texts_without_an_id_get_no_container(spark):
    df = spark.createDataFrame([(None, "no id"), (None, "no id " * 90), (7, "some text")], "doc_id long, text string")
    assert [r.doc_id for r in pieces(df, 64).collect()] == [r.doc_id for r in fill_containers(df, 64).collect()] == [7]
    assert "null doc_id" in fill_containers.__doc__ and "without a doc_id" in pieces.__doc__
