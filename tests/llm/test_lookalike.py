import itertools
import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from talklake.llm.lookalike import KEPT_APART, consistent_text, transducer
from talklake.llm.p4_lookalike import look_alike_pairs

SAME = [
    ("ＡＢｃ　１", "ABc 1"), ("é", "é"), ("й", "й"), ("ё", "ë"), ("ﬁn", "fin"), ("⼈⼤", "人大"), ("ｶﾞ", "ガ"), ("ガ", "ガ"), ("a   b", "a b"), ("​x­⁠y﻿", "xy"),
    ("сосо", "coco"), ("Τһе", "The"), ("a​ ​b", "a b"), ("take‑1", "take-1"), ("e‍́", "é"), ("．", "."), ("\U000e0041x", "x"), ("क़", "क़"),
]


def test_same_and_different():
    f = transducer().apply
    for a, b in SAME:
        assert f(a) == f(b), (a, b)
    for p in KEPT_APART:
        assert f(p[0]) != f(p[1:])
    for a, b in (("A", "a"), ("é", "e"), ("m²", "m2"), ("ab", "a b"), ("x.", "x。"), ("resume", "resumé"), ("ı", "i"), ("5", "6")):
        assert f(a) != f(b)
    assert f("") == f(" ​ ") == ""


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs",)), st.sampled_from("é ​сＡﬁ")), max_size=30))
def test_stable_and_blind_to_the_unseen(t):
    f = transducer().apply
    once = f(t)
    assert f(once) == once and "  " not in once
    assert f("⁠".join(t)) == f(t.replace("⁠", "")) or any(unicodedata.combining(c) or unicodedata.category(c).startswith("M") for c in t) or "  " in t


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(1)
    forms = ["stop", "ѕtop", "stoр", "ｓｔｏｐ", "Stop", "sto p", "st​op", "stop ", "", "​", None]
    rows = [(rnd.choice(["a", "b"]), f"c{i:02}", rnd.choice(forms), "x") for i in range(60)]
    rows += rows[:4] + [(None, "n1", "stop", "x"), (None, "n2", "ѕtop", "x"), ("a", None, "stop", "x")]
    df = spark.createDataFrame(rows, "doc string, id string, text string, id_a string")
    f = transducer().apply
    want = set()
    for (k, i, t, _), (m, j, u, _) in itertools.combinations(rows, 2):
        if k == m and i is not None and j is not None and None not in (t, u) and t != u and f(t) == f(u) and i != j:
            want.add((k, min(i, j), max(i, j)))
    got = [tuple(r) for r in look_alike_pairs(df, "doc", "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert look_alike_pairs(df.limit(0), "doc", "id", "text").count() == 0


def test_very_long_and_null_text(spark):
    df = spark.createDataFrame([("ａ́ " * 200_000,), (None,), ("",)], "t string").select(consistent_text("t").alias("o"))
    a, b, c = [r.o for r in df.collect()]
    assert len(a) == 400_000 - 1 and b is None and c == ""


def test_signs_beyond_the_first_plane():
    f = transducer().apply
    same = [("a\U0001d173b", "ab"), ("\U0002f800", "\u4e3d"), ("\U00011099\U000110ba", "\U0001109a"), ("\U0001d15e", "\U0001d157\U0001d165"), ("\U0001f3a7 ѕtop\u3000\U0001d17a", "\U0001f3a7 stop")]
    for a, b in same:
        assert f(a) == f(b), (a, b)
    for a, b in (("\U0001d400", "A"), ("\U000110bd", ""), ("\U0001f3a7", ""), ("\U0001f44d\U0001f3fd", "\U0001f44d"), ("\U00020000", "\U00020001")):
        assert f(a) != f(b), (a, b)
    for cp in [*range(0x10000, 0x20000), *range(0x2F800, 0x2FA1E)]:
        c = "k" + chr(cp)
        assert f(f(c)) == f(c) == f(unicodedata.normalize("NFD", c)) == f(unicodedata.normalize("NFC", c)), hex(cp)
