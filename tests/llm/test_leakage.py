import random
import re

import numpy as np

from talklake.llm.leakage import item_tokens, near_passages, reader, shared_passages, token_arrays
from talklake.llm.lookalike import transducer

WORD = re.compile(r"[^\W_]+")


def plain(t):
    f = transducer().apply
    return f(f(t).casefold())


def test_tokens_are_pairs_and_triples_with_positions():
    out = {letters: (d.tolist(), p.tolist(), t) for d, p, t, letters in token_arrays(["One two, ONE\nTwo x", "", "ｏｎе two"])}
    docs, pos, terms = out[False]
    assert docs == [0, 0, 0, 0, 2] and pos == [0, 1, 2, 3, 0] and terms[0] == terms[2] == terms[4] != terms[1]
    assert list(token_arrays([""])) == [] and len(out[True][2]) == len("onetwoonetwox") - 2 + 4
    assert reader() is reader()


def build(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "é", "straße"]
    items, docs = [], []
    for i in range(6):
        items.append((i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 12, 13, 40]))), "en", "s"))
    han = [chr(0x4E00 + i) for i in range(40)]
    for i in range(6, 9):
        items.append((i, "".join(rnd.choice(han) for _ in range(rnd.choice([24, 25, 60]))), "zh", "s"))
    for d in range(40):
        _, text, lang, _ = rnd.choice(items)
        units = text.split() if lang == "en" else list(text)
        n = rnd.choice([11, 12, 24, 25, 30])
        s = rnd.randrange(max(1, len(units) - n + 1))
        part = units[s : s + n]
        body = (rnd.choice([" ", ",\n", " — "]).join(part) if lang == "en" else "，".join(part) if rnd.random() < 0.5 else "".join(part))
        body = rnd.choice([str, str.upper, lambda t: t.replace("o", "ο").replace("e", "е"), lambda t: "​".join(t)])(body)
        docs.append((d, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(20))) + " zz " + body + " zz " + "the of " * rnd.randrange(30)))
    docs += [(100, None), (101, ""), (102, items[3][1] + ". " + items[3][1]), docs[0], (None, items[3][1])]
    return items, docs


def brute(items, docs):
    want = set()
    for d, t in docs:
        if d is None or not t:
            continue
        words = WORD.findall(plain(t))
        stream = "".join(words)
        for i, q, lang, _ in items:
            w = WORD.findall(plain(q))
            if lang == "zh":
                s = "".join(w)
                hit = any(s[k : k + 25] in stream for k in range(len(s) - 24))
            else:
                joined = "\0" + "\0".join(words) + "\0"
                hit = any("\0" + "\0".join(w[k : k + 12]) + "\0" in joined for k in range(len(w) - 11))
            if hit:
                want.add((d, i))
    return want


def test_equals_brute_force(spark):
    for seed in (1, 2):
        items, docs = build(seed)
        idf = spark.createDataFrame(items, "item_id long, text string, lang string, suite string")
        ddf = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
        rows = [(r.doc_id, r.item_id) for r in shared_passages(ddf, idf).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute(items, docs)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    from talklake.llm import leakage

    items, docs = build(3)
    idf = spark.createDataFrame(items + items[:1] + [(99, None, "en", "s"), (98, "", "zh", None)], "item_id long, text string, lang string, suite string")
    ddf = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(leakage, "MAX_TERMS", 90)
    got = {(r.doc_id, r.item_id) for r in shared_passages(ddf, idf).collect()}
    assert got == brute(items, docs)
    assert shared_passages(ddf.limit(0), idf).count() == 0 and shared_passages(ddf, idf.limit(0)).count() == 0
    assert item_tokens(idf.limit(0)).count() == 0 and np.uint64(1) == 1


def test_proximity_matches(spark):
    words = [f"term{i}" for i in range(40)]
    filled = " ".join(w + (" uh" if i % 5 == 4 else "") for i, w in enumerate(words))
    docs = [(1, filled), (2, " ".join(words[:4]) + " else " * 50), (3, " and ".join(words)), (4, None), (5, "x " * 500 + filled.upper()), (6, " ".join(words)), (None, filled)]
    items = spark.createDataFrame([(7, " ".join(words), "en", "s"), (8, "short one", "en", "s"), (None, filled, "en", "s"), (9, None, "en", "s")], "item_id long, text string, lang string, suite string")
    ddf = spark.createDataFrame(docs + docs[:1], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.permille for r in near_passages(ddf, items).collect()}
    assert set(got) == {(1, 7), (5, 7), (6, 7)} and got[(6, 7)] == 1000 and got[(1, 7)] == got[(5, 7)] == 820
    assert near_passages(ddf.limit(0), items).count() == 0 and near_passages(ddf, items.limit(0)).count() == 0


def nearest(items, docs, share=400, spread=48):
    """Brute force: the best window of offsets, tried from every offset."""
    want = {}
    for d, t in docs:
        for i, q, lang, _ in items:
            n = 3 if lang == "zh" else 2
            a, b = (["".join(WORD.findall(x)) if lang == "zh" else WORD.findall(x) for x in (t, q)])
            a, b = ([tuple(x[k : k + n]) for k in range(len(x) - n + 1)] for x in (a, b))
            met = [(x - y, y) for x, u in enumerate(a) for y, v in enumerate(b) if u == v]
            best = max((len({y for o, y in met if s <= o <= s + spread}) for s, _ in met), default=0)
            if b and best * 1000 >= share * len(b):
                want[d, i] = max(best * 1000 // len(b), want.get((d, i), 0))
    return want


def near(spark, docs, items):
    idf = spark.createDataFrame(items, "item_id long, text string, lang string, suite string")
    rows = near_passages(spark.createDataFrame(docs, "doc_id long, text string"), idf).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id): r.permille for r in rows}


def test_a_proximity_match_does_not_depend_on_its_place(spark):
    words = [f"term{i}" for i in range(101)]
    items = [(1, " ".join(words), "en", "s")]
    docs = [(100 * gap + k, "x " * k + " ".join(words[:31]) + " y" * gap + " " + " ".join(words[31:62])) for gap in (25, 36, 47, 48, 49) for k in range(24)]
    got = near(spark, docs, items)
    assert got == {(100 * gap + k, 1): 600 for gap in (25, 36, 47, 48) for k in range(24)} == nearest(items, docs)


def test_proximity_matches_equal_brute_force(spark, monkeypatch):
    from talklake.llm import leakage

    rnd = random.Random(5)
    vocab, han = [f"w{i}" for i in range(12)], [chr(0x4E00 + i) for i in range(8)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([4, 20, 60]))), "en", "s") for i in range(5)]
    items += [(i, "".join(rnd.choices(han, k=rnd.choice([5, 40]))), "zh", "s") for i in range(5, 8)] + [(8, "w0 w1 " * 20, "en", "s")]
    docs = []
    for d in range(40):
        _, text, lang, _ = rnd.choice(items)
        units = [u for w in (text.split() if lang == "en" else text) for u in [w] + ["-"] * (rnd.random() < 0.05)]
        body = [x for w in units for x in ([w] if rnd.random() < 0.9 else [w, *["zz"] * rnd.choice([1, 9, 30])]) if x != "-"]
        docs.append((d, " ".join(rnd.choices(vocab, k=rnd.randrange(60))) + " " + ("" if lang == "zh" else " ").join(body) + " w0 w1" * rnd.randrange(70)))
    want = nearest(items, docs)
    assert len(want) > 40 and near(spark, docs + docs[:3], items) == want
    monkeypatch.setattr(leakage, "MAX_TERMS", 50)
    monkeypatch.setattr(leakage, "_MATCHES", 300)
    assert near(spark, docs, items) == want


def test_items_of_one_or_two_tokens_are_found_near(spark):
    items = [(1, "red fox", "en", "s"), (2, "red fox ran", "en", "s"), (3, "猫が好", "zh", "s")]
    docs = [(1, "a red fox sat"), (2, "the fox ran"), (3, "red ran fox"), (4, "私は猫が好き"), (5, "a red fox ran")]
    assert near(spark, docs, items) == {(1, 1): 1000, (1, 2): 500, (2, 2): 500, (4, 3): 1000, (5, 1): 1000, (5, 2): 1000}
