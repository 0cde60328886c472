import pandas as pd

from talklake.operators.align import align, compare
from talklake.operators.assess import assess, replace_ranges
from talklake.operators.turns import join_prefix, reading_turns, turn_text

SEG = "doc_id string, idx int, id string, start double, end double, text string"
CUE = SEG + ", low boolean"


def run(segs, cues):
    s = pd.DataFrame([(f"s{i}", a, b, t) for i, (a, b, t) in enumerate(segs)], columns=["id", "start", "end", "norm"])
    c = pd.DataFrame([([f"c{i}"], a, b, t, low) for i, (a, b, t, low) in enumerate(cues)], columns=["ids", "start", "end", "norm", "low"])
    return compare(s, c)


def test_one_cue_over_several_segments_and_additions():
    segs = [(i, i + 1, f"word{i}") for i in range(5)]
    out = run(segs, [(0, 5, "".join(t for _, _, t in segs), False)])
    assert [x[1] for x in out] == ["match"] * 5
    out = run([(0, 2, "yes"), (2.5, 4, "fine")], [(0, 2, "yesnot", False), (2.5, 4, "fine", False)])
    assert out[0][1:3] == ("text_difference", ["subtitle_addition"]) and out[1][1] == "match"


def test_missing_uncertain_and_stray_cues():
    out = run([(0, 1, "a"), (50, 51, "b"), (80, 81, "")], [(0, 1, "a", True), (20, 21, "zz", False), (80, 81, "x", False)])
    assert out[0][1:3] == ("text_difference", ["low_confidence_ocr"]) and out[1][1:3] == ("no_subtitle", ["no_temporal_overlap"])
    assert "no_comparable_characters" in out[2][2] and ("unaligned_subtitle", ["no_temporal_overlap"], ["c1"]) in [x[1:] for x in out]


def test_align_drops_nothing(spark):
    s = spark.createDataFrame([("d", 0, "a", 0.0, 1.0, "Hi, you."), ("d", 1, "b", 1.0, None, "lost"), ("e", 0, "a", 0.0, 1.0, None)], SEG)
    c = spark.createDataFrame([("d", 0, "1", 0.0, 0.6, "hi", None), ("d", 1, "2", 0.5, 1.0, "you", False), ("f", 0, "1", 0.0, 1.0, "only", False)], CUE)
    got = {(r.doc_id, r.segment_id): (r.status, r.cue_ids) for r in align(s, c).collect()}
    assert got == {("d", "a"): ("text_difference", ["1", "2"]), ("e", "a"): ("no_subtitle", []), ("f", None): ("unaligned_subtitle", ["1"])}
    assert align(s.limit(0), c.limit(0)).count() == 0


def test_assessment(spark):
    text = "enough words to read here"
    good = [("g", i, f"c{i}", i * 5000, i * 5000 + 4800, f"{text} {i * 7919}", 0.95, False) for i in range(20)]
    low = [("l", *x[1:6], 0.2 if x[1] == 4 else 0.95, None) for x in good]
    bad = [("b", 0, "c0", 0, 1000, "x", 7.0, None), ("b", 1, "c1", None, 5, "y", None, None)]
    cues = spark.createDataFrame(good + low + bad, "doc_id string, idx int, id string, start_ms long, end_ms long, text string, confidence double, low_confidence boolean")
    tracks = spark.createDataFrame(
        [("g", "available", "en", "unit", 100_000), ("l", "available", "ENG", "unit", 100_000), ("b", "available", None, "unit", None), ("e", "available", "en", "unit", 5000), ("u", "none", "en", None, 5000)],
        "doc_id string, status string, language string, confidence_scale string, duration_ms long",
    )
    got = {r.doc_id: (r.usable, r.repairable, r.reasons) for r in assess(cues, tracks, "en").collect()}
    assert got["g"] == (True, False, []) and got["l"] == (False, True, ["low_confidence"])
    assert got["b"][2] == ["invalid_confidence", "invalid_structure", "unknown_duration", "unknown_language"]
    assert got["e"][2] == ["empty_cues"] and got["u"][2] == ["empty_cues", "subtitles_unavailable"]


def test_replacing_ranges(spark):
    cues = spark.createDataFrame([("d", 0.0, 1.0, "keep"), ("d", 2.0, 3.0, "old"), ("d", 4.0, 5.0, "touch")], "k string, start double, end double, text string")
    ranges = spark.createDataFrame([("d", 2.0, 4.0)], "k string, start double, end double")
    rows = spark.createDataFrame([("d", 2.0, 4.0, 0.0, 2.2, "new"), ("d", 2.0, 4.0, 0.0, 2.3, "late")], "k string, range_start double, range_end double, start double, end double, text string")
    got = sorted(tuple(r) for r in replace_ranges(cues, ranges, rows, "k").collect())
    assert got == [("d", 0.0, 1.0, "keep", "cue"), ("d", 2.0, 4.0, "new", "repair"), ("d", 4.0, 5.0, "touch", "cue")]


def test_turns_join_scripts(spark):
    seg = spark.createDataFrame(
        [("e", 0, "a", "s1", "Hello."), ("e", 1, "b", "s1", "World"), ("e", 2, "c", None, "x"), ("e", 3, "d", None, "y"), ("e", 4, "f", "s2", "你好"), ("e", 5, "g", "s2", " \n "), ("e", 6, "h", "s2", "再见 ok"), ("e", 7, "i", "s9", "q"), ("e", 8, "j", "s9", None)],
        "episode_id string, idx int, id string, speaker_id string, text string",
    )
    people = spark.createDataFrame([("e", "s1"), ("e", "s2"), ("e", "s2")], "episode_id string, id string")
    marked = reading_turns(seg, people)
    assert sorted((r.first_idx, r.text) for r in turn_text(marked).collect()) == [(0, "Hello. World"), (2, "x"), (3, "y"), (4, "你好再见 ok"), (7, "q"), (8, "")]
    assert join_prefix(marked, "episode_id").count() == 9
