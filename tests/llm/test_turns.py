from talklake.llm.turns import Roster, found_turns, parse_row, speaker_turns

PEOPLE = [
    {"id": "speaker-1", "name": "Ilvane Orvendahl", "role": "host", "source_label": "SPK_01"}, {"id": "speaker-2", "name": "Tovan Rastovane", "role": "guest", "source_label": "SPK_02"},
    {"id": "speaker-3", "name": "小砚", "role": "guest", "source_label": "SPK_03"}, {"id": "speaker-4", "name": "Gisla Rastovane", "role": "", "source_label": None},
]


def test_labels():
    find = Roster(PEOPLE).find
    for label in ("speaker-1", "SPK_01", " spk-1 ", "ＳＰＫ_０１", "Speaker 1", "Spkr 1", "说话人1", "speaker 1:", "Host", "主持人", "ILVANE", "Orvendahl, Ilvane", "I. Orvendahl", "[Ilvane Orvendahl]", "Ilvane Orvnedahl", "Ilvane Orvendhl", "Ilvane Orvendahl (host)", "Ilvane  Orvendahl（SPK_01）"):
        assert find(label) == "speaker-1", label
    assert find("小砚 (guest)") == find("[小砚]") == "speaker-3" and find("Gisla Rastovane (guest)") == "speaker-4"
    for label in ("guest", "Rastovane", "Speaker 9", "Caller 1", "Announcer", "A", "?", "", "unknown", "Ilvane Orvendahl (SPK_02)", "小观"):
        assert find(label) == "", label


def test_line_parser():
    r = Roster(PEOPLE)
    for text in (None, "", "  ", "—", "...", "​", "[crosstalk 00:01:02]", "(01:50)", "@01:26", "00:06:05.760 (coughs)", "12分44秒 【笑声】", "♪ ♪", "Um... [MUSIC PLAYING]", "uh, uh", "嗯……", "呃，嗯 （掌声）", "*sighs*{door slams}", "えっと", "SPK_01: (coughs)", "<00:02:26> - ähm"):
        assert parse_row("SPK_02", text, r) == ("speaker-2", None), text
    assert parse_row(None, "[00:00:32 --> 00:00:36] ILVANE ORVENDAHL - Um, right. (laughs)", r) == ("speaker-1", "right.")
    assert parse_row("unknown", "Tovan Rastovane：好。", r) == ("speaker-2", "好。")
    assert parse_row("SPK_02", "Ilvane Orvendahl: Go on.[laughter]", r) == ("speaker-2", "Go on.")
    assert parse_row("", "(Nobody came. That is rare.)", r) == ("", "(Nobody came. That is rare.)")
    assert parse_row("x", "Note: this stays - as it is at 5:27", r) == ("", "Note: this stays - as it is at 5:27")


EVENT = "stream_id string, attempt int, seq int, type string, id string, start double, end double, speaker string, text string"
PERSON = "episode_id string, id string, name string, role string, source_label string"


def test_turns(spark):
    seg, done = "transcript.text.segment", "transcript.text.done"
    ev = [
        ("e", 1, 0, seg, "z", 0.0, 1.0, "SPK_01", "broken attempt"), ("e", 2, 0, seg, "a", 0.0, 1.0, "SPK_01", "One."), ("e", 2, 1, seg, "b", 2000.0, 2001.0, None, "(coughs)"), ("e", 2, 2, seg, "c", 5000.0, 5001.0, "host", "Two."),
        ("e", 2, 9, seg, "c", 5000.0, 5001.0, "host", "Two."), ("e", 2, 3, seg, "d", 5000.0, 5002.0, "who?", "x"), ("e", 2, 4, seg, "f", 5001.0, 5002.0, "who?", "y"), ("e", 2, 5, seg, "g", None, None, "小砚", "z"),
        ("e", 2, 6, done, None, None, None, None, "all"), ("q", 1, 0, seg, "a", 0.0, 1.0, "SPK_01", "no roster"), ("q", 1, 1, done, None, None, None, None, None), ("w", 1, 0, seg, "a", 0.0, 1.0, "SPK_01", "never done"),
    ]
    events = spark.createDataFrame(ev, EVENT)
    people = spark.createDataFrame([("e", p["id"], p["name"], p["role"], p["source_label"]) for p in PEOPLE] * 2, PERSON)
    want = [("e", "a", "c", "speaker-1"), ("e", "d", "d", ""), ("e", "f", "f", ""), ("e", "g", "g", "speaker-3"), ("q", "a", "a", "")]
    assert sorted(tuple(r) for r in found_turns(events, people).collect()) == want
    parts = sorted((r.first_id, r.part, r.text) for r in speaker_turns(events, people).where("stream_id = 'e'").collect())
    assert parts == [("a", 0, "One."), ("a", 8, "Two."), ("d", 0, "x"), ("f", 0, "y"), ("g", 0, "z")]
    assert found_turns(events.limit(0), people.limit(0)).count() == 0
