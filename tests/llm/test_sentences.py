import random

from talklake.llm.p8_sentences import sentence_spans
from talklake.llm.sentences import gap_class, sentence_units

CASES = [
    "We met at 9:53 a.m. last winter.|The U.S. edition came out.|Dr. J. R. Lee said no. 5 vs. no. 6, i.e. few.",
    "We stopped at 2 p.m.|The shop sold cables, lamps, etc.|Then it rained at 24.64.|About 12 came.",
    "“Who lost it? Who?” they asked.|“Hold on. It broke.”|Then (Nobody came. It is rare.)|We left.",
    'He asked, "Is it? Who?" and then went.|What a day!|it was odd?!|Well... maybe 9 times.',
    "Am 7. Mai kam d. h. kurz z. B. Dr. Otto mit Lampen usw.|Die Spule, ca. 9,5 m, Nr. 4 bzw. 5, riss.|„Wer war es? Und wann?“, fragte sie.",
    "Le fichier durait env. 46 min. après l’orage.|M. Dupont l’a vu à 8 kHz, p. ex. avant la pause.|« Je ne l’ai jamais vu. »|Le vent est fort !|Et alors\xa0?",
    "A las 4 p. m. perdió una carta.|«¿Quién? ¿Y cuándo?» preguntó la Dra. Paz.|¡Qué raro!|Vea la pág. 9,5.",
    "Там были лампы и т. д.|В 1998 г. режиссёр, т. е. он, ушёл.|«Кто? И когда?», — спросил гость.|Запись № 4 длилась 23,5 мин. в конце.",
    "डॉ. शर्वेक ने 11.58 मिनट लिए।|क्या वह आया?|“कब? कहाँ?”, उसने पूछा।",
    "磁带坏了。|“先别动它！谁碰的？”|他说：“好，”就走了。|他问的“谁？什么时候？”，没有人回答。|听众 Lee 寄来 No. 88 磁带！？|主持人……其实没来。|（大家都笑了。）|完",
    "「もう一度。静かに。」|「切れた。誰？」と尋ねた。|ファイルa.mp3は75.9分で、Vol.3にある。|ゲストは……忘れた！？|終わり",
    "ผู้ฟังลืมเทป|ช่างซ่อม 68 ครั้งก่อน ok ไป|ทำไมครับ",
    "The first line\nwraps here.|Missing blank.|Next one: cut.67.wav lasted v4.5.3 long.",
]


def joined(case):
    parts = case.split("|")
    text, spans = "", []
    for i, p in enumerate(parts):
        if i and not (text[-1] in "。！？」”）" and not p[0].isascii() and not text[-1] == "”" or text.endswith("Missing blank.")):
            text += " "
        spans.append((len(text), len(text) + len(p)))
        text += p
    return text, spans


def test_cases_in_many_scripts():
    for case in CASES:
        text, spans = joined(case)
        got = sentence_units(text, "letters")
        assert [text[s:e] for s, e in got] == case.split("|"), case
        assert got == spans


def test_layout():
    text = "  Heading\n \nLee · 00:01:30\n\nOne line\nwraps. Two\n\n　\n"
    assert [text[s:e] for s, e in sentence_units(text)] == ["Heading", "Lee · 00:01:30", "One line\nwraps.", "Two"]
    caps = " a. b! c\n\n  \nd"
    assert [caps[s:e] for s, e in sentence_units(caps, "captions")] == ["a. b! c", "d"]
    for empty in (None, "", " \n\t"):
        assert sentence_units(empty) == []


def test_unpaired_and_unseen_signs():
    for text, want in (("An “open quote. Next one. Last", ["An “open quote.", "Next one.", "Last"]), ("Odd) close. Next.", ["Odd) close.", "Next."]), ('One " two. Three.', ['One " two.', "Three."])):
        assert [text[s:e] for s, e in sentence_units(text)] == want
    text = "We saw Dr.​ Lee. Th­en it r⁠ained.​ End"
    assert [text[s:e] for s, e in sentence_units(text)] == ["We saw Dr.​ Lee.", "Th­en it r⁠ained.", "End"]
    assert [len(sentence_units(t)) for t in ("Seen at 4 р.m. today. Yes.", "i.е. far. Yes.")] == [2, 2]


def test_gap_words():
    assert gap_class("と言った", 0) == "continue" and gap_class("ゲスト", 0) == "new" and gap_class("", 0) == "new"


def test_units_are_ordered_and_complete():
    rnd = random.Random(4)
    signs = list("aB. !?\n「」“”()。とก ข​…'\"5,") + ["\n\n", "Dr.", "e.g."]
    for _ in range(2000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(40)))
        units = sentence_units(text)
        assert all(s < e for s, e in units) and all(a[1] <= b[0] for a, b in zip(units, units[1:]))
        left = "".join(text[a:b] for a, b in zip([0, *[e for _, e in units]], [*[s for s, _ in units], len(text)]))
        assert not left.replace("​", "").strip()
        assert all(not text[s].isspace() and not text[e - 1].isspace() for s, e in units)


def test_spark_rows(spark):
    df = spark.createDataFrame([(1, "A. B.", "letters", 7), (2, None, "letters", 7), (3, "go. yes", None, 7), (1, "A. B.", "letters", 7), (4, "Word. " * 50_000, "summary", 7)], "doc_id long, text string, kind string, start_pos int")
    got = sentence_spans(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 4 if len(sentence_units("A. B.")) == 2 else 2, 3: 2, 4: 50_000}
    assert sentence_spans(df.limit(0)).count() == 0
