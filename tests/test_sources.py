import pytest
from pyspark.sql import functions as F

from talklake.sources.records import duration, form_fields, from_parts, numbered_records, ocr_lines, silences, to_parts
from talklake.sources.subtitles import files, preflight, read_transcripts, strict_json
from talklake.sources.writers import archive, create_only, documents_of_lines, store_new

SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello <i>there</i>\r\n\r\n2\r\n00:00:02,500 --> 00:61:00,000\r\nBad clock\r\n\r\n3\r\nno timing\r\n"
VTT = "WEBVTT\n\nNOTE aside\nmore\n\n00:01.000 --> 00:02.000 align:start\n<v.loud Ana>Tom &amp; I</v>\n\n01:00:03.000 --> 01:00:04.000\n\n00:05.000 --> 00:06.000\nx\n00:07.000 --> 00:08.000\n"
JSONS = {
    "a.json": '[{"from": 0, "to": 1.5, "content": " hi "}, {"start": 2, "end": 3, "text": "yo", "speaker": "unknown"}]',
    "b.json": '{"segments": [{"start": 0, "end": 1, "text": null, "content": "no"}, {"start": 1, "text": "z"}, {"start": 1, "end": 2, "text": "  "}]}',
    "c.json": '{"body": [], "body": []}',
    "d.json": '{"other": 1}',
}


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.srt").write_text(SRT, encoding="utf-8", newline="")
    (tmp_path / "x/b.vtt").write_text(VTT, encoding="utf-8")
    (tmp_path / "x/e.srt").write_text("", encoding="utf-8")
    for n, t in JSONS.items():
        (tmp_path / "x" / n).write_text(t)
    rows = read_transcripts(spark, str(tmp_path)).withColumn("f", F.substring_index("path", "/", -1))
    got = {}
    for r in rows.orderBy("f", "idx").collect():
        got.setdefault(r.f, []).append((r.start, r.end, r.speaker, r.text, r.problem))
    assert got["a.srt"] == [(1.0, 2.5, None, "Hello there", None), (2.5, 3660.0, None, "Bad clock", "bad_clock"), (None, None, None, got["a.srt"][2][3], "no_timing")]
    assert got["b.vtt"][0] == (1.0, 2.0, "Ana", "Tom & I", None)
    assert [x[4] for x in got["b.vtt"]] == [None, "empty_text", "several_timings"]
    assert got["a.json"] == [(0.0, 1.5, None, "hi", None), (2.0, 3.0, None, "yo", None)]
    assert [x[4] for x in got["b.json"]] == ["text_not_string", "bounds_missing"]
    assert [x[4] for x in got["c.json"]] == ["not_json"] and [x[4] for x in got["d.json"]] == ["no_rows"]
    flags = {r.f: r.accepted for r in preflight(rows).withColumn("f", F.substring_index("path", "/", -1)).collect()}
    assert flags["a.json"] and not flags["a.srt"] and "e.srt" not in flags
    assert files(spark, str(tmp_path), "*.srt").count() == 1  # the empty file has no row


def test_ocr_log_and_form(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "t.tsv").write_text(head + '5\t1\t1\t1\t1\t1\t0\t0\t0\t0\t90\tsay\n5\t1\t1\t1\t1\t2\t0\t0\t0\t0\t30\t"hi\n4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t\n5\t1\t1\t1\t2\t1\t0\t0\t0\t0\t-1\tno\n')
    assert [(r.text, r.confidence, r.low) for r in ocr_lines(spark, str(tmp_path / "t.tsv")).collect()] == [('say "hi', 60.0, True)]
    logs = spark.createDataFrame([("a", "Duration: 00:01:02.50, x\nsilence_start: -0.1\nsilence_end: 2.5 | \nsilence_start: 60"), ("b", None)], "path string, raw string")
    assert [tuple(r) for r in silences(logs).collect()] == [("a", 0.0, 2.5)]
    assert {r.path: r.seconds for r in duration(logs).collect()} == {"a": 62.5, "b": None}
    forms = spark.createDataFrame([(1, "### A\n x \n\n### B\ny"), (2, "### A\nx"), (3, "### A\nx\n### A\ny"), (4, None)], "id int, body string")
    got = {r.id: (r.fields, r.accepted) for r in form_fields(forms, ["B", "A"]).collect()}
    assert got[1] == ({"A": "x", "B": "y"}, True) and not got[2][1] and got[3] == (None, False) and not got[4][1]


def test_parts_round_trip_and_damage(spark):
    recs = spark.createDataFrame([("a", bytearray(range(256)) * 5), ("b", bytearray(b"")), ("c", bytearray(b"x" * 100))], "id string, content binary")
    parts = to_parts(recs, 100).cache()
    whole = {r.id: (bytes(r.content), r.problem) for r in from_parts(parts).collect()}
    assert whole == {"a": (bytes(range(256)) * 5, None), "b": (b"", None), "c": (b"x" * 100, None)}
    assert parts.where("id = 'a'").count() == 13
    bad = parts.where("id <> 'a' or part <> 3").withColumn("content", F.when(F.col("id") == "c", F.lit(b"y")).otherwise(F.col("content")))
    assert {r.id: r.problem for r in from_parts(bad).collect()} == {"a": "missing_part", "b": None, "c": "part_digest"}
    assert {r.id: r.problem for r in from_parts(parts, 5).collect()}["a"] == "too_many"


def test_numbered_records_and_strict_json(spark, tmp_path):
    for n, t in {"issue-1.json": '{"provenance": {"issue": 1}}', "issue-2.json": '{"provenance": {"issue": 3}}', "x.json": "{}", "issue-4.json": '{"a": NaN}'}.items():
        (tmp_path / n).write_text(t)
    got = {r.path.rsplit("/", 1)[1]: r.problem for r in numbered_records(spark, str(tmp_path)).collect()}
    assert got == {"issue-1.json": None, "issue-2.json": "number_differs", "x.json": "not_named", "issue-4.json": "not_json"}
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), (None,)], "t string")
    assert [r[0] for r in df.select(strict_json("t")).collect()] == [True, False, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 2, "two"), ("a", 0, 1, "one"), ("b", 0, 1, None)], "k string, part int, n int, line string")
    assert [tuple(r) for r in documents_of_lines(df, "k", "part", ["n"]).collect()] == [("a", 0, "one\ntwo")]
    p = str(tmp_path / "t")
    create_only(df, p)
    with pytest.raises(Exception):
        create_only(df, p)
    archive(df, str(tmp_path / "z"), ["k"])
    assert spark.read.json(str(tmp_path / "z")).count() == 3
    s = str(tmp_path / "s")
    first = store_new(df, ["k", "n"], s, "doc").count()
    store_new(df.unionByName(df.withColumn("n", F.col("n") + 5)), ["k", "n"], s, "doc")
    assert first == 3 and spark.read.parquet(s).count() == 6
