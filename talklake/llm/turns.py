"""Speech transcripts into clean speaker turns (problem 1).

A row is read by a finite-state line parser: at its head clock marks, sound notes, hesitations and one speaker label may
stand in any order; the rest is what was said. Labels are resolved against the speakers of the episode.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talklake.llm.lookalike import transducer
from talklake.operators.runs import mark_runs
from talklake.runtime import ensure_checkpoint_dir, millis

# Words that stand for "speaker" before a number.
SPEAKER_WORDS = set("speaker spkr spk s sp sprecher locuteur orador hablante voice talker 说话人 發言人 发言人 讲话人 話者 спикер วิทยากร वक्ता".split())
# Words for a role.
ROLE_WORDS = {
    "host": "host moderator moderatorin presenter anchor 主持人 主播 司会 司会者 ホスト ведущий ведущая présentateur présentatrice animateur animatrice presentador presentadora".split(),
    "guest": "guest gast 嘉宾 来宾 ゲスト гость гостья invité invitée invitado invitada".split(),
    "expert": "expert experte expertin 专家 専門家 эксперт experta experto".split(),
}
# Labels that name nobody.
NOBODY = {"", "unknown", "none", "null", "nan", "n/a", "?", "??", "-"}
# Hesitation sounds (a final letter may be drawn out).
HESITATIONS = "uh+m* um+ uhm+ er+m* erm+ hm+ mm+ mhm ah+ eh+ äh+m* ähm+ öhm* euh+ ehm+ эм+ э+ хм+ 呃+ 嗯+ 啊+ 唔 えっと えーっと えーと えー+ えと あのー+ あの うーん+ うー+ んー+ まあ".split()

_FILLER_WORDS = "|".join(HESITATIONS)
_STANDS_ALONE = r"(?=$|[\s,.，。、…!?！？;；:：\-–—♪\[\(（【{<*])"
_FILLER = re.compile(rf"(?<![^\W_])(?:{_FILLER_WORDS}){_STANDS_ALONE}[,.，。、…]*", re.I)
_TIME = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_BARE_CLOCK = re.compile(rf"@?{_TIME}(?:\s*-->\s*{_TIME})?(?![\d:])|(?:\d+(?:时|小时|時間))?\d+分\d+秒")
_BOXED_CLOCK = re.compile(rf"[\[(<（【]\s*{_TIME}(?:\s*-->\s*{_TIME})?\s*[\])>）】]")
_NOTE = re.compile(r"\[[^\[\]]*\]|【[^【】]*】|\{[^{}]*\}|<[^<>]*>|\*[^*\n]{1,60}\*|[♪♫♬♩]+")
_ROUND = re.compile(r"\(([^()]*)\)|（([^（）]*)）")
_LABEL = re.compile(r"\s*([^:：\n]{1,60}?)\s*(?:[:：]|\s[-–—]\s)")
_BOXED_LABEL = re.compile(r"\s*[\[【]([^\[\]【】\n]{1,60})[\]】]\s*[:：]?")
_JOINT = re.compile(r"[\s\-–—,，.。、…:：]+")
_HEAD = re.compile(r"\A[\s\u00ad\u034f\u200b-\u200f\u2060\ufeff]+")
_SAID = re.compile(r"[^\W_]")
_NUMBERED = re.compile(r"([^\W\d_]+)[\s_\-.#]*0*(\d+)")
_LETTERS = re.compile(r"[^\W\d_]")


def _note_in_round(content: str) -> bool:
    """Whether round brackets hold a sound note: a few words without an end mark."""
    return not re.search(r"[.!?。！？।]", content) and (len(content.split()) <= 3 if content.isascii() else len(content) <= 8)


def _near(a: str, b: str, most: int) -> bool:
    """Whether b becomes a by at most ``most`` insertions, deletions, substitutions or swaps of neighbours."""
    if abs(len(a) - len(b)) > most:
        return False
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return one[-1] <= most


class Roster:
    """The speakers of one episode; ``find`` gives the id of the one that a label can only mean, else ''."""

    def __init__(self, speakers: list[dict]) -> None:
        self.rows = [(s.get("id") or "", self._plain(s.get("name")), self._plain(s.get("role")), self._plain(s.get("source_label"))) for s in speakers]
        self.numbers: dict[tuple[str, int], set[str]] = {}
        for sid, _, _, label in self.rows:
            for text in (self._plain(sid), label):
                if m := _NUMBERED.fullmatch(text):
                    self.numbers.setdefault((m[1], int(m[2])), set()).add(sid)
        self.find = lru_cache(1 << 14)(self._find)

    @staticmethod
    def _plain(text: str | None) -> str:
        return transducer().apply(text or "").casefold()

    def _part(self, part: str) -> set[str]:
        part = part.strip(" \t:：-–—[]【】(){}<>（）\"'“”.,").strip()
        if part in NOBODY:
            return set()
        hit = {sid for sid, _, _, label in self.rows if part in (self._plain(sid), label) and part}
        if hit:
            return hit
        if m := _NUMBERED.fullmatch(part):
            word, n = m[1], int(m[2])
            hit = set(self.numbers.get((word, n), ()))
            if not hit and word in SPEAKER_WORDS:
                hit = {sid for (_, k), ids in self.numbers.items() if k == n for sid in ids}
            return hit
        hit = {sid for sid, _, role, _ in self.rows if role and (part == role or part in ROLE_WORDS.get(role, ()))}
        if hit:
            return hit
        return self._named(part)

    def _named(self, part: str) -> set[str]:
        if "," in part:
            last, _, first = part.partition(",")
            part = f"{first.strip()} {last.strip()}"
        words = part.split()
        part = " ".join(words)
        names = [(sid, name) for sid, name, _, _ in self.rows if name]
        hit = {sid for sid, name in names if part == name}
        if not hit and len(words) == 1:
            hit = {sid for sid, name in names if part in name.split()}
        if not hit and len(words) > 1 and words[0].rstrip(".") and len(words[0].rstrip(".")) == 1:
            hit = {sid for sid, name in names if name[:1] == words[0][0] and name.split()[-1] == words[-1] and len(name.split()) > 1}
        if hit:
            return hit
        if not _LETTERS.search(part) or len(part) < 5 or any("぀" <= c <= "鿿" for c in part):
            return set()
        most = 2 if len(part) >= 10 else 1
        for allowed in range(1, most + 1):
            hit = {sid for sid, name in names if _near(part, name, allowed)}
            if not hit and len(words) == 1:
                hit = {sid for sid, name in names if any(len(w) >= 5 and _near(part, w, 1) for w in name.split())}
            if hit:
                return hit
        return set()

    def _find(self, label: str) -> str:
        plain = self._plain(label).strip()
        m = re.fullmatch(r"(.+?)\s*\(([^()]+)\)\s*:?", plain)
        if m:
            found, extra = self._part(m[1]), self._part(m[2])
            if found and extra:
                # A role after the name only excludes speakers whose own role is known.
                open_role = {sid for sid, _, role, _ in self.rows if not role} if any(m[2] == r or m[2] in w for r, w in ROLE_WORDS.items()) else set()
                found = found & extra or found & open_role
        else:
            found = self._part(plain)
        return next(iter(found)) if len(found) == 1 else ""


@lru_cache(4096)
def _roster(spec: str | None) -> Roster:
    return Roster(json.loads(spec) if spec else [])


def parse_row(speaker: str | None, text: str | None, roster: Roster) -> tuple[str, str | None]:
    """(speaker_id, what was said). The id is '' if the speaker isn't known; the text is None if no word is said."""
    sid = roster.find(speaker) if speaker else ""
    if not text:
        return sid, None
    rest, labelled = text, False
    state = True
    while state and rest:  # head of the line: marks and one label in any order
        state = False
        rest = _HEAD.sub("", rest, count=1)
        if not labelled and (m := _BOXED_LABEL.match(rest)) and (who := roster.find(m[1])):
            sid, labelled, state = sid or who, True, True
            rest = rest[m.end() :]
            continue
        for pattern in (_BOXED_CLOCK, _BARE_CLOCK, _NOTE, _FILLER):
            if m := pattern.match(rest):
                rest = rest[m.end() :]
                state = True
                break
        else:
            if (m := _ROUND.match(rest)) and _note_in_round(m[1] or m[2] or ""):
                rest = rest[m.end() :]
                state = True
            elif not labelled and (m := _LABEL.match(rest)) and (who := roster.find(m[1])):
                sid, labelled, state = sid or who, True, True
                rest = rest[m.end() :]
                continue
        if state and (m := _JOINT.match(rest)):
            rest = rest[m.end() :]
    body = _ROUND.sub(lambda m: " " if _note_in_round(m[1] or m[2] or "") else m[0], _NOTE.sub(" ", _BOXED_CLOCK.sub(" ", rest)))
    body = _FILLER.sub(" ", body)
    if not _SAID.search(body):
        return sid, None
    return sid, re.sub(r"\s+([,.!?;:，。！？；：、])", r"\1", re.sub(r"\s+", " ", body)).strip()


def said_rows(events: DataFrame, speakers: DataFrame) -> DataFrame:
    """(stream_id, id, seq, start, speaker_id, text) of the rows in which something is said.

    Only rows of type transcript.text.segment of the attempt with a transcript.text.done count (the last one if
    several have it); a redelivered row counts once. A stream without speakers has unknown speakers only.
    """
    done = events.where(F.col("type") == "transcript.text.done").groupBy("stream_id").agg(F.max("attempt").alias("attempt"))
    rows = events.where(F.col("type") == "transcript.text.segment").select("stream_id", "attempt", "seq", "id", "start", "speaker", "text")
    rows = rows.join(done, ["stream_id", "attempt"], "left_semi")
    once = rows.groupBy("stream_id", "id").agg(F.min(F.struct("seq", "start", "speaker", "text")).alias("r")).select("stream_id", "id", "r.*")
    people = speakers.select("episode_id", "id", "name", "role", "source_label").distinct()
    rosters = people.groupBy(F.col("episode_id").alias("stream_id")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "name", "role", "source_label")))).alias("roster"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, said = [], []
            for speaker, text, spec in zip(b["speaker"], b["text"], b["roster"], strict=True):
                sid, what = parse_row(speaker if isinstance(speaker, str) else None, text if isinstance(text, str) else None, _roster(spec if isinstance(spec, str) else None))
                ids.append(sid)
                said.append(what)
            out = b[["stream_id", "id", "seq", "start"]].assign(speaker_id=ids, text=said)
            yield out[out["text"].notna()]

    return once.join(rosters, "stream_id", "left").mapInPandas(parse, "stream_id string, id string, seq int, start double, speaker_id string, text string")


#: Length of a time shard; a run is first merged inside its shards.
SHARD_MS = 600_000


def speaker_turns(events: DataFrame, speakers: DataFrame) -> DataFrame:
    """(stream_id, first_id, last_id, speaker_id, start, part, text): turns in order of start, with what was said.

    The text of a turn comes in parts, one per time shard, so that an endless turn does not become one
    endless text; part 0 is the first. A turn whose speaker isn't known is one row with speaker_id ''.
    Ties in start are ordered by seq, then id; rows without a start come last.
    """
    rows = said_rows(events, speakers).withColumns(
        {"_t": F.coalesce(millis("start"), F.lit(2**62)), "_who": F.when(F.col("speaker_id") != "", F.col("speaker_id"))}
    )
    ensure_checkpoint_dir(events.sparkSession)
    rows = rows.checkpoint()  # read several times, parsed once
    shard = F.floor(F.col("_t") / F.lit(SHARD_MS)).cast("long")
    marked = mark_runs(rows, ["stream_id"], shard, ["_t", "seq", "id"], "_who")
    at = F.struct("_t", "seq", "id")
    parts = marked.groupBy("stream_id", "run_shard", "run_no", F.floor(F.col("_t") / F.lit(SHARD_MS)).cast("long").alias("_s")).agg(
        F.min(F.struct("_t", "seq", "id", "start")).alias("a"), F.max(at).alias("b"), F.first("speaker_id").alias("speaker_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", "seq", "id", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    turns = turn_bounds(marked)
    return parts.join(turns, ["stream_id", "run_shard", "run_no"]).select(
        "stream_id", "first_id", "last_id", parts.speaker_id, F.col("a.start").alias("start"), (F.col("_s") - F.col("run_shard")).cast("int").alias("part"), "text"
    )


def turn_bounds(marked: DataFrame) -> DataFrame:
    """(stream_id, run_shard, run_no, first_id, last_id, speaker_id) of marked rows."""
    at = F.struct("_t", "seq", "id")
    return marked.groupBy("stream_id", "run_shard", "run_no").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.min("speaker_id").alias("speaker_id")).select(
        "stream_id", "run_shard", "run_no", F.col("a.id").alias("first_id"), F.col("b.id").alias("last_id"), "speaker_id"
    )


def found_turns(events: DataFrame, speakers: DataFrame) -> DataFrame:
    """(stream_id, first_id, last_id, speaker_id), one row per turn."""
    rows = said_rows(events, speakers).select(
        "stream_id", "id", "seq", "speaker_id", F.coalesce(millis("start"), F.lit(2**62)).alias("_t"), F.when(F.col("speaker_id") != "", F.col("speaker_id")).alias("_who")
    )
    ensure_checkpoint_dir(events.sparkSession)
    rows = rows.checkpoint()  # read several times, parsed once
    shard = F.floor(F.col("_t") / F.lit(SHARD_MS)).cast("long")
    return turn_bounds(mark_runs(rows, ["stream_id"], shard, ["_t", "seq", "id"], "_who")).select("stream_id", "first_id", "last_id", "speaker_id")
