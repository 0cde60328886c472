"""Sentence units of documents in any language (problem 8).

The text is scanned once for signs that may matter: end marks, quotes, brackets, line breaks and, in Thai, blanks. Quotes and brackets
are matched first, so that nothing inside one is cut and unpaired signs change nothing. The gaps that are left are classified in two ways.

* Spaced scripts: the full stops of a paragraph form a lattice. Each can be read as the end of a sentence, as part of an abbreviation, initial,
  number or name, or as the point of an item number or ordinal; what each reading costs follows from the word before and what
  comes after, and stops that follow each other directly (p. ex., J. R., 1. 2.) also pay for how their readings go together. The cheapest path counts.
* Spaceless scripts: the stretches between signs are read as words by the lattice of ``wordlattice``. A quotation that closed on an end mark goes on
  if the word after it is a quotative particle; a gap between a final particle or polite ending and an opening word ends a
  unit even without an end mark.

Positions count code points. Invisible signs are looked through; look-alike letters are read as what they look like.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa

from talklake.llm.lookalike import transducer
from talklake.llm.wordlattice import lattice

# End marks; the last five always end a sentence, the full stop only in some places.
STOPS = ".．"
MARKS = "!?！？。｡।॥؟۔"
ELLIPSIS = "…"
PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "【": "】", "‘": "’"}
CLOSERS = frozenset(PAIRS.values())
COMMAS = ",，、،"
# Abbreviations after which a sentence cannot end.
OPEN_ABBREVIATIONS = set(
    "dr mr mrs ms prof rev hon gen col sgt capt st vs i.e e.g approx dept est "
    "z.b d.h u.a bzw ca vgl evtl ggf inkl hr fr "
    "p.ex env mme mlle mm me cf "
    "sr sra srta dra d.ª p.ej "
    "т.е т.к им ул см "
    "डॉ श्री".split()
)
# Abbreviations that need a number after them, else they are words.
NUMBER_ABBREVIATIONS = set("no nr fig sec vol pp p pág págs art ch nos стр рис гл № к".split())
# Abbreviations that may also end a sentence; what follows decides.
EITHER_ABBREVIATIONS = set(
    "etc a.m p.m u.s u.k u.s.a e.u inc ltd co jr sr min sec hrs hr usw u.s.w std mio "
    "a.m p.m ee.uu aprox h мин г гг в вв т.д т.п др руб тыс сек ч n.chr v.chr".split()
)
# German months, before which a number with a full stop is an ordinal.
MONTHS = set("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Abbreviations that stand before a name, a number or a date; before a word that opens sentences they end one.
NAME_ABBREVIATIONS = set(
    "gov sen rep pres supt lt cmdr adm mt ft ave av blvd rd sq bd pl jan feb mar apr jun jul aug sep sept oct nov dec "
    "abb abs kap bsp tab taf str abt bl chap ill tel ed eds eq ref cap av.da trad núm cía стр рис табл проф акад гр".split()
)
# Words that open sentences, by language; a name does not look like one of them.
OPENERS = set(
    "the a an this that these those then there he she it we they i you his her its our their in on at after before when while but and or so if as for from what who why how no yes "
    "der die das ein eine dann er sie es wir ich ihr im in am auf nach vor wenn aber und oder so als für was wer warum wie kein dort danach dieser diese "
    "le la les un une puis il elle on nous je vous ils elles ce cette ces dans sur après avant quand mais et ou si comme pour que qui pourquoi en au "
    "el los las una luego él ella nosotros yo ellos este esta en sobre después antes cuando pero y o si como para qué quién por al "
    "o a os as um uma depois ele ela nós eu eles no na "
    "и а но он она оно мы я вы они это этот эта в на после до когда если как для что кто почему там потом тогда".split()
)
_ROMAN = re.compile(r"[IVXLC]+\b")
_VOWELS = frozenset("aeiouyäöüàáâãåæèéêëìíîïòóôõøùúûýœаеёиоуыэюя")
_STRETCH = re.compile(r"[฀-๿]+|[ぁ-ヿㇰ-ㇿ㐀-鿿豈-﫿々〆]+")

_EVENT_CHARS = STOPS + MARKS + ELLIPSIS + "".join(PAIRS) + "".join(CLOSERS) + '"\n\r\u2028\u2029\x0b\x0c\x85'
_EVENTS = re.compile("[" + re.escape(_EVENT_CHARS).replace("’", "") + "]")
_THAI = "ก-ฺเ-๎"
_HAS_THAI = re.compile(f"[{_THAI}]")
_THAI_GAP = re.compile(f"(?<=[{_THAI}])[^\\S\n\r\u2028\u2029\x0b\x0c\x85]+(?=[{_THAI}])")
_BREAKS = "\n\r\u2028\u2029\x0b\x0c\x85"
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")
_RUN = re.compile("[" + re.escape(STOPS + MARKS + ELLIPSIS) + "]+")
_BLANK_LINE = re.compile(r"(?:\r\n|[\n\r\u2028\u2029\x0b\x0c\x85])[^\S\n\r\u2028\u2029\x0b\x0c\x85]*(?:[\n\r\u2028\u2029\x0b\x0c\x85])\s*")
_WORD_EDGES = frozenset("“”„«»「」『』（）()[]\"…")
_NOT_BLANK = re.compile(r"\S")
_WORD = re.compile(r"\w+")
_LINES = re.compile(r"[^\n\r\u2028\u2029\x0b\x0c\x85]+")

#: Readings of a full stop.
END, PART, ITEM = range(3)
_NEVER = 1_000


def _word_before(text: str, floor: int, at: int) -> str:
    """The signs without blank, quote or bracket that end at ``at``, back to ``floor`` at most."""
    begin = at
    while begin > floor and not ((c := text[begin - 1]).isspace() or c in _WORD_EDGES):
        begin -= 1
    return text[begin:at]


def _read_as_seen(word: str) -> str:
    return word if word.isascii() else transducer().apply(word)


class _Stop:
    """One full stop: what comes after it, whatever is before."""

    __slots__ = ("after", "at", "first", "following", "limit", "pos", "spaced", "stop", "text")

    def __init__(self, text: str, at: int, stop: int, limit: int) -> None:
        self.text, self.at, self.stop, self.limit = text, at, stop, limit
        m = _NOT_BLANK.search(text, stop, limit)
        self.pos = m.start() if m else limit
        self.spaced = self.pos > stop
        first = m[0] if m else ""
        self.first = first if first.isascii() else transducer().apply(first)[:1] or first
        self.after = text[self.pos + 1 : min(self.pos + 2, limit)]

    def next_word(self) -> str:
        m = _WORD.match(self.text, self.pos, self.limit)
        return m[0] if m else ""

    def names(self, lowered: set[str] | None) -> bool:
        """Whether a name or a number follows rather than a new sentence: no word of the text opens a sentence with it."""
        if self.first.isdigit() or _ROMAN.match(self.text, self.pos, self.limit):
            return True
        word = self.next_word().lower()
        return self.first.isupper() and word not in OPENERS and word not in (_lowered(self.text) if lowered is None else lowered)


_LOWER_WORD = re.compile(r"(?<!\w)[^\W\d_]\w*")
_last_lowered: tuple[str, set[str]] = ("", set())


def _lowered(text: str) -> set[str]:
    """Words that the text has in lower case; kept for the text last asked for."""
    global _last_lowered
    if _last_lowered[0] is not text:
        _last_lowered = (text, {w for w in _LOWER_WORD.findall(text) if w[0].islower()})
    return _last_lowered[1]


def _costs(s: _Stop, word: str, prior: str | None, fresh: bool) -> tuple[int, int, int]:
    """What the readings of a stop cost. ``word`` stands before it, ``prior`` before that if only a stop read as a part lies between;
    ``fresh`` is whether the unit begins with the word."""
    end, part = (0, 20, _NEVER), (20, 0, _NEVER)
    first = s.first
    if not first:
        return end
    if not word:
        return end if s.spaced and s.at and s.text[s.at - 1] != " " else part
    word = _read_as_seen(word)
    if first in COMMAS:
        return part
    last, low = word[-1], word.lower()
    if not s.spaced:
        # A missing blank: only a whole word before and a capitalised word or an opening sign after tell the end of a sentence.
        opens = first in PAIRS or first in "¿¡" or first.isupper() and (s.after.islower() or s.after.isspace() or s.after in "’'")
        if not opens:
            return part
        if last.isdigit():
            return end if first.isupper() and s.after.islower() else part
        if len(word) < 2 or "." in word:
            return part
    digit = first.isdigit()
    either = part if first.islower() or digit else end
    if low in OPEN_READ:
        return part
    if low in NUMBER_ABBREVIATIONS and (digit or _ROMAN.match(s.text, s.pos, s.limit)):
        return part
    name = low.lstrip("([{«“„\"'¿¡-")
    if name.isalpha() and not "぀" <= name[0] <= "鿿":
        if prior is not None:  # perhaps the last part of an abbreviation that is written with blanks
            pair = f"{prior}.{name}"
            if pair in OPEN_READ:
                return part
            if pair in EITHER_READ:
                return either
        if len(name) == 1 and (last.isupper() or name not in EITHER_READ):
            return part  # an initial
    if low in EITHER_READ:
        return either
    if s.spaced and (name in NAME_READ or len(name) > 1 and name.isalpha() and last.islower() and word.lstrip("([{«“„\"'¿¡-")[0].isupper() and _VOWELS.isdisjoint(name)):
        return part if first.islower() or s.names(None) else end
    if last.isdigit() and word.lstrip("([{«“„\"'").isdigit():
        if fresh or first.isupper() and _read_as_seen(s.next_word()).capitalize() in MONTHS:
            return (20, 20, 0)
        return (0, 20, 10)
    return end


def _ends(text: str, start: int, limit: int, items: list[tuple[int, int]]) -> list[int]:
    """Ends of units of text[start:limit]. ``items`` are (position, end) of single full stops, and (-1, end) where a unit ends in any case."""
    out, floor, n = [], start, 0
    while n < len(items):
        at, stop = items[n]
        if at < 0:
            out.append(stop)
            floor, n = stop, n + 1
            continue
        # The stops that follow each other directly are read together; the others do not depend on each other.
        chain, words = [_Stop(text, at, stop, limit)], [_word_before(text, floor, at)]
        n += 1
        while n < len(items) and items[n][0] >= 0:
            tail = _word_before(text, stop, items[n][0])
            m = _NOT_BLANK.search(text, stop, limit)
            if m is not None and m.start() < items[n][0] - len(tail):
                break
            at, stop = items[n]
            chain.append(_Stop(text, at, stop, limit))
            words.append(tail)
            n += 1
        begin = chain[0].at - len(words[0])
        m = _NOT_BLANK.search(text, floor, limit)
        fresh = m is None or m.start() >= begin
        path = _cheapest(chain, words, fresh)
        for s, reading in zip(chain, path, strict=True):
            if reading == END:
                out.append(s.stop)
                floor = s.stop
    return out


def _cheapest(chain: list[_Stop], words: list[str], fresh: bool) -> list[int]:
    """The cheapest readings of stops that follow each other directly; of equally cheap ones the end of a sentence first."""
    costs = _costs(chain[0], words[0], None, fresh)
    if len(chain) == 1:
        return [costs.index(min(costs))]
    ways = [[(c, -1) for c in costs]]
    for k in range(1, len(chain)):
        s, now = chain[k], []
        prior = _read_as_seen(words[k - 1].lstrip("([{«“„\"'¿¡-")).lower()
        glued = chain[k - 1].stop == s.at - len(words[k])
        whole = words[k]
        if glued:  # the word goes back over the stop, if that is not an end
            j = k - 1
            whole = words[j] + s.text[chain[j].at : s.at]
            while j and chain[j - 1].stop == chain[j].at - len(words[j]):
                j -= 1
                whole = words[j] + s.text[chain[j].at : s.at]
        after_end, after_part = _costs(s, words[k], None, True), _costs(s, whole, None if glued else prior, False)
        for reading in range(3):
            now.append(min((ways[-1][r][0] + (after_end if r == END else after_part)[reading], r) for r in range(3)))
        ways.append(now)
    reading = min(range(3), key=lambda r: (ways[-1][r][0], r))
    path = [reading]
    for way in reversed(ways[1:]):
        path.append(way[path[-1]][1])
    return path[::-1]


# Abbreviations are read as they look, so they are compared in the consistent form.
def _read(words: set[str]) -> frozenset[str]:
    apply = transducer().apply
    return frozenset(words | {".".join(apply(x) for x in w.split(".")) for w in words})


EITHER_READ: frozenset[str] = frozenset()
OPEN_READ: frozenset[str] = frozenset()
NAME_READ: frozenset[str] = frozenset()


def _prepare() -> None:
    global EITHER_READ, OPEN_READ, NAME_READ
    if not EITHER_READ:
        EITHER_READ, OPEN_READ, NAME_READ = _read(EITHER_ABBREVIATIONS), _read(OPEN_ABBREVIATIONS), _read(NAME_ABBREVIATIONS)


def _goes_on_after_quote(text: str, at: int, limit: int) -> bool:
    """Whether the unit continues with what follows a quotation or bracket that closed on an end mark."""
    m = _NOT_BLANK.search(text, at, limit)
    if not m:
        return False
    ch = m[0]
    if ch in COMMAS or ch.islower() or ch in STOPS or ch in MARKS or ch in ELLIPSIS:
        return True
    stretch = _STRETCH.match(text, m.start(), limit)
    return stretch is not None and lattice().opens_with_quotative(stretch[0])


def _matched(text: str, signs: list[int]) -> dict[int, bool]:
    """Of the quote and bracket positions of one paragraph, those that pair: position -> opens?"""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}
    pairs: dict[int, bool] = {}
    for p in signs:
        ch = text[p]
        if waiting.get(ch):
            while True:
                closer, q = stack.pop()
                waiting[closer] -= 1
                if closer == ch:
                    break
            pairs[q], pairs[p] = True, False
        elif ch == '"' or ch in PAIRS:
            closer = '"' if ch == '"' else PAIRS[ch]
            stack.append((closer, p))
            waiting[closer] = waiting.get(closer, 0) + 1
    return pairs


def _closes_on_end(text: str, start: int, p: int) -> bool:
    """Whether the last sign before a closing one at ``p`` is an end mark."""
    q = p
    while q > start and text[q - 1].isspace():
        q -= 1
    if q <= start:
        return False
    last, before = text[q - 1], text[q - 2] if q - 1 > start else ""
    return last in MARKS or last in STOPS and (not before or before not in STOPS and before != "…")


def _paragraph(text: str, start: int, end: int, events: list[int], out: list[tuple[int, int]], pairs: dict[int, bool]) -> None:
    """Cuts text[start:end], whose event positions and pairs of quotes and brackets are given, into units."""
    items: list[tuple[int, int]] = []
    depth, done = 0, start
    for p in events:
        if p < done:
            continue
        ch = text[p]
        if ch in MARKS or ch in STOPS or ch == "…":
            stop = _RUN.match(text, p, end).end()
            done = stop
            if depth:
                continue
            run = text[p:stop]
            if len(run) == 1 and ch in STOPS:
                items.append((p, stop))
            elif any(c in MARKS for c in run):
                nxt = text[stop : stop + 1] if stop < end else ""
                if nxt and nxt in COMMAS:
                    cut = False
                elif run[-1] in "!?.":
                    cut = not nxt or nxt.isspace() or nxt.isupper() or nxt in PAIRS or nxt in "\"¿¡" or ord(nxt) >= 0x0900 and nxt.isalpha()
                    if cut and nxt.isspace():
                        m = _NOT_BLANK.search(text, stop, end)
                        cut = not m or m[0] not in COMMAS
                else:
                    cut = True
                if cut:
                    items.append((-1, stop))
        elif p in pairs:
            depth += 1 if pairs[p] else -1
            if depth == 0 and not pairs[p] and _closes_on_end(text, start, p) and not _goes_on_after_quote(text, p + 1, end):
                items.append((-1, p + 1))
    begin = start
    for cut in _ends(text, start, end, items):
        out.append((begin, cut))
        begin = cut
    if begin < end:
        out.append((begin, end))


class _Inside:
    """Whether a position lies inside a quotation or bracket."""

    def __init__(self, pairs: dict[int, bool]) -> None:
        self._at = sorted(pairs)
        self._depth, depth = [0], 0
        for p in self._at:
            depth += 1 if pairs[p] else -1
            self._depth.append(depth)

    def __call__(self, at: int) -> bool:
        return self._depth[bisect_left(self._at, at)] > 0


def _spaceless_cuts(text: str, spans: list[tuple[int, int]], pairs: dict[int, bool], thai: bool) -> list[tuple[int, int]]:
    """Units cut once more: at blanks between Thai letters, and at gaps of spaceless stretches that end a sentence."""
    inside, out = _Inside(pairs), []
    for s, e in spans:
        cuts = [(m.start(), m.end()) for m in _THAI_GAP.finditer(text, s, e)] if thai else []
        for m in _STRETCH.finditer(text, s, e):
            cuts += [(m.start() + c, m.start() + c) for c in lattice().ends(m[0])]
        begin = s
        for a, b in sorted(cuts):
            if not inside(a):
                out.append((begin, a))
                begin = b
        out.append((begin, e))
    return out


def sentence_units(text: str | None, kind: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of the units in order. Null, empty and blank texts have none; for captions each line is one."""
    if not text:
        return []
    _prepare()
    if kind == "captions":
        raw = [m.span() for m in _LINES.finditer(text)]
        return _trim(text, raw)
    if _UNSEEN.search(text):
        keep = [i for i, c in enumerate(text) if not _UNSEEN.match(c)]
        units = sentence_units("".join([text[i] for i in keep]), kind)
        return [(keep[s], keep[e - 1] + 1) for s, e in units]
    out: list[tuple[int, int]] = []
    thai = _HAS_THAI.search(text) is not None
    words = lattice().may_end(text)
    events: list[int] = []
    start = skip = 0
    for m in _EVENTS.finditer(text):
        p = m.start()
        if p < skip:
            continue
        if text[p] not in _BREAKS:
            events.append(p)
            continue
        gap = _BLANK_LINE.match(text, p)
        if gap is None:
            continue
        _finish(text, start, p, events, out, thai, words)
        start = skip = gap.end()
        events = []
    _finish(text, start, len(text), events, out, thai, words)
    return _trim(text, out)


def _finish(text: str, start: int, end: int, events: list[int], out: list[tuple[int, int]], thai: bool, words: bool) -> None:
    if start >= end:
        return
    if not events and not thai and not words:
        out.append((start, end))
        return
    signs = [p for p in events if text[p] not in STOPS and text[p] not in MARKS and text[p] != "…"]
    pairs = _matched(text, signs) if signs else {}
    found: list[tuple[int, int]] = []
    _paragraph(text, start, end, events, found, pairs)
    out += _spaceless_cuts(text, found, pairs, thai) if thai or words else found


def _trim(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without blanks at their ends; spans of blanks only vanish."""
    out = []
    for s, e in spans:
        if s < e and (text[s].isspace() or text[e - 1].isspace()):
            part = text[s:e]
            left = part.lstrip()
            s = e - len(left)
            e = s + len(left.rstrip())
        if e > s:
            out.append((s, e))
    return out


UNIT_SCHEMA = "doc_id long, start_pos long, end_pos long"
TEXT_SCHEMA = "doc_id long, unit int, start_pos long, end_pos long, text string"


def unit_batches(batches: Iterator[pa.RecordBatch], texts: bool = False) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (doc_id, text, kind) batches to one row per unit, with its number and text if asked for."""
    for batch in batches:
        ids, numbers, starts, ends, parts = [], [], [], [], []
        for doc, text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            units = sentence_units(text, kind)
            if units:
                ids += [doc] * len(units)
                s, e = zip(*units, strict=True)
                starts += s
                ends += e
                if texts:
                    numbers += range(len(units))
                    parts += [text[a:b] for a, b in units]
        columns = {"doc_id": pa.array(ids, pa.int64())}
        if texts:
            columns["unit"] = pa.array(numbers, pa.int32())
        columns |= {"start_pos": pa.array(starts, pa.int64()), "end_pos": pa.array(ends, pa.int64())}
        if texts:
            columns["text"] = pa.array(parts, pa.string())
        yield pa.RecordBatch.from_pydict(columns)
