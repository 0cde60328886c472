"""One consistent form for text that looks the same (problem 4).

A transducer over grapheme clusters, compiled once per process from Unicode data and a short list of
look-alike letters. Each cluster is rewritten by the longest matching rule in one pass over the text:

* width and presentation forms, ligatures, radicals -> the plain sign,
* base letter and accents -> the composed form, with the base letter's own rule applied,
* letters of other scripts with the same shape -> the Latin letter,
* what cannot be seen -> nothing; any run of blanks (and unseen signs in it) -> one space.

Case, accents, digits, raised and lowered signs, circled signs and fractions stay different. The rules are
checked for conflicts when compiled: one target per source, and every target is left alone by all rules.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters whose printed shape is that of a Latin letter, by script.
SAME_SHAPE = {
    "cyrillic": ("аеорсухѕіјһԁԛԝАВЕКМНОРСТХЅІЈԚԜҮ", "aeopcyxsijhdqwABEKMHOPCTXSIJQWY"),
    "greek": ("ονϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovjABEZHIKMNOPTYX"),
    "hyphens": ("‐", "-"),
}
# Compatibility characters that are only another printing of their letters.
PRESENTATION_RANGES = [(0x0132, 0x0133), (0x01C4, 0x01CC), (0x0E33, 0x0E33), (0x0EB3, 0x0EB3), (0x2024, 0x2026), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB4F)]
PRESENTATION_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}
#: Signs that must never become equal to their plain relatives.
KEPT_APART = ["²2", "³3", "₂2", "①1", "½1/2", "ıi", "№No", "–-", "—-", "’'", "“\"", "éе", "ß8", "Оo", "0O", "1l", "。."]
# Rules of the first plane and of all; classes of one plane are searched fast, so the others are used only where a text needs them.
# Beyond the second range no sign has a rule but the invisible tags below.
_FIRST_PLANE = [(0x80, 0x10000)]
_ALL_PLANES = [(0x80, 0x20000), (0x2F800, 0x2FA20)]
_TAGS = "\U000e0000-\U000e0fff"


def _blank(ch: str) -> bool:
    return ch.isspace() or unicodedata.category(ch) in ("Zs", "Zl", "Zp")


def _unseen(cp: int, cat: str) -> bool:
    if cat == "Cf":
        return not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD))
    return cat == "Cc" or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F


def _ranges(cps: list[int]) -> str:
    """Inner part of a character class."""
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(re.escape(chr(cps[i])) + ("-" + re.escape(chr(cps[j])) if j > i else ""))
        i = j + 1
    return "".join(out)


class Transducer:
    """Compiled rules; ``apply`` rewrites one text, ``apply(apply(x)) == apply(x)``."""

    def __init__(self, planes: list[tuple[int, int]] = _FIRST_PLANE) -> None:
        self._first_only = planes == _FIRST_PLANE
        self.rules: dict[str, str] = {}
        blanks, unseen, marks = [], [], []
        base: dict[str, str] = {}
        for source, target in SAME_SHAPE.values():
            for a, b in zip(source, target, strict=True):
                self._add(base, a, b)
        composed = []
        for cp in chain.from_iterable(range(a, b) for a, b in planes):
            if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xDFFF:
                continue  # ideographs and syllables have no rule
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat == "Cn":
                continue
            if _blank(ch):
                blanks.append(cp)
            elif _unseen(cp, cat):
                unseen.append(cp)
            elif cat in ("Mn", "Mc", "Me") or 0x1161 <= cp <= 0x11FF:
                marks.append(cp)  # accents, and the later letters of a Korean syllable
            elif parts := unicodedata.decomposition(ch).split():
                if parts[0] in PRESENTATION_TAGS or parts[0] == "<compat>" and any(a <= cp <= b for a, b in PRESENTATION_RANGES):
                    plain = "".join(chr(int(x, 16)) for x in parts[1:])
                    if not any(_blank(x) for x in plain):
                        self._add(base, ch, plain)
                        if all(unicodedata.combining(x) for x in plain):
                            marks.append(cp)  # a presentation form of an accent
                elif not parts[0].startswith("<"):
                    composed.append(ch)
        blanks += [*range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F, 0x20]
        unseen += [cp for cp in [*range(0x20), 0x7F] if cp not in blanks]
        self._base = base
        for ch in [*base, *composed]:
            target = self._close(ch)
            if target != ch:
                self._add(self.rules, ch, target)
        bl, ig, mk = (_ranges(sorted(x)) for x in (blanks, unseen, marks))
        other = _ranges(sorted(set(blanks) - {0x20}))
        single = _ranges(sorted(ord(c) for c in self.rules))
        # Longest cluster first: runs of blanks, a base with its accents, then single signs.
        self._single = {c: t for c, t in self.rules.items()} | {chr(c): " " for c in blanks if c != 0x20}
        self._clusters = re.compile(f"[{ig}{mk}]")
        self._tags = re.compile(f"[{_TAGS}]+")
        self._runs = re.compile(" {2,}")
        self._pattern = re.compile(f"[{bl}{ig}]{{2,}}|[^{bl}{ig}{mk}][{ig}]*[{mk}][{ig}{mk}]*|[{single}]|[{other}{ig}]")
        self._has_blank = re.compile(f"[{bl}]")
        self._ignored = re.compile(f"[{ig}]+")
        self._ascii = re.compile(r"[\x00-\x20\x7f]{2,}|[\x00-\x1f\x7f]")
        #: Signs beyond the first plane that a rule knows; a text without them needs the rules of the first plane only.
        self.beyond = frozenset(c for c in [*self.rules, *map(chr, [*blanks, *unseen, *marks])] if c > "\uffff")
        self._cluster = lru_cache(1 << 16)(self._rewrite)
        self._check()

    @staticmethod
    def _add(rules: dict[str, str], source: str, target: str) -> None:
        if rules.setdefault(source, target) != target:
            raise ValueError(f"two targets for {source!r}")

    def _close(self, cluster: str) -> str:
        """Rules applied to the parts of a cluster until nothing changes, then composed."""
        parts = unicodedata.normalize("NFD", cluster)
        while True:
            new = unicodedata.normalize("NFD", "".join(self._base.get(c, c) for c in parts))
            if new == parts:
                return unicodedata.normalize("NFC", parts)
            parts = new

    def _rewrite(self, cluster: str) -> str:
        if self._has_blank.search(cluster):
            return " "
        return self._close(self._ignored.sub("", cluster))

    def _check(self) -> None:
        for source, target in self.rules.items():
            if self._one_form(target) != target:
                raise ValueError(f"the target of {source!r} is rewritten again")
        for pair in KEPT_APART:
            if self.apply(pair[0]) == self.apply(pair[1:]):
                raise ValueError(f"{pair!r} must stay different")

    def joins(self, sign: str) -> bool:
        """Whether a sign may be part of a cluster of several: an accent or something unseen."""
        if sign > "\uffff" and self._first_only:
            return wide_transducer().joins(sign)
        return self._clusters.match(sign) is not None

    def apply(self, text: str) -> str:
        """The consistent form of ``text``."""
        if text.isascii():
            return self._ascii.sub(lambda m: " " if self._has_blank.search(m[0]) else "", text).strip(" ")
        top = max(text)
        if top >= "\U000e0000":
            text = self._tags.sub("", text)
        if top > "\uffff" and self._first_only and not wide_transducer().beyond.isdisjoint(text):
            return wide_transducer()._one_form(text)
        return self._one_form(text)

    def _one_form(self, text: str) -> str:
        """``text`` without tags by the rules of these planes."""
        if not self._clusters.search(text):
            # Every cluster is a single sign: rewrite each distinct sign that has a rule.
            for sign in self._single.keys() & set(text):
                text = text.replace(sign, self._single[sign])
            return self._runs.sub(" ", text).strip(" ")
        cluster = self._cluster
        return self._pattern.sub(lambda m: cluster(m[0]), text).strip(" ")


@lru_cache(1)
def transducer() -> Transducer:
    """The process's compiled transducer."""
    return Transducer()


@lru_cache(1)
def wide_transducer() -> Transducer:
    """The rules of all planes, for texts with a sign beyond the first that has a rule."""
    return Transducer(_ALL_PLANES)


@F.pandas_udf(T.StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    apply = transducer().apply
    return texts.map(lambda t: None if t is None else apply(t))


def consistent_text(col: str | Column) -> Column:
    """Column in the consistent form; null stays null, text of nothing visible becomes the empty string."""
    return _consistent(col)
