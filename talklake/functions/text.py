"""Text functions on columns. Built-in expressions unless the meaning has none; then one Arrow batch function."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks that formatting may add or drop without changing what is said.
FORMAT_MARKS = "，,。.!！?？;；:：“”\"'‘’()（）[]【】《》〈〉…—、"
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: str | Column) -> Column:
    """Without blanks of any kind at both ends (the built-in trim knows the plain space only)."""
    return F.regexp_replace(_c(col), rf"^{_BLANK}+|{_BLANK}+$", "")


def collapse(col: str | Column) -> Column:
    """Every run of blanks as one space, none at the ends."""
    return strip(F.regexp_replace(_c(col), rf"{_BLANK}+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(col: str | Column) -> Column:
    """Unicode compatibility form; null stays null."""
    return _nfkc(_c(col))


_SEPARATORS = re.compile("[" + re.escape(FORMAT_MARKS) + r"\s]+")


def _between(m: re.Match) -> str:
    """What stays of a run of separators: between two digits its marks, or one space if it has none."""
    text, s, e = m.string, m.start(), m.end()
    if s and e < len(text) and text[s - 1].isdigit() and text[e].isdigit():
        return "".join(m[0].split()) or " "
    return ""


@F.pandas_udf(T.StringType())
def _compared(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _SEPARATORS.sub(_between, unicodedata.normalize("NFKC", t)))


def comparison_text(col: str | Column) -> Column:
    """Text for comparing wordings: compatibility form without blanks and format marks.

    Between two digits a separator is kept (1.5 is not 15), and blanks alone become one space.
    """
    return _compared(_c(col))


def alphanumeric(col: str | Column) -> Column:
    """Letters and digits of the compatibility form."""
    return F.regexp_replace(nfkc(col), r"[^\p{L}\p{N}]", "")


def language(col: str | Column) -> Column:
    """Short language name: no prefix of machine tracks, no region, three-letter names shortened; blank is null."""
    low = F.regexp_replace(F.replace(F.lower(_c(col)), F.lit("_"), F.lit("-")), "^ai-", "")
    base = F.substring_index(low, "-", 1)
    short = F.when(base.isin("cmn", "zho", "chi"), "zh").when(base == "eng", "en").otherwise(base)
    return F.when(F.length(strip(col)) > 0, short)


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def name_key(col: str | Column) -> Column:
    """Key under which names are the same: compatibility form, blanks collapsed, case folded."""
    return _casefold(_c(col))


def slug(col: str | Column, digits: int = 8, longest: int = 60) -> Column:
    """Identifier of a title: letters, digits and hyphens, with the start of its digest."""
    base = F.regexp_replace(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", F.when(base != "", F.left(base, F.lit(longest))), F.left(F.sha2(_c(col), 256), F.lit(digits)))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def unescape_html(col: str | Column) -> Column:
    """Entities as the signs they stand for."""
    return _unescape(_c(col))


def escape_html(col: str | Column) -> Column:
    """Text that is safe inside HTML."""
    out = _c(col)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_markdown(col: str | Column) -> Column:
    """Text without meaning in Markdown."""
    out = _c(col)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"([\\`*_\[\]#])", r"\\$1")


def strip_tags(col: str | Column) -> Column:
    """Without markup tags."""
    return F.regexp_replace(_c(col), "<[^>]+>", "")


def voice(col: str | Column) -> Column:
    """Speaker of a caption's voice tag, or null."""
    found = F.regexp_extract(_c(col), r"<v(?:\.[^ >]+)?\s+([^>]+)>", 1)
    return F.when(found != "", found)


@F.pandas_udf(T.StringType())
def _quoted(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else quote(t, safe=":/?#[]@!$&'*+,;=%-._~"))


def safe_url(col: str | Column) -> Column:
    """The address, quoted, if it is http or https with a host, else the empty string."""
    good = F.coalesce(F.try_parse_url(strip(col), F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(strip(col), F.lit("HOST")).isNotNull(), F.lit(False))
    return F.when(good, _quoted(strip(col))).otherwise("")


def strict_url(col: str | Column) -> Column:
    """Whether an address is http or https with a host, without user, backslash or blank."""
    c = _c(col)
    return F.coalesce(
        F.try_parse_url(c, F.lit("PROTOCOL")).isin("http", "https")
        & F.try_parse_url(c, F.lit("HOST")).isNotNull()
        & F.try_parse_url(c, F.lit("USERINFO")).isNull()
        & ~c.rlike(r"[\\\s]"),
        F.lit(False),
    )


def clock(col: str | Column) -> Column:
    """Whole seconds as HH:MM:SS; null and values that are not finite or negative count as 0."""
    s = seconds(col)
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("long")
    return F.concat(F.when(hours < 10, pad(hours)).otherwise(hours.cast("string")), F.lit(":"), pad(F.floor(s % 3600 / 60).cast("long")), F.lit(":"), pad(s % 60))


def short_clock(col: str | Column) -> Column:
    """Whole seconds as MM:SS, or H:MM:SS from an hour on."""
    s = seconds(col)
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    tail = F.concat(pad(F.floor(s % 3600 / 60).cast("long")), F.lit(":"), pad(s % 60))
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("long").cast("string"), F.lit(":"), tail)).otherwise(tail)


def seconds(col: str | Column) -> Column:
    """Whole seconds; 0 for null, negative and not finite values."""
    c = _c(col)
    ok = c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < F.lit(9e15))
    return F.coalesce(F.when(ok, F.floor(c).cast("long")), F.lit(0).cast("long"))


def clock_seconds(col: str | Column) -> Column:
    """A clock of any number of parts (H:M:S,mmm) in seconds; null if a part is not a number."""
    parts = F.transform(F.split(F.replace(strip(col), F.lit(","), F.lit(".")), ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)


def identifier(col: str | Column) -> Column:
    """Whether a value is an identifier of 1 to 100 letters, digits, hyphens and underscores."""
    return F.coalesce(_c(col).rlike("^[A-Za-z0-9_-]{1,100}$"), F.lit(False))


def fingerprint(*cols: str | Column) -> Column:
    """Digest of several values; nulls are kept apart from empty strings."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def deep_link(url: str | Column, start: str | Column, host: str) -> Column:
    """The address with query value ``t`` set to whole seconds for one host and its subdomains; other addresses stay as they are."""
    u = safe_url(url)
    ours = F.coalesce(F.lower(F.try_parse_url(u, F.lit("HOST"))).rlike(r"^([a-z0-9-]+\.)*" + host.replace(".", r"\.") + "$"), F.lit(False))
    base, mark = F.split_part(u, F.lit("#"), F.lit(1)), F.when(F.contains(u, F.lit("#")), F.regexp_extract(u, "(#.*)$", 1)).otherwise("")
    path, query = F.split_part(base, F.lit("?"), F.lit(1)), F.when(F.contains(base, F.lit("?")), F.regexp_extract(base, r"\?(.*)$", 1)).otherwise("")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^t(=|$)"))
    new = F.concat(path, F.lit("?"), F.array_join(F.concat(kept, F.array(F.concat(F.lit("t="), seconds(start).cast("string")))), "&"), mark)
    return F.when(ours, new).otherwise(u)


def minutes_label(col: str | Column) -> Column:
    """Duration in whole minutes, rounded up; unknown and zero lengths give 0."""
    c = _c(col)
    ok = c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < F.lit(9e15))
    return F.coalesce(F.when(ok, F.ceil(c / 60).cast("long")), F.lit(0).cast("long"))


def date_label(col: str | Column) -> Column:
    """The day of a date text with dots; compact dates (YYYYMMDD) are read too, other texts give null."""
    c = _c(col)
    day = F.when(c.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))).otherwise(F.left(c, F.lit(10)))
    return F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.replace(day, F.lit("-"), F.lit(".")))


def has_control(col: str | Column, strict: bool = False) -> Column:
    """Whether a text has control characters; strict also finds format and surrogate characters."""
    return F.coalesce(_c(col).rlike(r"[\p{Cc}\p{Cf}\p{Cs}]" if strict else r"[\x00-\x1f\x7f]"), F.lit(False))


def version_key(col: str | Column) -> Column:
    """Array under which versions sort: the numbers of a dotted version, without zeros at the end; null if a part has no number."""
    parts = F.transform(F.split(F.regexp_replace(_c(col), "^v", ""), r"\."), lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"))
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != 0, i + 1).otherwise(0)))
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.slice(parts, 1, F.coalesce(last, F.lit(0))))
