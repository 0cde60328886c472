"""Evaluation passages inside documents: a distributed positional inverted index (problem 7).

Both sides are read as a reader sees them (look-alike forms and case folded) and become tokens with positions:
pairs of neighbouring words, or three neighbouring letters for scripts without blanks. The index stores, for every token that
occurs in a test item, the postings (token, document, position) of all documents. Each window of an item
is looked up by its rarest tokens (counted over the whole corpus): their posting lists, shifted by the position in the item,
are intersected, and the surviving alignments are completed from the postings of the remaining tokens, which
gives the exact length of every shared passage. Proximity matches need no index: each document is swept once against the items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talklake.llm.lookalike import transducer
from talklake.runtime import ensure_checkpoint_dir

#: Words, or letters and digits, that a passage must share.
WORDS, LETTERS = 12, 25
_PAIR, _TRIPLE = 2, 3
#: Distinct item tokens held by one executor at a time; more items are looked up in blocks.
MAX_TERMS = 2_000_000
#: Tokens of a stretch of a document in which postings and alignments meet.
_STRETCH = 64
_CHARS = 1_000_000
_LIMIT = 0x20000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BLOOM_BITS = 22


class _Reader:
    """Tables that turn code points into folded letters; 0 marks what separates words."""

    def __init__(self) -> None:
        apply = transducer().apply
        table = np.zeros(_LIMIT, np.uint32)
        several: dict[str, str] = {}
        slow = []
        for cp in range(1, _LIMIT):
            if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3:
                table[cp] = cp
                continue
            if 0xD800 <= cp <= 0xDFFF:
                continue
            ch = chr(cp)
            if not ch.isalnum():
                if not ch.isspace() and transducer().joins(ch):
                    slow.append(cp)
                continue
            folded = self.fold(ch, apply)
            if len(folded) == 1:
                table[cp] = ord(folded) if folded.isalnum() else 0
            else:
                several[ch] = folded
        self.table = table
        # Signs that need the whole transducer: parts of clusters, and letters that fold to several.
        self.unusual = np.zeros(_LIMIT + 1, bool)
        self.unusual[[*slow, *map(ord, several), _LIMIT]] = True
        self.several = several
        powers = np.full(4096, _M2, np.uint64)
        powers[0] = 1
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(powers, dtype=np.uint64)

    @staticmethod
    def fold(ch: str, apply) -> str:
        """The letter without case: letters that look alike in one case are one letter."""
        upper = ch.upper()
        if ch >= "Ͱ" and len(upper) == 1 and upper.lower() == ch:
            ch = upper
        return apply(apply(ch).casefold())

    def plain(self, text: str) -> str:
        """Text in which every letter is a single sign that the table folds."""
        text = transducer().apply(text)
        for sign in self.several.keys() & set(text):
            text = text.replace(sign, self.several[sign])
        return text.replace("\0", " ")

    def encode(self, texts: list[str]) -> np.ndarray:
        """Code points of the texts, 0 between them; unusual texts are made plain first."""
        codes = _codes(texts)
        found = np.flatnonzero(self.unusual[np.minimum(codes, _LIMIT)])
        stray = np.count_nonzero(codes == 0) != len(texts) - 1
        if len(found) or stray:
            odd = range(len(texts)) if stray else np.unique(np.searchsorted(np.flatnonzero(codes == 0), found)).tolist()
            texts = list(texts)
            for i in odd:
                texts[i] = self.plain(texts[i])
            codes = _codes(texts)
        return codes


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(1)
def reader() -> _Reader:
    """The process's tables."""
    return _Reader()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def token_arrays(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(text number, position, token, letters?) of word pairs, then of letter triples."""
    r = reader()
    codes = r.encode(texts)
    folded = np.where(codes < _LIMIT, r.table[np.minimum(codes, _LIMIT - 1)], codes)
    at = np.flatnonzero(folded)
    if not len(at):
        return
    seps = np.flatnonzero(codes == 0)
    doc = np.searchsorted(seps, at)
    with np.errstate(over="ignore"):
        value = _mix(folded[at].astype(np.uint64) * _M1)
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1] + 1
        starts = np.flatnonzero(first)
        place = np.arange(len(at)) - starts[np.cumsum(first) - 1]
        words = _mix(np.add.reduceat(value * r.powers[place & 4095], starts))
        wdoc = doc[starts]
        same = wdoc[:-1] == wdoc[1:]
        pair = _mix(words[:-1] * _M1 + words[1:])
        number = np.arange(len(words)) - np.searchsorted(wdoc, wdoc)
        yield wdoc[:-1][same], number[:-1][same], pair[same].view(np.int64), False
        if len(at) >= _TRIPLE:
            same = doc[:-2] == doc[2:]
            triple = _mix(value[:-2] * _M1 + value[1:-1] * _M2 + value[2:] + _M3)
            number = np.arange(len(at)) - np.searchsorted(doc, doc)
            yield doc[:-2][same], number[:-2][same], triple[same].view(np.int64), True


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts, about a million characters at a time; null texts are left out."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not t:
                continue
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= _CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def item_tokens(items: DataFrame) -> DataFrame:
    """(item_id, pos, term, need): every token of an item; ``need`` consecutive ones make a passage."""
    spaceless = F.coalesce(F.lower("lang").rlike("^(zh|ja|zho|cmn|jpn)"), F.lit(False))
    rows = items.select("item_id", "text", spaceless.alias("letters")).where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).dropDuplicates(["item_id"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, kinds = (batch.column(k).to_pylist() for k in range(3))
            for d, pos, term, letters in token_arrays([t or "" for t in texts]):
                ok = np.array(kinds, bool)[d] == letters
                need = LETTERS - _TRIPLE + 1 if letters else WORDS - _PAIR + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(ids, np.int64)[d[ok]]), pa.array(pos[ok].astype(np.int32)), pa.array(term[ok]), pa.array(np.full(int(ok.sum()), need, np.int32))],
                    ["item_id", "pos", "term", "need"],
                )

    return rows.mapInArrow(emit, "item_id long, pos int, term long, need int")


def _finder(known: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function that gives, of an array of terms, the indexes of those that are known and their places among the known."""
    bloom = np.zeros(1 << _BLOOM_BITS, bool)
    bloom[known.view(np.uint64) >> np.uint64(64 - _BLOOM_BITS)] = True

    def hits(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(bloom[term.view(np.uint64) >> np.uint64(64 - _BLOOM_BITS)])
        t = term[maybe]
        spot = np.minimum(np.searchsorted(known, t), len(known) - 1)
        ok = known[spot] == t if len(known) else np.zeros(len(t), bool)
        return maybe[ok], spot[ok]

    return hits


def postings(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """(term, doc_id, pos) of all documents for the given tokens (sorted; shared_passages keeps them within MAX_TERMS)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _finder(shared.value)
        for ids, texts in _batches(batches):
            keys = np.array(ids, np.int64)
            for d, pos, term, _ in token_arrays(texts):
                hit, _ = hits(term)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(term[hit]), pa.array(keys[d[hit]]), pa.array(pos[hit].astype(np.int32))], ["term", "doc_id", "pos"]
                    )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(emit, "term long, doc_id long, pos int")


def rarest_tokens(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, pos, term): for each window of an item whose tokens all occur, its two rarest tokens.

    A window with a token that no document holds cannot occur and is left out.
    """
    told = tokens.join(counts, "term").groupBy("item_id", "need").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "n"))).alias("t"))
    # Windows of consecutive positions: t[i] .. t[i + need - 1] without a hole.
    rare = F.expr(
        "transform(filter(sequence(0, greatest(size(t) - need, 0)), i -> size(t) >= need and t[i + need - 1].pos - t[i].pos = need - 1), "
        "i -> slice(array_sort(transform(slice(t, i + 1, need), x -> struct(x.n as n, x.pos as pos, x.term as term))), 1, 2))"
    )
    return told.select("item_id", F.explode(F.flatten(rare)).alias("x")).select("item_id", "x.pos", "x.term").distinct()


def shared_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, tokens, need): the longest passage of consecutive tokens that a document shares with an item.

    Only pairs whose longest passage reaches the item's need are returned, one row per pair. Null, empty and
    short texts match nothing; repeated rows change nothing (of several items with one id one is taken); documents and items without an id are left out. Items are held in memory in blocks of at
    most MAX_TERMS tokens; documents are read once per block and never collected.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    tokens = item_tokens(items).checkpoint()
    parts = [_passages(docs, part, np.sort(held.column(0).to_numpy().astype(np.int64))) for part, held in _blocks(tokens, 1, 0, ["term"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _blocks(tokens: DataFrame, of: int, number: int, columns: list[str]) -> list[tuple[DataFrame, pa.Table]]:
    """The items in blocks whose distinct values of the columns are at most MAX_TERMS, with those values; a single item is never divided."""
    part = tokens if of == 1 else tokens.where(F.pmod(F.xxhash64("item_id"), F.lit(of)) == number)
    distinct = part.select(*columns).distinct()
    if distinct.count() > MAX_TERMS and part.select("item_id").distinct().limit(2).count() > 1:
        return _blocks(tokens, of * 2, number, columns) + _blocks(tokens, of * 2, number + of, columns)
    return [(part, distinct.toArrow())]  # bounded by MAX_TERMS or one item


def _passages(docs: DataFrame, tokens: DataFrame, terms: np.ndarray) -> DataFrame:
    index = postings(docs, terms).checkpoint()  # the stored index
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    anchors = rarest_tokens(tokens, counts)
    # Offset-adjusted lists of the rarest tokens; an alignment must be met by two of them.
    met = index.join(anchors.withColumnRenamed("pos", "item_pos"), "term").select("item_id", "doc_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
    alignments = met.groupBy("item_id", "doc_id", "shift").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    # The postings that lie on an alignment; both sides meet in stretches of the document, so a document that
    # holds very many passages costs no more than its length.
    lengths = tokens.groupBy("item_id", "need").agg(F.max("pos").alias("top"))
    reach = F.sequence(F.floor(F.greatest("shift", F.lit(0)) / _STRETCH), F.floor((F.col("shift") + F.col("top")) / _STRETCH))
    cells = alignments.join(lengths, "item_id").select("item_id", "need", "top", "doc_id", "shift", F.explode(reach).alias("cell"))
    on = index.withColumn("cell", F.floor(F.col("pos") / _STRETCH)).join(cells, ["doc_id", "cell"]).withColumn("item_pos", F.col("pos") - F.col("shift"))
    on = on.where(F.col("item_pos").between(0, F.col("top"))).select("item_id", "need", "doc_id", "shift", "item_pos", "term")
    lined = on.join(tokens.select("item_id", F.col("pos").alias("item_pos"), "term"), ["item_id", "item_pos", "term"])
    per = lined.groupBy("item_id", "need", "doc_id", "shift").agg(F.array_sort(F.collect_set("item_pos")).alias("p"))
    longest = F.expr(
        "aggregate(p, struct(0 as best, 0 as run, -2 as last), (a, x) -> struct("
        "greatest(a.best, if(x = a.last + 1, a.run + 1, 1)) as best, if(x = a.last + 1, a.run + 1, 1) as run, x as last)).best"
    )
    return per.groupBy("doc_id", "item_id", "need").agg(F.max(longest).alias("tokens")).where(F.col("tokens") >= F.col("need")).select("doc_id", "item_id", "tokens", "need")


#: Share of an item's tokens that makes a proximity match, and the drift of positions allowed.
NEAR_SHARE, NEAR_DRIFT = 0.4, 24
#: Matches of a stretch of documents with items that are scored at a time.
_MATCHES = 4_000_000


def near_passages(docs: DataFrame, items: DataFrame, share: float = NEAR_SHARE, drift: int = NEAR_DRIFT) -> DataFrame:
    """(doc_id, item_id, permille): documents that hold at least ``share`` of an item's tokens close together, with words put in or left out.

    Tokens count if their position in the document, less that in the item, lies within ``drift`` of a common value (a spread of up to twice the
    drift); permille is the largest share found, whatever the common value. Every value is tried: a document is scored where it is read, against
    items held in memory in blocks of at most MAX_TERMS tokens. Null and empty texts, and documents and items without
    an id, match nothing; repeated rows change nothing (of several texts with one id the best counts).
    """
    ensure_checkpoint_dir(docs.sparkSession)
    tokens = item_tokens(items).checkpoint()
    parts = [_near(docs, held, share, drift) for _, held in _blocks(tokens, 1, 0, ["item_id", "pos", "term"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max("permille").alias("permille"))


class _Shelf:
    """Items in memory: ``item`` and ``pos`` of the tokens of each term, and how many tokens an item has and must find."""

    def __init__(self, held: pa.Table, limit: int) -> None:
        ids, pos, term = (held.column(k).to_numpy() for k in range(3))
        order = np.argsort(term, kind="stable")
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(term))
        self.ids, item = np.unique(ids, return_inverse=True)
        self.item, self.pos = item[order].astype(np.int64), pos[order].astype(np.int64)
        self.total = np.bincount(item, minlength=len(self.ids))
        self.least = np.maximum(-(-self.total * limit // 1000), 1)


def _runs(doc: np.ndarray, spot: np.ndarray, pos: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, first, last) of the stretches in which a term comes again within the spread, in order of the documents.

    The windows that see a term of a stretch follow each other without a hole, so a stretch counts as one.
    """
    order = np.lexsort((pos, spot, doc))
    doc, spot, pos = doc[order], spot[order], pos[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (spot[1:] != spot[:-1]) | (pos[1:] - pos[:-1] > spread + 1)
    start = np.flatnonzero(new)
    return doc[start], spot[start], pos[start], pos[np.append(start[1:], len(doc)) - 1]


def _best(shelf: _Shelf, doc: np.ndarray, spot: np.ndarray, first: np.ndarray, last: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, item, tokens held): for each pair that can reach the item's least, the most item tokens that one window sees."""
    begin = shelf.first[spot]
    n = shelf.first[spot + 1] - begin
    run = np.repeat(np.arange(len(spot)), n)
    at = begin[run] + np.arange(len(run)) - (np.cumsum(n) - n)[run]
    item = shelf.item[at]
    pair = (doc[run] - doc[0]) * len(shelf.ids) + item
    can = np.flatnonzero(np.bincount(pair)[pair] >= shelf.least[item])  # a window sees no more than all matches
    pair, run, pos = pair[can], run[can], shelf.pos[at[can]]
    if not len(pair):
        return pair, pair, pair
    # A token is seen by the windows that begin at its offset less the spread, up to its offset; the deepest point wins.
    base = int(pos.max()) + spread
    opens, closes = first[run] - pos - spread + base, last[run] - pos + 1 + base
    key = np.sort(np.concatenate([pair << 34 | opens << 1 | 1, pair << 34 | closes << 1]))
    depth = np.cumsum((key & 1) * 2 - 1)
    group = key >> 34
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return group[start] // len(shelf.ids) + doc[0], group[start] % len(shelf.ids), np.maximum.reduceat(depth, start)


def _near(docs: DataFrame, held: pa.Table, share: float, drift: int) -> DataFrame:
    limit, spread = round(share * 1000), 2 * drift
    shared = docs.sparkSession.sparkContext.broadcast(_Shelf(held, limit))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = shared.value
        hits = _finder(shelf.terms)
        for ids, texts in _batches(batches):
            keys = np.array(ids, np.int64)
            for d, pos, term, _ in token_arrays(texts):
                hit, spot = hits(term)
                if not len(hit):
                    continue
                runs = _runs(d[hit], spot, pos[hit], spread)
                matches = np.cumsum(shelf.first[runs[1] + 1] - shelf.first[runs[1]])
                heads = np.flatnonzero(np.append(True, runs[0][1:] != runs[0][:-1]))
                ends = np.append(heads[1:], len(runs[0]))
                k = 0
                while k < len(heads):  # whole documents, at least one at a time
                    seen = int(matches[heads[k] - 1]) if heads[k] else 0
                    full = int(np.searchsorted(matches[ends - 1], seen + _MATCHES, "right"))
                    wide = int(np.searchsorted(runs[0][heads], runs[0][heads[k]] + _MATCHES // len(shelf.ids), "right"))
                    upto = max(min(full, wide), k + 1)
                    doc, item, found = _best(shelf, *(x[heads[k] : ends[upto - 1]] for x in runs), spread)
                    permille = found * 1000 // shelf.total[item]
                    ok = permille >= limit
                    if ok.any():
                        yield pa.RecordBatch.from_arrays([pa.array(keys[doc[ok]]), pa.array(shelf.ids[item[ok]]), pa.array(permille[ok])], ["doc_id", "item_id", "permille"])
                    k = upto

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, "doc_id long, item_id long, permille long")
