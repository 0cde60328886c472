"""Filling containers of fixed capacity with whole texts (problem 6).

Sizes are tokens of a public tokenizer. Only a text over the capacity is split: its full pieces are containers
of their own, so at most one remainder of each text has to be packed. Those are spread by hash over blocks of bounded
size; each block is packed by Karmarkar-Karp differencing into the fewest windows that hold it.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2_048
#: Where the tokenizer's vocabulary lies; it is never copied.
TOKENIZER = os.environ.get("TALKLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how the tokenizer's vocabulary cuts text into words first.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that are packed together, about; larger blocks leave less space unused and take longer.
BLOCK = 1_024


@lru_cache(4)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def split_by_tokens(text: str, encoding, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text, in code points; each piece alone has at most ``capacity`` tokens.

    All pieces but the last are as full as the tokens allow without cutting a sign.
    """
    tokens = encoding.encode_ordinary(text)
    if len(tokens) <= capacity:
        return [(0, len(text), len(tokens))] if text else []
    out: list[tuple[int, int, int]] = []
    at = first = 0
    while first < len(tokens):
        last = min(first + capacity, len(tokens))
        while True:
            try:
                piece = encoding.decode_bytes(tokens[first:last]).decode("utf-8") if last < len(tokens) else text[at:]
            except UnicodeDecodeError:  # a sign of several tokens is not cut
                piece, size = "", capacity + 1
            else:
                size = len(encoding.encode_ordinary(piece))
            if size <= capacity:
                break
            last -= size - capacity
            if last <= first:
                raise ValueError("the capacity is smaller than one sign")
        out.append((at, at + len(piece), size))
        at += len(piece)
        first = last
    return out


def differencing(sizes: Sequence[int], windows: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp: (sum, items) of each window in use, sums descending.

    Starts with every item as a partial partition; the two with the largest imbalance are merged, largest
    against smallest, until one is left.
    """
    heap = [(-s, n, [(s, [n])]) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(b) > len(a):
            a, b = b, a
        full = windows - len(a)  # windows still empty in a take b's largest
        merged = a + b[:full]
        for j in range(full, len(b)):
            k = windows - 1 - j
            merged[k] = (merged[k][0] + b[j][0], merged[k][1] + b[j][1])
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], count, merged))
        count += 1
    return heap[0][2] if heap else []


def pack_items(sizes: Sequence[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Windows of at most ``capacity``: the window count starts at the least possible and rises while one stays too full.

    An item larger than the capacity is an error; items of size 0 go anywhere; no items give no windows.
    """
    if any(s > capacity for s in sizes):
        raise ValueError("an item exceeds the capacity")
    if not len(sizes):
        return []
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        out = relieve(differencing(sizes, windows), sizes, windows, capacity)
        excess = sum(max(0, s - capacity) for s, _ in out)
        if not excess:
            return out
        windows += max(1, excess // (2 * capacity))


def relieve(parts: list[tuple[int, list[int]]], sizes: Sequence[int], windows: int, capacity: int) -> list[tuple[int, list[int]]]:
    """Exchanges items of windows that are too full with smaller ones (or nothing) of windows with room, as long as that helps."""
    if all(s <= capacity for s, _ in parts):
        return parts
    n = len(sizes)
    size = np.concatenate([np.asarray(sizes, np.int64), np.zeros(windows, np.int64)])  # each window also offers nothing in exchange
    home = np.empty(n + windows, np.int64)
    home[n:] = np.arange(windows)
    total = np.zeros(windows, np.int64)
    for w, (s, items) in enumerate(parts):
        total[w] = s
        home[items] = w
    for w in np.flatnonzero(total > capacity):
        while total[w] > capacity:
            over, best = total[w] - capacity, None
            for a in np.flatnonzero(home[:n] == w):
                gain = size[a] - size
                good = (gain > 0) & (gain <= capacity - total[home]) & (home != w)
                if not good.any():
                    continue
                # The smallest exchange that is enough, else the largest there is.
                rank = np.where(good, np.where(gain >= over, gain, 4 * capacity - gain), 9 * capacity)
                b = int(rank.argmin())
                if best is None or rank[b] < best[0]:
                    best = (rank[b], a, b)
            if best is None:
                break
            _, a, b = best
            u, gain = home[b], size[a] - size[b]
            home[a] = u
            if b < n:
                home[b] = w
            total[w] -= gain
            total[u] += gain
    out: list[tuple[int, list[int]]] = []
    order = np.argsort(home[:n], kind="stable")
    for items in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        out.append((int(size[items].sum()), items.tolist()))
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start_pos, end_pos, n_tokens) of all texts with a doc_id; null and empty texts and those without a doc_id have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokenizer(path)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                out += [(doc, n, s, e, k) for n, (s, e, k) in enumerate(split_by_tokens(text, encoding, capacity))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start_pos", "end_pos", "n_tokens"])

    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    return rows.mapInPandas(cut, "doc_id long, piece int, start_pos int, end_pos int, n_tokens int")


def fill_containers(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """(container, doc_id, piece, start_pos, end_pos, n_tokens): every piece of every text with a doc_id in one container.

    ``container`` names are unique. Documents are counted first, so that blocks keep their size however many
    there are. Equal doc_ids are separate texts in the same block. A text with a null doc_id gets no container, as no row could tell
    whose it is.
    """
    blocks = max(1, -(-docs.count() // block))
    cut = pieces(docs, capacity, path)
    # A piece that fills a container, or nearly, needs no packing.
    spread = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "n_tokens"], kind="stable").reset_index(drop=True)
        sizes = pdf["n_tokens"].tolist()
        last = pdf["piece"] < pdf.groupby("doc_id")["piece"].transform("max")
        alone = [i for i, full in enumerate(last) if full and sizes[i] > capacity - 8]
        skip = set(alone)
        rest = [i for i in range(len(sizes)) if i not in skip]
        windows = pack_items([sizes[i] for i in rest], capacity)
        groups = [[i] for i in alone] + [[rest[j] for j in items] for _, items in windows]
        name = [""] * len(sizes)
        for n, items in enumerate(groups):
            for i in items:
                name[i] = f"{pdf['_b'].iloc[0]}-{n}"
        return pdf.assign(container=name).drop(columns="_b")[["container", "doc_id", "piece", "start_pos", "end_pos", "n_tokens"]]

    return spread.groupBy("_b").applyInPandas(fill, "container string, doc_id long, piece int, start_pos int, end_pos int, n_tokens int")
