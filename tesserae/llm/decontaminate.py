"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards of about ``SHARD_WORDS`` words and
builds a suffix array of each shard: the word positions, sorted by the words
from there on. Every suffix of every benchmark item is then binary-searched in
it; the interval found holds all places where the suffix's first ``WORDS``
words stand verbatim. Places that follow each other in document and item are
parts of one longer match, which gives the longest match of a document and
where it lies.

Words that no item has can't be part of a match: they get code 0, and only
positions with enough known words ahead go into the suffix array. That loses
no match. The benchmark is written to the shared folder in blocks of at most
``BLOCK_CHARS`` characters (or one item); a task reads one block at a time and
takes its texts through all of them, so neither the driver nor a task holds
more of the benchmark than a block. Texts are read once and not shuffled.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, new_folder, stored, write_whole

WORDS = 10
SHARD_WORDS = 1 << 20
BLOCK_CHARS = 8_000_000
CHAIN_ROWS = 1 << 20
#: Characters of text that each block is taken over, where there are several blocks.
HELD_CHARS = 1 << 26

#: A-Z to a-z; 0-9, a-z and all bytes of other characters stay; the rest are gaps.
_GAPS = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_GAPS).split()


class Items:
    """A block of the benchmark: word codes, and windows of each length with their items."""

    def __init__(self, rows: list[tuple[str, str | None]], words: int = WORDS):
        self.code: dict[bytes, int] = {}
        same: dict[tuple[int, ...], list[str]] = {}  # items of equal words count as one
        for item, text in rows:
            w = words_of(text)
            if item is not None and w:
                same.setdefault(tuple(self.code.setdefault(x, len(self.code) + 1) for x in w), []).append(item)
        self.ids = list(same.values())
        codes = [np.array(c, np.int64) for c in same]
        owners: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for i, c in enumerate(codes):
            n = min(words, len(c))
            owners.setdefault(n, []).extend((c[j : j + n], i, j) for j in range(len(c) - n + 1))
        #: by length: distinct windows, and as (start, items, offsets) who has each
        self.windows = {}
        for n, own in owners.items():
            rows_, inverse = np.unique(np.stack([x[0] for x in own]), axis=0, return_inverse=True)
            order = np.argsort(inverse.ravel(), kind="stable")
            who = np.array([x[1] for x in own], np.int64)[order]
            at = np.array([x[2] for x in own], np.int64)[order]
            self.windows[n] = (rows_, np.searchsorted(inverse.ravel()[order], np.arange(len(rows_) + 1)), who, at)
        self.least = min(self.windows, default=0)
        self.depth = max(self.windows, default=0)


def suffix_array(codes: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Positions with ``least`` known words ahead, sorted by their next ``depth`` codes.

    Prefix doubling: ranks of runs of 1, 2, 4, ... codes; the last step joins
    two overlapping runs to the depth asked for.
    """
    n = len(codes)
    stops = np.flatnonzero(codes == 0)
    ahead = np.append(stops, n)[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    keep = np.flatnonzero(ahead >= least)
    if not len(keep):
        return keep
    # work on the kept stretches only: each kept position and what it reaches
    reach = np.zeros(n + 1, np.int64)
    np.add.at(reach, keep, 1)
    np.add.at(reach, np.minimum(keep + depth, n), -1)
    part = np.flatnonzero(np.cumsum(reach[:n]) > 0)
    small = codes[part]
    # stretches that don't touch in the text are kept apart by a gap of zeros
    gap = np.flatnonzero(np.diff(part) > 1) + 1
    small = np.insert(small, gap, 0)
    place = np.insert(part, gap, -1)
    rank, length, m = small.copy(), 1, len(small)
    while length < depth:
        step = min(length, depth - length)
        nxt = np.zeros(m, np.int64)
        nxt[: max(0, m - step)] = rank[step:]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + nxt, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        length += step
    at = place[np.argsort(rank, kind="stable")]
    at = at[at >= 0]
    return at[ahead[at] >= least]


def intervals(codes: np.ndarray, suffixes: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``sought``, the interval of the suffix array that starts with it."""
    n, size = sought.shape
    padded = np.append(codes, np.zeros(size, codes.dtype))
    columns = np.arange(size)

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(n, np.int64), np.full(n, len(suffixes), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            there = padded[suffixes[np.minimum(mid, len(suffixes) - 1)][:, None] + columns]
            differs = there != sought
            first = differs.argmax(1)
            row = np.arange(n)
            less = there[row, first] < sought[row, first]
            if upper:
                less |= ~differs.any(1)
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo

    if not len(suffixes):
        zero = np.zeros(n, np.int64)
        return zero, zero
    return bound(False), bound(True)


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for each value of each [start, end)."""
    size = ends - starts
    row = np.repeat(np.arange(len(starts)), size)
    return row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[row]


def match_shard(texts: list[str | None], items: Items) -> list[dict]:
    """For each text: n_words, spans (flat word starts and ends, merged), items,
    and the longest verbatim match (words, its first word here, item)."""
    get = items.code.get
    each = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in each], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # a 0 stands behind each text
    codes = np.zeros(int((sizes + 1).sum()), np.int64)
    for at, w in zip(starts, each, strict=True):
        if w:
            codes[at : at + len(w)] = [get(x, 0) for x in w]
    out = [{"n_words": int(n), "spans": [], "items": [], "longest": 0, "longest_at": None, "longest_item": None} for n in sizes]
    del each
    suffixes = suffix_array(codes, items.depth, items.least) if items.windows else np.empty(0, np.int64)
    if not len(suffixes):
        return out
    cover, owners, metter = np.zeros(len(codes) + 1, np.int64), [], []
    for size, (rows, who_at, who, offset) in items.windows.items():
        lo, hi = intervals(codes, suffixes, rows)
        window, slot = _spread(lo, hi)
        place = suffixes[slot]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + size, -1)
        doc = np.searchsorted(starts, place, "right") - 1
        # who has the windows met in each document, once a document and window
        met = np.unique(np.stack([doc, window], 1), axis=0)
        row, owner = _spread(who_at[met[:, 1]], who_at[met[:, 1] + 1])
        owners.append(np.stack([met[row, 0], who[owner]], 1))
        metter.append((size, place, window))
    for d, i in np.unique(np.concatenate(owners), axis=0):
        out[d]["items"] += items.ids[i]
    inside = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        d = int(np.searchsorted(starts, a, "right") - 1)
        out[d]["spans"] += [int(a - starts[d]), int(b - starts[d])]
    for size, place, window in metter:
        _longest(out, items, starts, size, place, window)
    return out


def _longest(out: list[dict], items: Items, starts: np.ndarray, size: int, place: np.ndarray, window: np.ndarray) -> None:
    """Join windows that follow each other in text and item; note the longest of each text.

    Whole documents are taken together, about CHAIN_ROWS (place, item) pairs at a time.
    """
    _, who_at, who, offset = items.windows[size]
    order = np.argsort(place)
    place, window = place[order], window[order]
    doc = np.searchsorted(starts, place, "right") - 1
    total = np.cumsum(who_at[window + 1] - who_at[window])
    at = 0
    while at < len(place):
        upto = np.searchsorted(total, total[at] + CHAIN_ROWS)
        upto = len(place) if upto >= len(place) else max(np.searchsorted(doc, doc[upto]), np.searchsorted(doc, doc[at], "right"))
        row, owner = _spread(who_at[window[at:upto]], who_at[window[at:upto] + 1])
        here = place[at:upto][row]
        # one line for each item and each distance between text and item
        chain = np.stack([who[owner], here - offset[owner], here], 1)
        chain = chain[np.lexsort((chain[:, 2], chain[:, 1], chain[:, 0]))]
        step = np.diff(chain, axis=0)
        head = np.flatnonzero(np.append(True, (step[:, 0] != 0) | (step[:, 1] != 0) | (step[:, 2] != 1)))
        length = np.diff(np.append(head, len(chain))) - 1 + size
        for h, n in zip(head, length, strict=True):
            d = int(np.searchsorted(starts, chain[h, 2], "right") - 1)
            if n > out[d]["longest"]:
                out[d] |= {"longest": int(n), "longest_at": int(chain[h, 2] - starts[d]), "longest_item": items.ids[chain[h, 0]][0]}
        at = upto


def _shards(texts: pd.Series) -> Iterator[list[str | None]]:
    """About SHARD_WORDS words each; a longer text is a shard of its own."""
    part, size = [], 0
    for t in texts:
        n = len(t or "") // 4
        if part and size + n > SHARD_WORDS:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", most: int = BLOCK_CHARS) -> list[str]:
    """Files of the benchmark's (item, text) pairs, of at most ``most`` characters each (or one item).

    Tasks write them below the shared folder; only their names come to the
    driver. Items with a null id or text are left out.
    """
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.char_length("text"))).head()[0] or 0
    folder = new_folder(benchmark.sparkSession, "benchmark")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def written(part):
            name = f"{folder}/block-{uuid.uuid4().hex}"
            write_whole(name, pickle.dumps(part))
            return pd.DataFrame({"block": [name]})

        part, size = [], 0
        for pdf in batches:
            for row in zip(pdf["item"], pdf["text"], strict=True):
                if part and size + len(row[1]) > most:
                    yield written(part)
                    part, size = [], 0
                part.append(row)
                size += len(row[1])
        if part:
            yield written(part)

    # stored: a task that runs again writes another file, and the row says which one counts
    names = stored(rows.repartition(max(1, -(-total // most))).mapInPandas(cut, "block string"), "blocks")
    return sorted(r.block for r in names.collect())


_KIND = "n_words long, n_hit long, spans array<long>, items array<string>, longest int, longest_at long, longest_item string"


class Blocks:
    """The items of block files, one block held at a time."""

    def __init__(self, names: list[str], words: int):
        self.names, self.words, self.held, self.items = names, words, None, None

    def __iter__(self) -> Iterator[Items]:
        for name in self.names or [None]:
            if self.items is None or name != self.held:
                self.items, rows = None, []
                if name is not None:
                    store, path = filesystem(name)
                    with store.open_input_file(path) as f:
                        rows = pickle.loads(f.read())
                self.held, self.items = name, Items(rows, self.words)
            yield self.items


def _joined(parts: list[dict]) -> dict:
    """One text's matches with all blocks: spans merged, each word counted once."""
    out = max(parts, key=lambda p: p["longest"]) if len(parts) > 1 else parts[0]
    spans: list[int] = []
    for a, b in sorted(s for p in parts for s in zip(p["spans"][::2], p["spans"][1::2], strict=True)):
        if spans and a <= spans[-1]:
            spans[-1] = max(b, spans[-1])
        else:
            spans += [a, b]
    items = sorted({i for p in parts for i in p["items"]})
    return out | {"spans": spans, "items": items, "n_hit": sum(spans[1::2]) - sum(spans[::2])}


def _matcher(names: list[str], words: int):
    """The UDF; a task cuts its texts into shards and takes each block over all of them.

    Where there are several blocks, batches are held up to HELD_CHARS, so that
    a block is read once for as much text.
    """
    blocks_of = Blocks(names, words)
    most = HELD_CHARS if len(names) > 1 else 0

    def matched(held: list[pd.Series]) -> Iterator[pd.DataFrame]:
        shards = [shard for texts in held for shard in _shards(texts)]
        found: list[list[list[dict]]] = [[] for _ in shards]
        for items in blocks_of:
            for at, shard in enumerate(shards):
                found[at].append(match_shard(shard, items))
        rows = [_joined(list(p)) for parts in found for p in zip(*parts, strict=True)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _KIND.split(", ")]).astype({"longest_at": "Int64"})

    @F.pandas_udf(_KIND)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for texts in batches:
            held.append(texts)
            size += sum(len(t or "") for t in texts)
            if size >= most:
                yield from matched(held)
                held, size = [], 0
        if held:
            yield from matched(held)

    return match


def _pairs(flat: Column) -> Column:
    """(start, end) structs of a flat list."""
    pair = lambda i: F.struct(flat[i].alias("start"), flat[i + 1].alias("end"))
    at = F.filter(F.sequence(F.lit(0), F.size(flat)), lambda i: (i % 2 == 0) & (i < F.size(flat)))
    return F.transform(at, pair)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", words: int = WORDS,
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a struct column ``match``: n_words, n_hit, spans, items,
    longest, longest_at, longest_item.

    spans are word ranges (start, end exclusive), merged, inside occurrences of
    a window: ``words`` consecutive words of an item, or a shorter item as a
    whole. items are the ids, as strings, of the items with a window there,
    sorted. Null texts have no words; items with a null id or without words
    are left out; repeated items and documents count as they stand. A text longer
    than SHARD_WORDS is a shard of its own and taken whole. An empty
    benchmark hits nothing. A column named match is replaced, others stay,
    whatever they are called.
    """
    own = [c for c in docs.columns if c != "match"]
    found = _matcher(blocks(benchmark, "item_id", "text", block_chars), words)
    rows = docs.select(F.struct(*own).alias("row"), found(text).alias("m"))
    match = F.struct("m.n_words", "m.n_hit", _pairs(F.col("m.spans")).alias("spans"), "m.items", "m.longest", "m.longest_at", "m.longest_item")
    return rows.select("row.*", match.alias("match"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any word inside an occurrence of a window.

    Null and empty texts stay, repeats stay or go together, all columns stay
    whatever they are called; an empty benchmark or table changes nothing.
    """
    own = docs.columns
    row = docs.select(F.struct(*own).alias("row"), "text")
    return matches(row, benchmark).where("match.n_hit = 0").select("row.*")
