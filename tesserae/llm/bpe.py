"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by the tokenizer's pattern; each piece is merged by rank, the
lowest first and the leftmost of equal ones. The queue that says what comes
next has a bucket for each merge rank, which holds positions of a linked list.
A bitmap tells which buckets have entries; above it two smaller bitmaps tell
which of its words aren't 0, so the next rank takes three find-first-set steps,
however long the list. Entries whose pair has changed since stay in their
bucket and are skipped when it comes up.

All new pieces of a batch lie in one linked list, with a gap between pieces.
Pieces don't touch each other, so taking ranks in order over all of them takes
them in order in each, and a whole bucket can be merged in a few numpy steps.
A merge of rank r may bring up a pair of lower rank only where r's token is
part of a token of lower rank. Such buckets, and small ones, are merged from
left to right, and each new token at once takes in its neighbours as long as
that gives a rank of at most r: no other pairs of such ranks exist just then.
So each bucket comes up once, and a piece of any length costs time in
proportion to its bytes.

Pieces recur, so each task remembers the ids of the pieces it has met (up to
``MEMORY`` of them or ``MEMORY_CHARS`` characters; then it starts afresh).
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

MEMORY = 300_000
MEMORY_CHARS = 1 << 24
FEW = 24
CHUNK = 1 << 18
SLICE = 1 << 23

#: What the pattern matches in texts without characters from U+0250 on and
#: without those that the two regular expression libraries see differently:
#: the same alternatives, the most frequent first (they begin differently, so
#: that order doesn't matter), and classes written out.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_SPACE = "\t-\r \x85\xa0"
_SIMPLE = re.compile(
    rf" ?[{_LETTER}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ‐-‧‰-⁞₠-₿]")


def splitter(pattern: str):
    """text -> pieces by ``pattern``; a quicker equal for simple texts if it's the usual one."""
    import public_tokenizers

    full = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return full.findall
    return lambda text: full.findall(text) if _ODD.search(text) else _SIMPLE.findall(text)


class RankQueue:
    """Positions by rank; ``pop`` takes the bucket of the smallest rank that has any."""

    def __init__(self, ranks: int):
        words = ranks // 64 + 1
        self.bits, self.words, self.top = array("Q", bytes(8 * words)), array("Q", bytes(8 * (words // 64 + 1))), 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, at: np.ndarray) -> None:
        """File each position under its rank."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begins = [0, *cuts.tolist()]
        buckets, bits, words = self.buckets, self.bits, self.words
        for rank, a, b in zip(ranks[begins].tolist(), begins, [*begins[1:], len(ranks)], strict=True):
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [at[a:b]]
                word, group = rank >> 6, rank >> 12
                bits[word] |= 1 << (rank & 63)
                words[group] |= 1 << (word & 63)
                self.top |= 1 << group
            else:
                bucket.append(at[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """(rank, positions), or nothing if all buckets are empty."""
        top = self.top
        if not top:
            return None
        group = (top & -top).bit_length() - 1
        x = self.words[group]
        word = (group << 6) + (x & -x).bit_length() - 1
        x = self.bits[word]
        rank = (word << 6) + (x & -x).bit_length() - 1
        self.bits[word] &= ~(1 << (rank & 63))
        if not self.bits[word]:
            self.words[group] &= ~(1 << (word & 63))
            if not self.words[group]:
                self.top &= ~(1 << group)
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Pairs:
    """Rank of a pair of tokens: of their joined bytes, if those are a token; else -1."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=0) + 1
        parts, to = [], []
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    parts.append((a, b))
                    to.append(rank)
        keys = [a << 32 | b for a, b in parts]
        # the same for single look-ups; no key stands for a pair with -1
        self.of = dict(zip((a * (size + 1) + b for a, b in parts), to, strict=True))
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.to = np.append(np.array(to, np.int32)[order], -1).astype(np.int32)
        # tokens that can be part of a token of lower rank: merging to one may bring up an earlier rank
        a, b = self.keys[:-1] >> 32, self.keys[:-1] & 0xFFFFFFFF
        self.back = np.zeros(max(ranks.values(), default=0) + 1, bool)
        for part in (a, b):
            self.back[part[self.to[:-1] < part]] = True

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For token ids; negative ids (gaps) have no pair."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], np.int32(-1))


class Numbers(dict):
    """Pieces to numbers; a new piece gets the next one and is noted as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        self.chars += len(piece)
        return n


class Coder:
    """Encoder and decoder of one vocabulary; ``ranks`` maps bytes to ids, which are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.pairs = ranks, splitter(pattern), Pairs(ranks)
        self.size = max(ranks.values(), default=0) + 1
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        parts = [b""] * self.size
        for part, rank in ranks.items():
            parts[rank] = part
        self.part_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.part_ends = np.cumsum([0, *map(len, parts)])
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the pieces, one after the other."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, ends = len(data), np.cumsum([len(p) for p in pieces], dtype=np.int64)
        token = np.append(self.bytes[data], np.int32(-1))  # n is the gap
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        after[ends[ends > 0] - 1] = n
        before[ends[ends < n]] = n
        before[0] = n
        pair = np.append(self.pairs.rank(token[:-1], token[after[:-1]]), np.int32(-1))
        queue, rank_of = RankQueue(self.size), self.pairs.rank
        views = tuple(map(memoryview, (token, after, before, pair)))
        first = np.flatnonzero(pair >= 0)
        queue.push(pair[first], first.astype(np.int32))
        while (got := queue.pop()) is not None:
            rank, at = got
            at = at[pair[at] == rank]  # others are stale
            if not len(at):
                continue
            at = np.unique(at)
            if self.pairs.back[rank] or len(at) <= FEW:
                at = np.array(self._one_by_one(rank, at.tolist(), *views), np.int32)
            else:
                # of pairs in a row every second one falls to the one before it
                row = np.append(False, after[at[:-1]] == at[1:])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(row, 0, place))) % 2 == 0]
                gone = after[at]
                ahead = after[gone]
                token[at], token[gone], pair[gone] = rank, -1, -1
                after[at], before[ahead] = ahead, at
            touched = np.concatenate([at, before[at]])
            touched = touched[touched < n]
            new = rank_of(token[touched], token[after[touched]])
            pair[touched] = new
            have = new >= 0
            queue.push(new[have], touched[have])
        left = np.flatnonzero(token[:n] >= 0)
        return token[left], np.searchsorted(left, ends)

    def _one_by_one(self, rank: int, at: list[int], token, after, before, pair) -> list[int]:
        """Merge the pairs at the ascending places ``at`` and what that brings up below or at ``rank``.

        Gives the places of the new tokens, whose pairs and whose neighbours' are still to be found.
        """
        of, stride, grown = self.pairs.of.get, self.size + 1, {}
        for p in at:
            if pair[p] != rank:  # one before it has taken a part
                continue
            right = True
            new = rank
            while True:
                if not right:
                    p = before[p]
                gone = after[p]
                ahead = after[gone]
                token[p], token[gone], pair[p], pair[gone] = new, -1, -1, -1
                after[p], before[ahead] = ahead, p
                a = of(token[before[p]] * stride + new, stride)
                b = of(new * stride + token[ahead], stride)
                new, right = min(a, b), b < a  # of equal ranks the left one comes first
                if new > rank:
                    break
            grown[p] = None
        return list(grown)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the texts, one after the other. About SLICE characters at a time, or one text."""
        parts, at = [], 0
        while at < len(texts):
            upto, size = at + 1, len(texts[at])
            while upto < len(texts) and size + len(texts[upto]) <= SLICE:
                size += len(texts[upto])
                upto += 1
            parts.append(self._encode(texts[at:upto]))
            at = upto
        if len(parts) == 1:
            return parts[0]
        ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int32)
        return ids, np.append(0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts])) if parts else [])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) >= MEMORY or self.number.chars >= MEMORY_CHARS:
            self.forget()
        number, split, met, sizes = self.number, self.split, array("i"), [0]
        for text in texts:
            met.extend(map(number.__getitem__, split(text)))
            sizes.append(len(met))
        if number.fresh:
            ids, ends = self.merge([p.encode("utf-8", "replace") for p in number.fresh])
            self.ends = np.append(self.ends, ends + len(self.ids))
            self.ids = np.append(self.ids, ids)
            number.fresh = []
        which = np.frombuffer(met, np.int32) if met else np.empty(0, np.int32)
        total = np.append(0, np.cumsum((self.ends[1:] - self.ends[:-1])[which]))
        out = np.empty(total[-1], np.int32)
        for at in range(0, len(which), CHUNK):
            part = which[at : at + CHUNK]
            out[total[at] : total[at + len(part)]] = self.ids[_spread(self.ends[part], self.ends[part + 1])]
        return out, total[np.array(sizes)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each stretch of ids."""
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            part = ids[a:b]
            out.append(self.part_bytes[_spread(self.part_ends[part], self.part_ends[part + 1])].tobytes())
        return out


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of each [start, end), one after the other."""
    size = ends - starts
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - size), size)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line of base64 bytes and rank for each token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_CODERS: dict[tuple, Coder] = {}


def coder(source: str, pattern: str) -> Coder:
    """The coder of a vocabulary, made once a Python worker.

    ``source``: the name of a public_tokenizers file, or a path all executors have.
    """
    key = (source, pattern)
    if key not in _CODERS:
        import public_tokenizers

        _CODERS[key] = Coder(read_ranks(source if "/" in source else public_tokenizers.path(source)), pattern)
    return _CODERS[key]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def encoder(source: str, pattern: str):
    """Column function: text -> array<int> of ids; null gives an empty array."""

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _lists(*coder(source, pattern).encode([t or "" for t in texts.to_pylist()]))

    return encode


def decoder(source: str, pattern: str):
    """Column function: array<int> -> binary; null gives null."""

    @arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        parts = coder(source, pattern).decode(ids.values.to_numpy(), ids.offsets.to_numpy())
        return pa.array([p if ok else None for p, ok in zip(parts, ids.is_valid().to_pylist(), strict=True)], pa.binary())

    return decode


def round_trip(source: str, pattern: str):
    """Column function: text -> (ids, decoded), decoded being the bytes of the ids. One pass in one worker."""

    @arrow_udf("ids array<int>, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        c = coder(source, pattern)
        ids, ends = c.encode([t or "" for t in texts.to_pylist()])
        return pa.StructArray.from_arrays([_lists(ids, ends), pa.array(c.decode(ids, ends), pa.binary())], ["ids", "decoded"])

    return both


def tokenize(docs: DataFrame, source: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None,
             text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded`` (binary, from the ids).

    Null and empty texts have no ids and decode to no bytes. Each row is coded
    by itself, whole, so repeats get equal ids; columns of these names are
    replaced, others stay, whatever they are called. An empty table stays one.
    """
    import public_tokenizers

    own = [c for c in docs.columns if c not in ("ids", "decoded")]
    coded = docs.select(F.struct(*own).alias("row"), round_trip(source, pattern or public_tokenizers.PATTERN)(text).alias("coded"))
    return coded.select("row.*", "coded.ids", "coded.decoded")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id and digests of ids and decoded bytes."""
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encoded(docs: DataFrame, source: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """Training rows: doc_id, lang, source, n_tokens and ids of each document.

    Null and empty texts have no ids; every row gives one, repeats and null ids
    too; other columns are not looked at. An empty table gives no rows.
    """
    import public_tokenizers

    coded = docs.select("doc_id", "lang", "source", encoder(source, pattern or public_tokenizers.PATTERN)("text").alias("ids"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
