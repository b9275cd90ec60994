"""Context-triggered piecewise hashes of texts.

A rolling hash of the last seven bytes decides where chunks end: a chunk ends
where the hash is block size - 1 modulo the block size. Each chunk gives one
letter from a hash of its bytes. A fingerprint is ``block:letters:letters``,
with the letters at the block size and at twice of it. The block size is the
smallest of 3, 6, 12, ... at which the text has at most LETTERS chunks, so
every letter stands for one chunk and no part of a text goes uncounted. (The
ends of chunks at a block size are among those at half of it, so there are
fewer at each step.)

Two fingerprints are compared at the block sizes that both have (equal ones,
or one twice the other): likeness is 1 - edit distance / total letters, with
an edit being a letter put in or taken out.

The hashes are sums of bytes times powers of an odd number modulo 2**64, so
that a chunk's hash is a difference of running sums and a whole text takes a
few passes of numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TASK_BYTES, stored

LETTERS = 64
LEAST_BLOCK = 3
WINDOW = 7
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
#: Characters of text that are gathered before they are worked on.
TURN_CHARS = 1 << 22
#: A task takes about TASK_BYTES of text up to so many ranges (3 TB), and as much more beyond (1 GB at 100 TB), a row at a time.
RANGES = 100_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _UNPOWER = _powers(_BASE, _PIECE), _powers(_INVERSE, _PIECE + 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the seven bytes up to each byte (fewer at the beginning)."""
    h = np.zeros(len(data), np.uint64)
    for back in range(min(WINDOW, len(data))):
        h[back:] += data[: len(data) - back].astype(np.uint64) * np.uint64(pow(31, back * 3 + 1, 1 << 32))
    return ((h * _MIX) >> np.uint64(32)).astype(np.uint32)


def _chunk_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each chunk between ``ends`` (the last of them is len(data)).

    Sum of byte * base**(place in the chunk); long texts in pieces, whose parts add up.
    """
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(ends), np.uint64)
    for at in range(0, len(data), _PIECE):
        part = data[at : at + _PIECE]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)], dtype=np.uint64)])
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part), "left")
        a = np.maximum(starts[lo:hi] - at, 0)
        b = np.minimum(ends[lo:hi] - at, len(part))
        part_hash = (sums[b] - sums[a]) * _UNPOWER[a]
        before = np.maximum(at - starts[lo:hi], 0)  # bytes of the chunk in earlier pieces
        if before.any():
            part_hash *= np.array([pow(_BASE, int(x), 1 << 64) for x in before], np.uint64)
        out[lo:hi] += part_hash
    return out


def _letters(data: np.ndarray, ends: np.ndarray) -> str:
    h = _chunk_hashes(data, ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data)))
    return _ALPHABET[((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def _marks(data: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks end at a block size, and the rolling hashes there. Long texts are gone through in pieces."""
    at, values = [], []
    for start in range(0, len(data), _PIECE):
        begin = max(0, start - WINDOW + 1)
        rolled = _rolling(data[begin : start + _PIECE])[start - begin :]
        hit = np.flatnonzero(rolled % np.uint32(block) == block - 1)
        at.append(hit + (start + 1))
        values.append(rolled[hit])
    return np.concatenate(at), np.concatenate(values)


def fingerprint(text: str | None) -> str:
    """``block:letters:letters``; of null and empty texts ``3::``."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    size, block = len(data), LEAST_BLOCK
    if not size:
        return f"{block}::"
    many = lambda ends: len(ends) + (not len(ends) or int(ends[-1]) != size) > LETTERS
    while block * LETTERS * 2 < size:  # chunks are as long as a block on average: about where to begin
        block *= 2
    ends, rolled = _marks(data, block)
    while block > LEAST_BLOCK and not many(ends):
        block //= 2
        ends, rolled = _marks(data, block)

    def doubled(block):
        keep = rolled % np.uint32(block) == block - 1 if block < 1 << 32 else np.zeros(len(rolled), bool)
        return ends[keep], rolled[keep]

    while many(ends):
        block *= 2
        ends, rolled = doubled(block)
    return f"{block}:{_letters(data, ends)}:{_letters(data, doubled(2 * block)[0])}"


def _alike(a: str, b: str) -> float:
    """1 - insertions and deletions / total length, from the longest common subsequence (bit-parallel)."""
    if not a and not b:
        return 1.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & at.get(c, 0)
        row = (row + both | row - both) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(a: str | None, b: str | None) -> float | None:
    """Likeness of two fingerprints, 0 to 1; 0 at block sizes that don't go together, null for a null."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    pairs = [(x1, y1), (x2, y2)] if x == y else [(x1, y2)] if x == 2 * y else [(x2, y1)] if y == 2 * x else []
    return max([0.0, *(_alike(*p) for p in pairs)])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``. Each row by itself: equal texts get equal ones."""

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint, na_action=None)

    return docs.withColumn("fingerprint", prints(text))


def compare(a, b):
    """Column of the likeness of two fingerprint columns."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return alike(a, b)


def _in_turn(docs: DataFrame, each: int) -> DataFrame:
    """(key, text, part, tail) in ranges of descending ids, each sorted in one task.

    The ids are cut into ranges of about ``each`` bytes of text, at most
    ``RANGES`` of them (they grow beyond): every text gives its id once for
    each multiple of a unit of bytes that falls into it, so that quantiles of
    these ids are quantiles of bytes, whose number depends on the ranges only.
    A range is a task. The first row of a range also goes to the end of the
    range before it (tail 1), as what comes next there; that of the first range
    goes to the last. So each text is dealt once, and one row of each range
    twice. Rows that share an id stand in the order of a hash of their text
    (then of the text); an id with more bytes than a range is cut by that hash,
    and so are null ids, which come last. Keys are ids as text, empty for null.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("nth", F.xxhash64("text"))
    sizes = stored(docs.select("doc_id", "nth", F.octet_length("text").cast("long").alias("bytes")), "sizes")
    have = sizes.agg(F.sum("bytes").alias("all"), F.sum(F.when(F.col("doc_id").isNull(), F.col("bytes"))).alias("none")).head()
    total = max(1, have["all"] or 0)
    ranges = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each)))
    loose = max(1, (have["none"] or 0) * ranges // total)  # ranges of null ids
    unit = max(1, total // (ranges * 256))
    phase = F.pmod(F.xxhash64("doc_id", "nth"), F.lit(unit))
    marks = sizes.where("doc_id is not null").select(
        F.explode(F.array_repeat("doc_id", F.floor((F.col("bytes") + phase) / unit).cast("int"))).alias("id"))
    wanted = [i / ranges for i in range(1, ranges)]
    cuts = marks.stat.approxQuantile("id", wanted, 0.25 / ranges) if wanted else []
    # (~id, hash): where a range begins, in descending order of ids
    starts = {(~int(c), -(1 << 63)) for c in cuts}
    share = total // ranges + 1
    large = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > share)
    for r in large.collect():  # fewer than ranges
        pieces = -(-r.bytes // share)
        starts |= {(~r.doc_id, (i << 64) // pieces - (1 << 63)) for i in range(pieces)}
    starts = sorted(starts)
    by_id, by_hash = (np.array([s[c] for s in starts], np.int64) for c in (0, 1))
    ranges = len(starts) + 1 + loose

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, nth: pd.Series) -> pd.Series:
        """0 for the largest ids; null ids in ranges of their own."""
        known, nth = ids.notna().to_numpy(), nth.to_numpy()
        at = (len(starts) + 1 + np.floor((nth / 2.0**64 + 0.5) * loose)).astype(np.int32)
        turned = ~ids[known].astype("int64").to_numpy()
        lo, hi = np.searchsorted(by_id, turned, "left"), np.searchsorted(by_id, turned, "right")
        part, hashed = hi.copy(), nth[known]
        for a in np.unique(lo[hi > lo + 1]):  # an id with several ranges
            b, rows = int(np.searchsorted(by_id, by_id[a], "right")), (lo == a) & (hi > lo)
            part[rows] = a + np.searchsorted(by_hash[a:b], hashed[rows], "right")
        at[known] = part
        return pd.Series(np.minimum(at, ranges - 1), dtype="int32")

    # the first row of each range that has rows, and the range before it (of the first: the last)
    first = F.min_by(F.struct("doc_id", "nth"), F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "nth"))
    firsts = sizes.groupBy(part_of("doc_id", "nth").alias("part")).agg(first.alias("top"))
    around = Window.orderBy("part")  # a row a range
    everything = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = stored(firsts.select(
        "part", "top", F.coalesce(F.lag("part").over(around), F.max("part").over(everything)).alias("before")), "heads")
    own = F.struct("part", F.lit(0).alias("tail"))
    is_top = F.struct("doc_id", "nth").eqNullSafe(F.col("top"))
    copies = F.when(is_top, F.array(own, F.struct(F.col("before").alias("part"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    spread = docs.withColumn("part", part_of("doc_id", "nth")).join(heads, "part").select(
        "doc_id", "nth", "text", F.explode(copies).alias("to")).select("doc_id", "nth", "text", "to.part", "to.tail")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    return (
        spread.repartitionById(ranges, "part")
        .sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "nth", "text").select(key, "text", "part", "tail"))


def _follow(batches: Iterator[pa.RecordBatch], take) -> Iterator[pa.RecordBatch]:
    """``take`` of lists of (key, text, next text), a list for each batch of rows in turn."""
    last = None  # (key, text, part) of the row that waits for its next
    for batch in batches:
        met, held = [], 0
        for key, text, part, tail in zip(*(batch.column(c) for c in ("key", "text", "part", "tail")), strict=True):
            key, text, part = key.as_py(), text.as_py(), part.as_py()
            if last is not None and last[2] == part:
                met.append((last[0], last[1], text))
                held += len(text)
            last = None if tail.as_py() else (key, text, part)
            if held >= TURN_CHARS:
                yield take(met)
                met, held = [], 0
        yield take(met)


_ID = "if(key = '', null, cast(key as bigint)) as doc_id"


def with_next(docs: DataFrame, each: int = TASK_BYTES) -> DataFrame:
    """Each row of (doc_id, text) beside the next one's text, in descending order of doc_id.

    Rows: doc_id, text, next_text; the last has the first's, a single row its
    own. Repeated ids stand in the order of a hash of their text (then of the
    text), null ids behind all others likewise; null texts are empty ones;
    repeated rows follow each other. ``each`` is the bytes of text a task
    takes. An empty table gives no rows; other columns are not looked at.
    """

    def pairs(met):
        columns = list(zip(*met, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["key", "text", "next_text"])

    def each_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _follow(batches, pairs)

    return _in_turn(docs, each).mapInArrow(each_next, "key string, text string, next_text string").selectExpr(_ID, "text", "next_text")


def edited(text: str | None, following: str | None) -> str:
    """The last third (rounded down) replaced by as many characters of the following text, or all it has."""
    text = text or ""
    n = len(text) // 3
    return text[: len(text) - n] + (following or "")[:n]


def edit_study(docs: DataFrame, each: int = TASK_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; also the likeness to the next text's.

    Rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Order, nulls, repeats and the empty table are as in
    with_next; a single row's next is itself; the last row's is the first. Texts
    of any length are taken whole and stay in the task that sorts them, only
    the results leave it.
    """
    schema = pa.schema([("key", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def study(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}  # the next text's fingerprint, for its own row

        def take(met):
            rows = []
            for key, text, following in met:
                new = edited(text, following)
                mine = known.get(text) or fingerprint(text)
                then, after = fingerprint(following), fingerprint(new)
                known.clear()
                known[following] = then
                digest = hashlib.sha256(new.encode("utf-8", "replace")).hexdigest()
                rows.append((key, len(text), digest, mine, after, likeness(mine, after), likeness(mine, then)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return _follow(batches, take)

    kinds = "key string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_turn(docs, each).mapInArrow(study, kinds).selectExpr(_ID, *[k.split()[0] for k in kinds.split(", ")[1:]])
