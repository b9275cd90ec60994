"""Spelling variants: words that differ by one code point, and the frequent form of each.

Words are runs of Latin letters; counts come from all texts. Two words are near
if one inserted, deleted or replaced code point makes one of the other.

Method. Words are laid out as padded matrices of code points, once from the
left and once from the right. A tile compares a block of words with a block:
column by column, the common prefix of each pair grows while the columns are
equal, and the common suffix likewise from the right. A pair differs by a single
edit exactly if prefix and suffix together reach the longer length less one.

Which blocks meet. If the longer of two near words has c code points, its prefix or its suffix in
common has at least c // 2. So a word is filed, as one of c = its length and
one of c = its length + 1, under its first and under its last c // 2 code
points, and tiles compare words filed alike. A file of more than BLOCK words is
cut into blocks by a hash, and each pair of blocks is a tile of its own; small
files share a block. A pair that meets under both ends counts under the first.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import made, release, release_since, stored

LEAST_CHARS = 6
LEAST_COUNT = 5
TIMES = 5
DELETE_ONE_IN = 199
BLOCK = 512
#: A block of very long words has fewer of them.
BLOCK_BYTES = 1 << 24
HELD_WORDS = 1 << 19

#: Latin-1 bytes: A-Z become a-z, what is no letter of the runs becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_of(doc_id: object, text: str | None, least: int = LEAST_CHARS, one_in: int = DELETE_ONE_IN) -> Iterator[tuple[bytes, int]]:
    """(word in Latin-1, occurrences) of the runs of a text, each run's code point deleted where the hash says so.

    Runs are maximal in ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased. Null has none.
    """
    begun = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    # what Latin-1 lacks becomes a question mark, which ends a run as it should
    for word, n in Counter((text or "").encode("latin-1", "replace").translate(_FOLD).split()).items():
        if len(word) >= least:
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
            if h % one_in == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < least:
                    continue
            yield word, n


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_CHARS,
               least_count: int = LEAST_COUNT, one_in: int = DELETE_ONE_IN) -> DataFrame:
    """(word, n) of the words of at least ``least`` code points that occur ``least_count`` times or more.

    Each task adds up HELD_WORDS words at most before it hands them on.
    """
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}

        def handed():
            return pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})

        for pdf in batches:
            for doc_id, t in zip(pdf["key"], pdf["text"], strict=True):
                for word, n in words_of(doc_id, t, least, one_in):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    # as text, so that ids stay whole where some are null
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _matrices(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points, padded behind and padded in front."""
    left = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    right = np.frombuffer(b"".join(w.rjust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    return left, right


def _run(a: np.ndarray, b: np.ndarray, columns: range) -> np.ndarray:
    """How many columns from the first on are equal, for each row of ``a`` against each of ``b``."""
    alive = np.ones((len(a), len(b)), bool)
    length = np.zeros((len(a), len(b)), np.uint32)
    for c in columns:
        alive &= a[:, c][:, None] == b[:, c][None, :]
        length += alive
        if not alive.any():
            break
    return length


def tile(a: list[bytes], b: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(near, prefix) for each word of ``a`` against each of ``b``; the longer of two near ones has ``width`` code points.

    near: prefix and suffix in common reach ``width`` - 1, and the words differ.
    """
    (al, ar), (bl, br) = _matrices(a, width), _matrices(b, width)
    prefix = _run(al, bl, range(width))
    suffix = _run(ar, br, range(width - 1, -1, -1))
    long = (np.array([len(w) for w in a]) == width)[:, None] | (np.array([len(w) for w in b]) == width)[None, :]
    return long & (prefix < width) & (prefix + suffix >= width - 1), prefix


def near_pairs(words: DataFrame, least: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): each pair of near words both ways, from distinct (word, n) of ``least`` code points or more."""
    chars = F.char_length("word")
    classes = words.select("word", "n", F.explode(F.array(chars, chars + 1)).alias("width"))
    half = F.floor(F.col("width") / 2).cast("int")
    filed = classes.select(
        "word", "n", "width",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.left("word", half).alias("key")),
                          F.struct(F.lit(1).alias("side"), F.right("word", half).alias("key")))).alias("at")).select("word", "n", "width", "at.*")
    by = ["width", "side", "key"]
    a_block = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / F.col("width"))))
    sizes = filed.groupBy(*by).agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / a_block).cast("int"))
    placed = filed.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    tiles = placed.select("word", "n", "blocks", *by, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select(
        "word", "n", *by, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "blocks")
    own = [*by, "i", "j"]
    dealt = tiles.repartition(*own).sortWithinPartitions(*own, "block", "word")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for width, side, rows in _blocks(batches, own, block):
            found = _near_in(rows, width, side)
            if len(found):
                yield found

    return dealt.mapInPandas(compared, "word string, near string, near_n long")


def _blocks(batches: Iterator[pd.DataFrame], own: list[str], block: int) -> Iterator[tuple[int, int, pd.DataFrame]]:
    """Whole tiles of sorted rows, small ones together up to ``block`` rows, as (width, side, rows with ``tile``)."""
    rest = None
    for pdf in _with_end(batches):
        if pdf is not None:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if rest is None or not len(rest):
            continue
        keys = rest[own]
        new = (keys != keys.shift()).any(axis=1).to_numpy()
        new[0] = True
        starts = np.flatnonzero(new)
        # the last tile may go on in the next batch
        stop = len(rest) if pdf is None else starts[-1]
        rest["tile"] = np.cumsum(new)
        bounds, at = [*starts[starts < stop], stop], 0
        kinds = rest[["width", "side", "blocks"]].to_numpy()
        while at < len(bounds) - 1:
            to, most = at + 1, min(block, BLOCK_BYTES // int(kinds[bounds[at]][0]))
            # files of one block each may be looked at together
            while (to < len(bounds) - 1 and bounds[to + 1] - bounds[at] <= most and kinds[bounds[at]][2] == 1
                   and (kinds[bounds[to]] == kinds[bounds[at]]).all()):
                to += 1
            yield int(kinds[bounds[at]][0]), int(kinds[bounds[at]][1]), rest.iloc[bounds[at]:bounds[to]]
            at = to
        rest = rest.iloc[stop:].drop(columns="tile").reset_index(drop=True)


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _near_in(rows: pd.DataFrame, width: int, side: int) -> pd.DataFrame:
    """The near pairs, both ways, of some tiles of one width and side."""
    words = [w.encode("latin-1") for w in rows["word"]]
    n, tile_no, block = (rows[c].to_numpy() for c in ("n", "tile", "block"))
    if rows["i"].iloc[0] != rows["j"].iloc[0]:  # a tile of two blocks, by itself
        cut = int(np.searchsorted(block, rows["j"].iloc[0]))
        lead, other = np.arange(cut), np.arange(cut, len(words))
    else:
        lead = other = np.arange(len(words))
    near, prefix = tile([words[i] for i in lead], [words[i] for i in other], width)
    near &= tile_no[lead][:, None] == tile_no[other][None, :]
    if lead is other:
        near = np.triu(near, 1)
    if side:
        near &= prefix < width // 2
    a, b = near.nonzero()
    a, b = lead[a], other[b]
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    word = rows["word"].to_numpy()
    return pd.DataFrame({"word": word[x], "near": word[y], "near_n": n[y]})


def variants(words: DataFrame, times: int = TIMES, least: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of the distinct (word, n).

    form: the near word of largest n, ties to the smallest in code-point order,
    if its n is at least ``times`` this word's. root: where forms lead to in the end.
    """
    if times < 2:
        raise ValueError("forms could lead in a circle")
    begun = made()
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_pairs(words, least, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.n") >= times * F.col("n")
    formed = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.n")).cast("long").alias("form_n")), "forms")
    kept = [made()[-1]]
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    # a form's n is ``times`` as large at each step: few rounds, each of which doubles the steps taken
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release_since(begun, *kept, made()[-1])
        roots = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return formed.join(roots, "word", "left").select(
                "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_CHARS,
                      least_count: int = LEAST_COUNT, times: int = TIMES, one_in: int = DELETE_ONE_IN) -> DataFrame:
    """A row a word of ``docs``: word, form, root, n, n_near, form_n.

    Null and empty texts have no words, a null id hashes as an empty one,
    repeated rows count as often as they stand there, ties are settled by code-point order. Very
    long texts are taken whole; a word of any length is compared whole. Other
    columns, whatever their names, are not looked at; an empty table gives no row.
    """
    words = stored(vocabulary(docs, key, text, least, least_count, one_in), "vocabulary")
    held = made()[-1]
    out = variants(words, times, least)
    release([held])  # the rows come from other stored tables by now
    return out
