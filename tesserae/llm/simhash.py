"""SimHash near-duplicates through an inverted index of byte positions.

A text's words (A-Z lower-cased, split at ASCII white space) give shingles;
each bit of the 64-bit fingerprint is set if it is set in over half of the
shingles' XXH64 values. Fingerprints link at ``MAX_BITS`` or fewer differing
bits.

Index. Two linked fingerprints differ in at most ``MAX_BITS`` of their eight
bytes, so at least 8 - MAX_BITS bytes are equal at equal positions. A posting
list is kept for each SHARED byte positions and the bytes there (single
positional bytes would have lists of n/256 members). A pair with e equal bytes
meets in C(e, SHARED) lists, so a linked pair in at least
C(8 - MAX_BITS, SHARED) of them: the guaranteed minimum. Lists that each pair
shares are tallied, pairs below the minimum (those with just SHARED equal
bytes) go, and the others are verified by counting differing bits.

Skew. Copies fall together first: the index holds distinct fingerprints. A
posting list longer than ``LIST_LIMIT`` emits no pairs; its members are heavy.
A linked pair either shares short lists only, where its tally is whole, or a
long one, so that both are heavy. Heavy ones are tied through six lists of
four positional bytes (two of four blocks of two; by pigeonhole a linked pair
shares one): such a list's members differ in the four other bytes only, so
each of them is filed under every way to blank ``MAX_BITS`` of those 32 bits,
and members filed alike are tied to the smallest of them. Two members are
linked exactly if they are filed alike at least once or twice removed by
links, so components stay exact, at a cost linear in the list's length.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import made, release_since, stored

WORDS = 3
MAX_BITS = 2
SEED = 42
SHARED = 5
LIST_LIMIT = 64
CHUNK = 1 << 16


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of a text; null, empty and blank texts give 0."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = tokens[at : at + CHUNK + words - 1]
        shingles = zip(*(part[i:] for i in range(words)), strict=False) if len(part) >= words else [part]
        h = np.array([digest(b" ".join(s), SEED) for s in shingles], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` without ``text`` and with ``fp`` (the fingerprint as a signed long)."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, words) for t in texts], np.uint64).astype(np.int64))

    return docs.withColumn("fp", fp(text)).drop(text)


#: Masks of every SHARED of the eight bytes, and of every two of the four blocks of two bytes.
_LISTS = [sum(0xFF << 8 * i for i in c) for c in combinations(range(8), SHARED)]
_BLOCKS = [sum(0xFFFF << 16 * i for i in c) for c in combinations(range(4), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, list, key): the posting lists of each fingerprint, one for each mask."""
    at = F.posexplode(F.lit(np.array([_signed(m) for m in masks], np.int64))).alias("list", "mask")
    return fps.select("fp", at).select("fp", "list", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def tallies(fps: DataFrame, list_limit: int = LIST_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(a, b, tally) of the pairs that meet in short lists, and the fingerprints (fp) in long ones.

    A list is named by a hash of its positions and bytes. Two lists under one
    name could only add pairs or make a list long, and both are seen through
    further on. Sizes are summed before they are shuffled, so a long list is
    never in one task; a short one has at most ``list_limit`` members.
    """
    keyed = _keyed(fps, _LISTS).select("fp", F.xxhash64("list", "key").alias("slot"))
    long = stored(keyed.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > list_limit).select("slot"), "long")
    members = keyed.join(long, "slot", "left_anti").groupBy("slot").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    members = members.select(F.array_sort("fps").alias("fps"))
    pairs = members.select(F.explode(F.flatten(F.transform("fps", lambda a, i: F.transform(
        F.slice("fps", i + 2, F.size("fps")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.*")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("tally")), keyed.join(long, "slot", "left_semi").select("fp").distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Links (a, b) with a < b that join the linked of the distinct ``fps`` (column fp).

    Which links come back depends on the lengths of lists: pairs that share
    short lists only are all there, those in long lists are tied by as few
    links as connect the same fingerprints, and no other. Null fingerprints
    have no links; an empty table gives none.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("four blocks guarantee two shared ones for up to 2 bits only")
    tallied, long = tallies(fps, list_limit)
    least = comb(8 - max_bits, SHARED)
    pairs = tallied.where(F.col("tally") >= least).where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")

    # heavy ones: blank max_bits of the bits outside the list's own
    posted = _keyed(stored(long, "heavy"), _BLOCKS)
    crowded = stored(posted.groupBy("list", "key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    blanks = F.lit(None).cast("array<bigint>")
    for i, m in enumerate(_BLOCKS):
        free = [b for b in range(64) if not m >> b & 1]
        masks = [_signed(~sum(1 << b for b in c) & (1 << 64) - 1) for c in combinations(free, max_bits)]
        blanks = F.when(F.col("list") == i, F.lit(np.array(masks, np.int64))).otherwise(blanks)
    filed = (
        posted.join(crowded, ["list", "key"]).select("fp", "list", F.explode(blanks).alias("mask"))
        .select("fp", "list", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    )
    heads = filed.groupBy("list", "mask", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    ties = (
        filed.join(heads, ["list", "mask", "rest"]).where("fp > a")
        .select("a", F.col("fp").alias("b")).distinct()
    )
    return pairs.unionByName(ties)


def components(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """(fp, label): for nodes with an edge, the smallest ``rep`` reachable.

    ``nodes`` has fp and rep (comparable), ``edges`` a and b. Each round takes
    the smallest label among the neighbours and then that label's own label
    (pointer jumping), so the rounds grow with the logarithm of the diameter.
    Rounds are stored tables; only a count of changes reaches the driver.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    ends = both.select(F.col("a").alias("fp")).distinct()
    state = stored(nodes.join(ends, "fp").select("fp", F.col("rep").alias("label"), F.col("fp").alias("root")), "labels")
    begun = made()
    # root: the fingerprint whose rep the label is
    for _ in range(most):
        best = F.min(F.struct("label", "root"))
        near = (
            both.join(state.select(F.col("fp").alias("b"), "label", "root"), "b")
            .groupBy("a").agg(best.alias("m")).select(F.col("a").alias("fp"), "m")
        )
        low = state.join(near, "fp", "left").select(
            "fp", F.col("label").alias("was"), F.least(F.struct("label", "root"), F.col("m")).alias("m")
        ).select("fp", "was", "m.label", "m.root")
        low = stored(low, "low")
        up = low.select(F.col("fp").alias("root"), F.struct(F.col("label").alias("label"), F.col("root").alias("root")).alias("u"))
        new = low.join(up, "root").select(
            "fp", "was", F.least(F.struct("label", "root"), F.col("u")).alias("m")
        ).select("fp", "was", "m.label", "m.root")
        new = stored(new, "labels")
        release_since(begun, made()[-1])
        if new.where("label < was").limit(1).count() == 0:
            return new.select("fp", "label")
        state = new.drop("was")
    raise RuntimeError(f"components did not settle in {most} rounds")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
           max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of each row, and (fp, component) of each distinct fingerprint."""
    begun = made()
    prints = stored(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", words), "prints")
    prints_at = made()[-1]
    classes = stored(prints.groupBy("fp").agg(F.min("key").alias("rep")), "classes")
    # a class of null keys only stands behind all others
    nodes = classes.select("fp", F.struct(F.col("rep").isNull().alias("none"), "rep").alias("rep"))
    labels = components(nodes, links(classes.select("fp"), max_bits))
    named = stored(
        classes.join(labels, "fp", "left")
        .select("fp", F.coalesce(F.col("label.rep"), F.col("rep")).alias("component")), "named")
    release_since(begun, prints_at, made()[-1])
    return prints, named


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: key, fp, component (smallest key reachable).

    Rows with a null key have a fingerprint and take part; a component of
    null keys only has a null component. Null, empty and blank texts have
    fingerprint 0. Repeated rows and ties fall into one component. The shingles of
    a very long text are hashed CHUNK at a time, all of them. Other
    columns are not looked at.
    """
    prints, named = groups(docs, key, text, words, max_bits)
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def one_of_each(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each near-duplicate group.

    The row with the smallest doc_id of its group stays; of rows that repeat
    that id, the first by a hash of the text, then by the row as JSON. Of
    groups of null ids only, one row for each fingerprint stays. Columns of any
    name and type come back as they are; an empty table stays one.
    """
    prints, named = groups(docs, words=words, max_bits=max_bits)
    return kept_rows(docs, named.select(F.col("component").alias("key")), fingerprints(
        docs.where("doc_id is null").select(F.struct(*docs.columns).alias("row"), "text"), "text", words).join(
            named.where("component is null").select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))


def kept_rows(docs: DataFrame, heads: DataFrame, loose: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is a ``key`` of ``heads``, one for each id, and the ``row``s of ``loose``.

    Of rows that repeat an id, the one whose text has the smallest hash stays
    (then the smallest JSON form of the row). Columns may have any name or type.
    """
    own = F.struct(*docs.columns)
    rows = docs.where("doc_id is not null").select(own.alias("row"), F.col("doc_id").alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row.text"), F.to_json("row")))
    kept = rows.join(heads.where("key is not null").distinct(), "key", "left_semi").withColumn("nth", nth).where("nth = 1")
    return kept.select("row.*").unionByName(loose.select("row.*"))
