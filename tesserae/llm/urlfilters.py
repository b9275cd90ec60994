"""URL filters: rules first, then a list of addresses held as a cascade of Bloom filters.

An address is a URL's host and path. The cascade is built over all addresses
of a corpus (the universe): level 0 holds the listed ones, level 1 those of the
others that pass level 0, level 2 the listed ones that pass level 1, and so on
until none is left over. The first level that an address does not pass tells
whether it is listed, without error for every address of the universe and
without a join. Others may be told wrong either way.

Scale. Addresses are dealt into shards by a hash, so a shard is as large as
any other whatever the hosts, and is built in one task. Shards are filed in
parts of about PART_BYTES in the shared folder. Tasks read the parts that their
rows ask for and hold HELD_PARTS at once; a cascade of more parts than that is
asked by rows that were dealt by part, a part with many rows (one address may
have a third of them) over many tasks.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, made, new_folder, release_since, stored

KEYS_A_SHARD = 1 << 13
PART_BYTES = 1 << 23
HELD_PARTS = 8
ROWS_A_TASK = 1 << 20
MOST_LEVELS = 200

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OWN = ("host", "path", "rule", "verdict")


class Rule(NamedTuple):
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


class Cascade(NamedTuple):
    """Where a cascade lies and how it is dealt."""

    folder: str
    shards: int
    parts: int
    seed: int


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(verdict, rule) of the longest rule that fits, null where none does.

    A rule is as long as its host and path together; of two as long as each
    other that with the longer host goes first.
    """
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for r in sorted(set(rules), key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.host + r.path).alias("rule"))).otherwise(found)
    return found


# ---- the cascade


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of ``x`` (a finaliser of 64-bit hashes)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b = _mixed(h1 + salt), _mixed(h2 ^ salt) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def _passes(filter_: tuple[int, int, np.ndarray], level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    hashes, bits, held = filter_
    at = _places(h1, h2, level, hashes, bits)
    return (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def levels_of(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """The levels, as (hashes, bits, bytes), that tell the listed of these distinct pairs from the others.

    Level 0 lets through a share of sqrt(1/2) * listed / others, the further
    ones half each, which makes the sum of all levels least. No listed ones
    need no level.
    """
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    out: list[tuple[int, int, np.ndarray]] = []
    while len(inside):
        if len(out) == MOST_LEVELS:
            raise RuntimeError(f"addresses are not told apart by {MOST_LEVELS} levels")
        rate = 0.5 if out else min(0.5, math.sqrt(0.5) * len(inside) / max(1, len(outside)))
        bits = max(8, math.ceil(-len(inside) * math.log(rate) / math.log(2) ** 2))
        hashes = max(1, round(-math.log2(rate)))
        held = np.zeros(-(-bits // 8), np.uint8)
        at = _places(h1[inside], h2[inside], len(out), hashes, bits).ravel()
        np.bitwise_or.at(held, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        out.append((hashes, bits, held))
        inside, outside = outside[_passes(out[-1], len(out) - 1, h1[outside], h2[outside])], inside
    return out


def told(levels: list[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which pairs are listed: the first level that one fails, or the end, decides by its parity."""
    last, open_ = np.zeros(len(h1), np.int64), np.arange(len(h1))
    for level, filter_ in enumerate(levels):
        open_ = open_[_passes(filter_, level, h1[open_], h2[open_])]
        last[open_] = level + 1
    return last % 2 == 1


def _hashes(key: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), key), F.xxhash64(F.lit(2 * seed + 1), key)


def _shard(h1: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(h1), F.lit(shards)).cast("int")


def build(universe: DataFrame, listed: DataFrame, key: str = "key") -> Cascade:
    """The cascade of those ``listed`` keys that are in ``universe``, over all keys of ``universe``.

    Repeats count once and null keys are left out, in both tables. Listed keys
    outside the universe need no place in it. Two keys, one listed and one not,
    with the same 128 bits of hashes would not be told apart: then all hashes
    are taken anew with another seed. Empty tables give a cascade that lists nothing.
    """
    begun = made()
    flagged = universe.select(F.col(key).alias("key"), F.lit(True).alias("seen"), F.lit(False).alias("listed")).unionByName(
        listed.select(F.col(key).alias("key"), F.lit(False).alias("seen"), F.lit(True).alias("listed")))
    keys = stored(
        flagged.where("key is not null").groupBy("key").agg(F.max("seen").alias("seen"), F.max("listed").alias("listed"))
        .where("seen").select("key", "listed"), "universe")
    total = keys.agg(F.count("*").alias("n"), F.count_if("listed").alias("listed")).head()
    shards = max(1, -(-total.n // KEYS_A_SHARD))
    a_key = 1.44 * math.log2(max(2, total.n / max(1, total.listed))) + 6
    parts = min(shards, max(1, math.ceil(total.listed * a_key / 8 / PART_BYTES)))
    for seed in range(8):
        h1, h2 = _hashes(F.col("key"), seed)
        pairs = keys.select(h1.alias("h1"), h2.alias("h2"), "listed")
        mixed = pairs.groupBy("h1", "h2").agg(F.min("listed").alias("a"), F.max("listed").alias("b")).where("a <> b")
        if not mixed.limit(1).count():
            break
    else:
        raise RuntimeError("keys have the same hashes under eight seeds")

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        h = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        made_ = levels_of(*h, pdf["listed"].to_numpy(bool))
        shard = int(pdf["shard"].iloc[0])
        rows = [(shard * parts // shards, shard, i, n, bits, held.tobytes()) for i, (n, bits, held) in enumerate(made_)]
        return pd.DataFrame(rows, columns=["part", "shard", "level", "hashes", "bits", "held"])

    folder = new_folder(universe.sparkSession, "cascade")
    (pairs.withColumn("shard", _shard(F.col("h1"), shards)).groupBy("shard")
     .applyInPandas(levels, "part int, shard int, level int, hashes int, bits long, held binary")
     .write.partitionBy("part").parquet(folder))
    release_since(begun)
    return Cascade(folder, shards, parts, seed)


class _Parts:
    """The parts of a cascade in a task, HELD_PARTS at once."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, OrderedDict()

    def __getitem__(self, part: int) -> dict[int, list[tuple[int, int, np.ndarray]]]:
        if part not in self.held:
            while len(self.held) >= HELD_PARTS:
                self.held.popitem(last=False)
            self.held[part] = self._read(part)
        self.held.move_to_end(part)
        return self.held[part]

    def _read(self, part: int) -> dict[int, list[tuple[int, int, np.ndarray]]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = filesystem(f"{self.folder}/part={part}")
        shards: dict[int, list] = {}
        for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):  # no folder: nothing is listed there
            if info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as f:
                    for r in sorted(pq.ParquetFile(f).read().to_pylist(), key=lambda r: r["level"]):
                        shards.setdefault(r["shard"], []).append((r["hashes"], r["bits"], np.frombuffer(r["held"], np.uint8)))
        return shards


def _asker(cascade: Cascade):
    """The UDF (shard, h1, h2) -> listed."""
    parts = _Parts(cascade.folder)

    @F.pandas_udf("boolean")
    def listed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for shard, h1, h2 in batches:
            shard, out = shard.to_numpy(np.int64), np.zeros(len(shard), bool)
            a, b = h1.to_numpy(np.int64).view(np.uint64), h2.to_numpy(np.int64).view(np.uint64)
            order = np.argsort(shard, kind="stable")
            starts = np.flatnonzero(np.diff(shard[order], prepend=-1))
            for at in np.split(order, starts[1:]) if len(order) else []:
                s = int(shard[at[0]])
                out[at] = told(parts[s * cascade.parts // cascade.shards].get(s, []), a[at], b[at])
            yield pd.Series(out)

    return listed


def with_listed(rows: DataFrame, cascade: Cascade, key: Column, name: str = "listed") -> DataFrame:
    """``rows`` and whether ``key`` is listed; a null key is not."""
    own = [c for c in rows.columns if c != name]
    h1, h2 = _hashes(key, cascade.seed)
    asked = rows.select(F.struct(*own).alias("row"), key.isNotNull().alias("is"), h1.alias("h1"), h2.alias("h2"))
    asked = asked.withColumn("shard", _shard(F.col("h1"), cascade.shards))
    if cascade.parts > HELD_PARTS:
        asked = _dealt(asked, F.floor(F.col("shard") * cascade.parts / cascade.shards).cast("int"), cascade.parts)
    return asked.select("row.*", (F.col("is") & _asker(cascade)("shard", "h1", "h2")).alias(name))


def _dealt(rows: DataFrame, part: Column, parts: int) -> DataFrame:
    """``rows`` in tasks of one part each, a part with more than ROWS_A_TASK rows in several."""
    counts = dict(rows.groupBy(part.alias("part")).count().collect())  # a row a part of the cascade
    tasks = [max(1, -(-counts.get(p, 0) // ROWS_A_TASK)) for p in range(parts)]
    first = np.cumsum([0, *tasks])
    at = lambda xs: F.lit(np.array(xs, np.int64))[part]
    task = at(first[:-1]) + F.pmod(F.monotonically_increasing_id(), at(tasks))
    return rows.repartitionById(int(first[-1]), task.cast("int"))


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url", key: str = "key") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The longest rule that fits decides; where none fits, an address (host and
    path) in ``listed`` is blocked and any other allowed. The universe is every
    address of ``pages``.

    Null and empty URLs and those without ``://`` have an empty host and path,
    an address like others. Repeated rows each get their verdict; ties between
    rules are settled by ``rule_of``; URLs of any length are taken whole. Columns named like the new ones are
    replaced, others stay. Empty tables give none.
    """
    own = [c for c in pages.columns if c not in _OWN]
    at = pages.select(F.struct(*own).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"))
    at = at.withColumn("address", F.concat("host", "path"))
    cascade = build(at.select(F.col("address").alias("key")), listed.select(F.col(key).alias("key")))
    at = with_listed(at, cascade, F.col("address")).withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("by.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return at.select("page.*", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"))


def addresses_with_words(pages: DataFrame, words: list[str], url: str = "url") -> DataFrame:
    """A list made of the corpus itself: (key) of the addresses with one of ``words`` between dots and hyphens of the host."""
    parts = F.split(host_of(url), "[.-]")
    return pages.where(F.arrays_overlap(parts, F.lit(words))).select(F.concat(host_of(url), path_of(url)).alias("key"))
