"""Ranked lexical search over K2-treaps of the term-document grid.

A shard is a range of documents: a grid with a row for each of its terms and a
column for each document, whose cells hold impacts. The grid is a quadtree in
breadth-first order: four bits for each non-empty cell, one a quarter, and for
each non-empty cell the largest impact inside, kept as what it lacks to its
parent's. Frequent terms have the first rows and long documents the first
columns, so that full and like cells lie together.

A query's terms are rows. All rows' paths go down the tree together: a range of
columns is as good as the weighted sum of the largest impacts that the rows
have there, the best ranges are opened first, in batches that grow, and what
can't reach the k best so far is left closed. A range of one column is a
document and its sum the score. So the answer is exact.

Scale. Shards are built where the documents are read, without a shuffle, and
are bounded by their number of cells. Document frequencies are sums over
shards. Each shard gives its k best an item, of which the k best are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from .common import filesystem, made, release_since, stored

K = 50
CELLS_A_SHARD = 1 << 20
ITEMS_AT_ONCE = 32
FIRST_BATCH = 32
#: Shards whose k best meet before those of all shards do.
SHARDS_A_GROUP = 1000

#: UTF-8 bytes: A-Z become a-z, what ends a term becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text with repeats, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Totals(NamedTuple):
    """Documents with a term, and all terms with repeats."""

    docs: int
    terms: int


def impact(tf: np.ndarray, n: np.ndarray, totals: Totals) -> np.ndarray:
    """The score of ``tf`` occurrences in documents of ``n`` terms, before a term's weight; in 64-bit integers."""
    m = 50 + 50 * n * totals.docs // max(1, totals.terms)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


# ---- a shard


class Treap:
    """The quadtree of one grid: children bits, and the largest impact of each node."""

    def __init__(self, height: int, bits: np.ndarray, largest: np.ndarray):
        self.height, self.largest = height, largest
        words = np.zeros(-(-len(bits) // 8) + 1, np.uint64)
        words.view(np.uint8)[: len(bits)] = bits
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)])

    def children(self, nodes: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``nodes`` have a child in their ``quarter``, those children)."""
        at = 4 * nodes + quarter
        word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
        there = np.flatnonzero(word >> bit & np.uint64(1))
        at, word, bit = at[there], word[there], bit[there]
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return there, self.before[at >> 6] + np.bitwise_count(word & upto)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at every second place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def tree(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(height, bits, lacks) of the cells of a grid, compressed; no cell comes twice."""
    height = max(1, int(rows.max(initial=0)).bit_length(), int(columns.max(initial=0)).bit_length())
    code = _spread(rows) << np.uint64(1) | _spread(columns)
    order = np.argsort(code)
    code, value = code[order], values[order]
    bits, lacks = [], []
    for _ in range(height):
        parent = code >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(code) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
        level = np.zeros(4 * len(starts), np.uint8)
        level[4 * group + (code & np.uint64(3)).astype(np.int64)] = 1
        above = np.maximum.reduceat(value, starts) if len(code) else value
        bits.append(level)
        lacks.append(above[group] - value)
        code, value = parent[starts], above
    lacks = np.concatenate([value, *reversed(lacks)]).astype(np.uint32)
    packed = np.packbits(np.concatenate(bits[::-1]), bitorder="little")
    squeeze = zstandard.ZstdCompressor(3).compress
    # by byte planes: most of the upper ones are zero
    return height, squeeze(packed.tobytes()), squeeze(np.ascontiguousarray(lacks.view(np.uint8).reshape(-1, 4).T).tobytes())


def open_tree(height: int, bits: bytes, lacks: bytes) -> Treap:
    """The tree as it is searched."""
    unpack = zstandard.ZstdDecompressor().decompress
    packed = np.frombuffer(unpack(bits), np.uint8)
    lack = np.ascontiguousarray(np.frombuffer(unpack(lacks), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
    parent = np.flatnonzero(np.unpackbits(packed, bitorder="little")) >> 2
    largest, end = lack.copy(), 1
    # a level at a time: the nodes before ``end`` are known, and their children come next
    while end < len(lack):
        upto = int(np.searchsorted(parent, end))  # children of nodes before end
        largest[end : upto + 1] = largest[parent[end - 1 : upto]] - lack[end : upto + 1]
        end = upto + 1
    return Treap(height, packed, largest)


class _Shard:
    """Documents as they come, until there are enough of them."""

    def __init__(self):
        self.row: dict[bytes, int] = defaultdict()
        self.row.default_factory = self.row.__len__
        self.rows, self.tf, self.sizes, self.n, self.keys = [], [], [], [], []

    def add(self, key: object, text: str | None) -> None:
        terms = terms_of(text)
        found = Counter(terms)
        self.rows.extend(map(self.row.__getitem__, found))
        self.tf.extend(found.values())
        self.sizes.append(len(found))
        self.n.append(len(terms))
        self.keys.append(key)

    def record(self, totals: Totals) -> dict:
        n, sizes = np.array(self.n, np.int64), np.array(self.sizes)
        rank = {i: r for r, i in enumerate(sorted(range(len(n)), key=lambda i: (self.keys[i] is None, self.keys[i])))}
        order = sorted(range(len(n)), key=lambda i: (-self.n[i], rank[i]))
        column = np.empty(len(n), np.int64)
        column[order] = np.arange(len(n))
        local, tf = np.array(self.rows, np.int64), np.array(self.tf, np.int64)
        df = np.bincount(local, minlength=len(self.row))
        by_df = np.argsort(-df, kind="stable")
        row = np.empty(len(df), np.int64)
        row[by_df] = np.arange(len(df))
        doc = np.repeat(np.arange(len(n)), sizes)
        height, bits, lacks = tree(row[local], column[doc], impact(tf, n[doc], totals))
        names = list(self.row)
        return {
            "keys": [self.keys[i] for i in order], "terms": [names[i].decode("utf-8", "replace") for i in by_df], "df": df[by_df].tolist(),
            "height": height, "bits": bits, "lacks": lacks}


class Index(NamedTuple):
    """Shards as stored rows, and the totals over all documents."""

    shards: DataFrame
    totals: Totals


def totals_of(docs: DataFrame, text: str = "text") -> Totals:
    n = F.coalesce(F.regexp_count(text, F.lit(_TERM)), F.lit(0)).cast("long")
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).head()
    return Totals(row.docs, row.terms or 0)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", cells_a_shard: int = CELLS_A_SHARD) -> Index:
    """The index of all rows of ``docs``: every term of every whole text.

    A shard has ``cells_a_shard`` cells and those of one document at most.
    Null and empty texts have a column without cells. Null keys stand behind
    all others; rows that repeat a key are documents of their own.
    """
    totals = totals_of(docs, text)
    kind = docs.schema[key].dataType
    schema = StructType([
        StructField("keys", ArrayType(kind)), StructField("terms", ArrayType(StringType())), StructField("df", ArrayType(IntegerType())),
        StructField("height", IntegerType()), StructField("bits", BinaryType()), StructField("lacks", BinaryType())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = _Shard(), None
        for batch in batches:
            if types is None:
                types = pa.schema([
                    ("keys", pa.list_(batch.schema.field(0).type)), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())),
                    ("height", pa.int32()), ("bits", pa.binary()), ("lacks", pa.binary())])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.add(k, t.as_py())
                if len(held.rows) >= cells_a_shard:
                    yield pa.RecordBatch.from_pylist([held.record(totals)], types)
                    held = _Shard()
        if held.keys:
            yield pa.RecordBatch.from_pylist([held.record(totals)], types)

    return Index(stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(shards, schema), "k2treap"), totals)


# ---- search


class _Queries:
    """Some items as flat arrays, in the order of items: of which item, of which row and of which weight each term is."""

    def __init__(self, items: list[tuple[int, list[str], list[int]]], row: dict[str, int]):
        flat = [(i, row[t], w) for i, terms, weights in items for t, w in zip(terms, weights, strict=True) if t in row]
        self.item, self.row, self.weight = (np.array([f[c] for f in flat], np.int64) for c in range(3))


def _first(item: np.ndarray, most: int) -> np.ndarray:
    """Which places of sorted ``item`` are among the first ``most`` of their item."""
    return np.arange(len(item)) - np.searchsorted(item, item) < most


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def best_of(treap: Treap, queries: _Queries, rank: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best of each item as rows (item, score, order, column), sorted.

    ``rank`` is each column's place among the shard's keys. ``best`` has those
    known before, with an even order: twice the number of the shard's keys
    before theirs; the shard's own get twice their rank plus one.
    """
    height, n_items = treap.height, 1 + max(int(queries.item.max(initial=-1)), int(best[:, 0].max(initial=-1)))
    # the smallest rank in each range of columns, a level each
    low = [np.full(1 << height, np.iinfo(np.int64).max >> 1)]
    low[0][: len(rank)] = 2 * rank[: 1 << height] + 1  # documents without cells may lie outside
    for _ in range(height):
        low.append(low[-1].reshape(-1, 2).min(axis=1))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in reversed(low)])])[:-1]
    lowest = np.concatenate(low[::-1])

    # open ranges: item, level, prefix of the column, bound, where their paths lie
    item, counts = np.unique(queries.item, return_counts=True)
    term = np.arange(len(queries.item))
    node = np.zeros(len(term), np.int64)
    level, prefix = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    start = np.cumsum(counts) - counts
    bound = np.full(len(item), np.iinfo(np.int64).max >> 1)
    batch = FIRST_BATCH
    while len(item):
        # the worst of k known ones is what a range has to beat, by score or by key
        floor, last = np.zeros(n_items, np.int64), np.full(n_items, -1)
        size = np.bincount(best[:, 0], minlength=n_items)
        full = np.flatnonzero(size >= k)
        worst = best[(np.cumsum(size) - 1)[full]]
        floor[full], last[full] = worst[:, 1], worst[:, 2]
        smallest = lowest[starts[level] + prefix]
        keep = (bound > floor[item]) | (bound == floor[item]) & (smallest < last[item])
        order = np.flatnonzero(keep)
        order = order[np.lexsort((smallest[order], -bound[order], item[order]))]
        now = _first(item[order], batch)
        chosen, later = order[now], np.sort(order[~now])
        # open the chosen: both halves, a path each row that has cells there
        paths = _ranges(start[chosen], counts[chosen])
        owner = np.repeat(np.arange(len(chosen)), counts[chosen])
        down = height - 1 - level[chosen][owner]
        upper = 2 * (queries.row[term[paths]] >> down & 1)
        new = []
        for half in (0, 1):
            there, child = treap.children(node[paths], upper + half)
            who, begun, many = np.unique(owner[there], return_index=True, return_counts=True)
            path_term = term[paths[there]]
            value = queries.weight[path_term] * treap.largest[child]
            total = np.add.reduceat(value, begun) if len(begun) else value
            c = chosen[who]
            new.append((item[c], level[c] + 1, 2 * prefix[c] + half, total, many, path_term, child))
        grown = [np.concatenate(x) for x in zip(*new, strict=True)]
        leaf = grown[1] == height
        done = leaf & (grown[3] > 0)
        if done.any():
            column = grown[2][done]
            best = np.concatenate([best, np.stack([grown[0][done], grown[3][done], 2 * rank[column] + 1, column], axis=1)])
            best = best[np.lexsort((best[:, 2], -best[:, 1], best[:, 0]))]
            best = best[_first(best[:, 0], k)]
        held = _ranges(start[later], counts[later])
        inner = ~leaf
        cells = np.repeat(inner, grown[4])
        term, node = np.concatenate([term[held], grown[5][cells]]), np.concatenate([node[held], grown[6][cells]])
        item, level, prefix, bound, counts = (
            np.concatenate([old[later], x[inner]]) for old, x in zip((item, level, prefix, bound, counts), grown[:5], strict=True))
        start = np.cumsum(counts) - counts
        batch *= 2
    return best


def _read_items(folder_files: list[str]) -> Iterator[list[tuple[int, list[str], list[int]]]]:
    """The items of stored files, ITEMS_AT_ONCE at a time, as (number, terms, weights)."""
    import pyarrow.parquet as pq

    for uri in folder_files:
        store, path = filesystem(uri)
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(ITEMS_AT_ONCE):
                yield [(r["number"], r["terms"], r["weights"]) for r in batch.to_pylist()]


def weights_of(index: Index, items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, weight) of the distinct terms of ``items`` that a document has, with a weight above 0."""
    own = items.select(F.col(item).alias("item"), F.explode(F.array_distinct(_terms(F.col(text)))).alias("term")).distinct()
    of_shards = index.shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = of_shards.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.totals.docs + 2)) / (2.0 * F.col("df") + 1))).cast("long")
    return own.join(df, "term").select("item", "term", weight.alias("weight")).where("weight > 0")


def _terms(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(_TERM), F.lit(0)), F.array().cast("array<string>"))


def search(index: Index, items: DataFrame, item: str = "item_id", text: str = "text", key: str = "doc_id", k: int = K) -> DataFrame:
    """(item, rank, key, score): the ``k`` documents of highest score above 0 for each of ``items``.

    Terms count once an item; equal scores go by ascending key, null keys last.
    Items that repeat an id are one item with the terms of all of them; a null
    id is an id. Items without terms, and terms that no document has, find
    nothing, and so does an empty index. Texts of any length are taken whole;
    other columns, whatever their names, are not looked at. A task holds one
    shard, the paths of ITEMS_AT_ONCE items, and k rows for every item.
    """
    begun = made()
    asked = stored(
        weights_of(index, items, item, text).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("t"))
        .select(F.monotonically_increasing_id().alias("number"), "item", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "asked")
    files = sorted(asked.inputFiles())
    kind = index.shards.schema["keys"].dataType.elementType

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple[int, object]]] = {}
        of_keys = None
        for batch in batches:
            of_keys = batch.schema.field("keys").type.value_type
            for i in range(batch.num_rows):
                shard = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                row = {t: r for r, t in enumerate(shard["terms"])}
                treap = open_tree(shard["height"], shard["bits"], shard["lacks"])
                _search_shard(treap, row, shard["keys"], files, known, k)
        if known:
            flat = [(number, score, doc) for number, found in known.items() for score, doc in found]
            for at in range(0, len(flat), 1 << 16):
                part = list(zip(*flat[at : at + (1 << 16)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], of_keys)], ["number", "score", "key"])

    schema = StructType([StructField("number", asked.schema["number"].dataType), StructField("score", asked.schema["number"].dataType), StructField("key", kind)])
    found = index.shards.select("keys", "terms", "height", "bits", "lacks").mapInArrow(searched, schema)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    group = F.spark_partition_id() % SHARDS_A_GROUP
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("number", group.alias("g")).orderBy(*order))).where(F.col("nth") <= k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
    out = stored(ranked.join(asked.select("number", "item"), "number").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score"), "found")
    release_since(begun, made()[-1])
    return out


def _search_shard(treap: Treap, row: dict[str, int], keys: list, files: list[str], known: dict, k: int) -> None:
    """Bring the k best of each item, so far in ``known``, up to date with a shard."""
    by_key = sorted(range(len(keys)), key=lambda c: (keys[c] is None, keys[c]))
    rank = np.empty(len(keys), np.int64)
    rank[by_key] = np.arange(len(keys))
    there = [keys[c] for c in by_key if keys[c] is not None]
    for items in _read_items(files):
        queries = _Queries([(i, terms, weights) for i, (_, terms, weights) in enumerate(items)], row)
        if not len(queries.item):
            continue
        old = [(i, score, doc) for i, (number, _, _) in enumerate(items) for score, doc in known.get(number, ())]
        before = [(i, score, 2 * (len(there) if doc is None else bisect_left(there, doc)), -1 - at) for at, (i, score, doc) in enumerate(old)]
        fresh: dict[int, list] = {}
        for i, score, _, column in best_of(treap, queries, rank, np.array(before, np.int64).reshape(-1, 4), k).tolist():
            fresh.setdefault(items[i][0], []).append((score, keys[column] if column >= 0 else old[-1 - column][2]))
        known.update(fresh)
