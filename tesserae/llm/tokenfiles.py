"""Token ids in binary shards with a minimal perfect hash index.

Files, all little-endian, in one folder:

- ``shard-N-<run>.bin``: the ids of a range of documents, one after the other,
  16 bits each if the vocabulary allows it, else 32. Nothing else.
- ``shard-N-<run>.idx``: where each of its documents begins, in ids, 64 bits
  each, and the end.
- ``keys-K-<run>.npz``: part K of the key index. A key is hashed to 128 bits;
  the part follows from the hash. Within a part, levels of bitmaps form a
  minimal perfect hash: at each level a key has one bit, which is set if no
  other key of that level has the same; keys that clash go to the next level.
  The rank of a key's bit is its slot. A slot holds a fingerprint of its key,
  shard and number in it of the first and of the last document that has the
  key, and how many ids these documents have. A lookup touches a few bits, a slot, two offsets and
  one range of ids, however large the corpus; an unknown key is told by its
  fingerprint (a chance of 2**-32 to be taken for a known one).

Tables beside them say which files count: a task writes files of names of its
own and returns them as rows, so what a lost or repeated task leaves is never
read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _ODD, _SIMPLE
from .common import TASK_BYTES, dealt, filesystem, new_folder, write_whole

END_ID = 2
KEYS_A_PART = 1 << 16
MEMORY = 1_000_000
LONG = 256


class Encoder:
    """Ids of a text as the tokenizers library gives them, as bytes.

    For a byte-level vocabulary without a normaliser the library splits a text
    and merges each piece by itself. Pieces recur, so the library's model is
    asked once a piece; texts with characters beyond the simple ones or with
    the name of an added token go through the library whole. Other kinds of
    vocabulary always do. Names of added tokens get those tokens' ids, as the
    library does by default; ``plain`` makes them ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        self.bytes = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.bytes == 2 else "<u4")
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        split = plan["pre_tokenizer"] or {}
        self.by_piece = (
            plan["normalizer"] is None and split.get("type") == "ByteLevel"
            and split.get("use_regex") and not split.get("add_prefix_space") and plan["model"]["type"] == "BPE")
        self.added = [t["content"] for t in plan["added_tokens"]]
        self.model, self.memory = self.whole.model, {}
        self.table = str.maketrans({b: chr(c) for b, c in _byte_letters().items()})
        self.blank, self.code = self.table[0x20], "H" if self.bytes == 2 else "I"

    def _piece(self, piece: str) -> bytes:
        # of the printable ASCII characters only the blank has another letter
        plain = piece.isascii() and piece.isprintable()
        letters = piece.replace(" ", self.blank) if plain else piece.encode("utf-8").decode("latin-1").translate(self.table)
        ids = [t.id for t in self.model.tokenize(letters)]
        return pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(a in text for a in self.added) or _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        memory, out = self.memory, []
        add, get = out.append, memory.get
        for piece in _SIMPLE.findall(text):
            ids = get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) <= LONG:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[piece] = ids
            add(ids)
        return b"".join(out)


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest as letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(rest)}


_ENCODERS: dict[str, Encoder] = {}


def _encoder(source: str) -> Encoder:
    if source not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[source] = Encoder(source if "/" in source else public_tokenizers.path(source))
    return _ENCODERS[source]


# ---- keys

_KEY_TEXT = "if(doc_id is null, '', concat('k', doc_id))"
_FROM_KEY = "if(key = '', null, cast(substr(key, 2) as bigint)) as doc_id"
_PLACE = ("shard", "number", "last_shard", "last_number", "tokens")
_KEYS = "part int, file string, keys long, parts int"


def _hashes(keys: list[str]) -> np.ndarray:
    """Two 64-bit halves for each key."""
    raw = b"".join(xxhash.xxh3_128_digest(k.encode()) for k in keys)
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


_ODD_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _bit(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h[:, 0] + np.uint64(level) * (h[:, 1] | np.uint64(1))
    x = (x ^ (x >> np.uint64(31))) * _ODD_FACTOR
    return ((x >> np.uint64(20)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct keys, given by their hashes."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        self.before = np.cumsum([0, *[int(b.sum()) for b in bits]])
        self.ranks = [np.cumsum(b) - 1 for b in bits]

    @classmethod
    def build(cls, h: np.ndarray, room: float = 1.6) -> PerfectHash:
        sizes, bits, left = [], [], h
        while len(left):
            size = max(8, int(len(left) * room))
            at = _bit(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(sizes, bits)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that isn't in it, some slot or -1."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (size, bits) in enumerate(zip(self.sizes, self.bits, strict=True)):
            at = _bit(h[left], level, size)
            hit = bits[at]
            out[left[hit]] = self.before[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        return out


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (((h[:, 0] * _ODD_FACTOR) ^ h[:, 1]) >> np.uint64(32)).astype(np.uint32)


def _part(parts: int):
    """The index part of a key, as a column of its text."""
    return F.pmod(F.xxhash64(F.expr(_KEY_TEXT)), F.lit(parts)).cast("int")


# ---- writing

_DOC = "doc_id long, shard int, file string, number long, start long, n long"


def write(docs: DataFrame, folder: str | None = None, source: str = "byte_bpe_50k.json", end_id: int = END_ID,
          keys_a_part: int = KEYS_A_PART) -> str:
    """Write shards and index of ``docs`` (doc_id, text); gives the folder.

    Documents lie in ascending order of doc_id, those of one id by a hash of
    the text (and then the text), so that an id with very many rows is cut into
    several shards; null ids come first and share one key. A null text is an
    empty one, of which only the end id is written. Repeats of an id are all
    written; the index finds them together. A very long text is encoded whole by
    one task and lies in one shard. Other columns are not looked at. An
    empty table gives no shards.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = _encoder(source), TaskContext.get().partitionId()
        name, end = f"shard-{shard}-{uuid.uuid4().hex}", np.array([end_id], coder.kind).tobytes()
        store, path = filesystem(f"{folder}/{name}")
        out, at, starts = None, 0, []
        for batch in batches:
            if batch.num_rows and out is None:
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(path + ".bin")
            sizes = []
            for text in batch.column("text"):
                data = coder.encode(text.as_py() or "") + end
                out.write(data)
                sizes.append(len(data) // coder.bytes)
            begin = at + np.cumsum([0, *sizes], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.full(len(sizes), shard, np.int32)), pa.array([name] * len(sizes), pa.string()),
                pa.array(np.arange(len(starts), len(starts) + len(sizes), dtype=np.int64)),
                pa.array(begin[:-1]), pa.array(np.array(sizes, np.int64))], names=["doc_id", "shard", "file", "number", "start", "n"])
            starts += begin[:-1].tolist()
            at = int(begin[-1])
        if out is not None:
            out.close()
            write_whole(f"{folder}/{name}.idx", np.array([*starts, at], "<i8").tobytes())

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("nth"))
    ordered = keyed.repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth", "text")
    ordered.select("doc_id", "text").mapInArrow(write_shard, _DOC).write.parquet(f"{folder}/documents")
    written = spark.read.schema(_DOC).parquet(f"{folder}/documents")
    totals = written.groupBy("shard", "file").agg(F.sum("n").alias("tokens"), F.count("*").alias("documents"))
    base = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    totals.withColumn("base", F.coalesce(base, F.lit(0))).write.parquet(f"{folder}/shards")

    rows = written.count()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // keys_a_part))

    def write_keys(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hashes(list(pdf["key"]))
        perfect = PerfectHash.build(h)
        order = np.argsort(perfect.slots(h))
        levels = {f"level{i}": np.packbits(b) for i, b in enumerate(perfect.bits)}
        columns = {c: pdf[c].to_numpy()[order] for c in _PLACE}
        data = io.BytesIO()
        np.savez(data, sizes=np.array(perfect.sizes, np.int64), fingerprint=_fingerprint(h)[order], **columns, **levels)
        name = f"keys-{pdf['part'].iloc[0]}-{uuid.uuid4().hex}.npz"
        write_whole(f"{folder}/{name}", data.getvalue())
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "file": [name], "keys": [len(pdf)], "parts": [parts]})

    keys = (
        written.groupBy("doc_id").agg(
            F.min(F.struct("shard", "number")).alias("at"), F.max(F.struct("shard", "number")).alias("upto"), F.sum("n").alias("tokens"))
        .select(
            F.expr(_KEY_TEXT).alias("key"), "at.shard", "at.number", F.col("upto.shard").alias("last_shard"),
            F.col("upto.number").alias("last_number"), "tokens", _part(parts).alias("part"))
    )
    keys.groupBy("part").applyInPandas(write_keys, _KEYS).write.parquet(f"{folder}/keys")
    return folder


# ---- reading

def lookup(keys: DataFrame, folder: str, each: int = KEYS_A_PART) -> DataFrame:
    """(doc_id, shard, number, last_shard, last_number, tokens) of each distinct key in ``keys`` (doc_id) that the index has.

    A task takes neighbouring parts of the index, with about ``each`` keys asked
    for; a key's part follows from its hash, so that is even. Null ids are a
    key like others; keys that the index doesn't have give no row.
    """
    spark = keys.sparkSession
    index = spark.read.schema(_KEYS).parquet(f"{folder}/keys")
    parts = (index.select("parts").head() or [1])[0]
    wanted = keys.select("doc_id").distinct()
    tasks = min(parts, max(-(-wanted.count() // each), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, perfect, slot = None, None, None
        for pdf in batches:
            for file, rows in pdf.groupby("file", sort=False):
                if file != have:
                    store, path = filesystem(f"{folder}/{file}")
                    with store.open_input_file(path) as f:
                        slot = dict(np.load(io.BytesIO(f.read())))
                    sizes = slot["sizes"].tolist()
                    perfect = PerfectHash(sizes, [np.unpackbits(slot[f"level{i}"])[:n].astype(bool) for i, n in enumerate(sizes)])
                    have = file
                h = _hashes(list(rows["key"]))
                at = perfect.slots(h)
                ok = (at >= 0) & (slot["fingerprint"][at] == _fingerprint(h))
                at, rows = at[ok], rows[ok]
                yield pd.DataFrame({"key": rows["key"], **{c: slot[c][at] for c in _PLACE}})

    asked = wanted.select(F.expr(_KEY_TEXT).alias("key"), _part(parts).alias("part")).join(
        index.select("part", "file"), "part")
    return (
        asked.select("key", "file", F.floor(F.col("part").cast("long") * tasks / parts).cast("int").alias("task"))
        .repartitionById(tasks, "task").sortWithinPartitions("file").select("key", "file")
        .mapInPandas(find, "key string, shard int, number long, last_shard int, last_number long, tokens long")
        .selectExpr(_FROM_KEY, *_PLACE)
    )


def read(places: DataFrame, folder: str, gap: int = 1 << 16, most: int = 1 << 23, each: int = TASK_BYTES) -> DataFrame:
    """The documents at ``places`` (from lookup): doc_id, start, n, ids (32-bit little-endian bytes).

    ``start`` counts the ids of all documents before it. Places are dealt to
    tasks by the bytes they stand for (about ``each`` a task, at 4 an id);
    those of a shard are read in order, near ones (``gap`` bytes) in one go of
    ``most`` bytes or a document. A place that is asked for twice is read once.
    """
    spark = places.sparkSession
    shards = spark.read.schema("shard int, file string, documents long, base long").parquet(f"{folder}/shards")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = offsets = data = None
        for pdf in batches:
            for (file, base), rows in pdf.groupby(["file", "base"], sort=False):
                store, path = filesystem(f"{folder}/{file}")
                if file != have:
                    with store.open_input_file(path + ".idx") as f:
                        offsets = np.frombuffer(f.read(), "<i8")
                    if data is not None:
                        data.close()
                    data, have = store.open_input_file(path + ".bin"), file
                width = data.size() // int(offsets[-1])
                # every document of a key that repeats
                number = np.repeat(rows["number"].to_numpy(), rows["count"]) + np.concatenate([np.arange(c) for c in rows["count"]])
                keys = rows["key"].repeat(rows["count"]).reset_index(drop=True)
                a, b = offsets[number], offsets[number + 1]
                at = 0
                while at < len(a):
                    upto = at + 1
                    while upto < len(a) and a[upto] - b[upto - 1] <= gap // width and b[upto] - a[at] <= most // width:
                        upto += 1
                    raw = data.read_at(int(b[upto - 1] - a[at]) * width, int(a[at]) * width)
                    got = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    yield pd.DataFrame({
                        "key": keys[at:upto], "start": base + a[at:upto], "n": b[at:upto] - a[at:upto],
                        "ids": [got[x - a[at] : y - a[at]].tobytes() for x, y in zip(a[at:upto], b[at:upto], strict=True)]})
                    at = upto
        if data is not None:
            data.close()

    # a key's documents lie one after the other; a row for each shard they lie in
    found = (
        places.dropDuplicates(["shard", "number"])
        .select(F.expr(_KEY_TEXT).alias("key"), F.struct(*_PLACE).alias("p"), F.explode(F.sequence("shard", "last_shard")).alias("shard"))
        .join(shards, "shard")
        .withColumn("number", F.when(F.col("shard") == F.col("p.shard"), F.col("p.number")).otherwise(0))
        .withColumn("count", F.when(F.col("shard") == F.col("p.last_shard"), F.col("p.last_number") + 1).otherwise(F.col("documents")) - F.col("number"))
        .select("key", "file", "base", "number", "count", F.when(F.col("p.shard") == F.col("p.last_shard"), F.col("p.tokens")).alias("tokens"), "documents")
    )
    # of a key in several shards the part of each isn't known: a middling document for each
    size = 4 * F.coalesce("tokens", F.col("count") * 512)
    return dealt(found, "file", "number", size, each).mapInPandas(
        fetch, "key string, start long, n long, ids binary").selectExpr(_FROM_KEY, "start", "n", "ids")
