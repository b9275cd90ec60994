"""Text quality by a factorisation machine.

Features of a text are its hashed words (each with log(1 + count), scaled so
that a text's words have length 1), statistics of its structure, and the
table's n_chars as metadata, by itself and against the text's own length. The machine adds to a linear score the interactions of all pairs of
features, each the product of the two features' vectors of FACTORS numbers.
By the identity sum of pairs = (square of sum - sum of squares) / 2 that takes
time in proportion to the text's features, not their pairs.

Training uses a bounded, documented sample of labelled rows (``MAX_TRAIN``).
Scoring is a map over whole texts; the model has the same size for any corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, crc32_mod

BUCKETS = 1 << 13
FACTORS = 8
MAX_TRAIN = 6000
THRESHOLD = 0.3
FOLD, FOLDS = 0, 5
MEMORY = 400_000
METADATA = 2
SLICE = 1 << 19

STATS = (
    "upper", "digits", "marks", "spaces", "other", "word_length", "distinct_words", "top_word", "distinct_lines",
    "line_length", "bars", "repeated_marks", "sentence_ends", "length", "short")

_MARKS = re.compile(r"([!?*#$%&|+=~^<>_-])\1")
_hash: dict[str, int] = {}


def _bucket(word: str) -> int:
    if len(_hash) >= MEMORY:
        _hash.clear()
    at = _hash.get(word)
    if at is None:
        at = _hash[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
    return at


def stats(text: str, words: Counter) -> list[float]:
    """Shares and logarithms of the text's structure, about 0 to 2 each."""
    n, total = max(1, len(text)), max(1, sum(words.values()))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(np.minimum(codes, 128), minlength=129)  # 128: everything beyond ASCII
    lines = text.split("\n")
    return [
        float(kinds[65:91].sum()) / n, float(kinds[48:58].sum()) / n,
        float(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / n,
        float(kinds[32]) / n, float(kinds[128:].sum()) / n, np.log1p(n / total) / 3,
        len(words) / total, max(words.values(), default=0) / total, len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 8, float(kinds[124]) / total, len(_MARKS.findall(text)) / total,
        float(kinds[33] + kinds[46] + kinds[63]) / total, np.log1p(n) / 10, 1.0 / (1 + total),
    ]


def features(text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): hashed words first, then statistics and metadata from BUCKETS on.

    Metadata is the table's n_chars; where it is null the text's own length stands for it.
    """
    text = text or ""
    words = Counter(text.split())
    count: dict[int, int] = {}
    for w, c in words.items():
        b = _bucket(w.lower())
        count[b] = count.get(b, 0) + c
    at = np.fromiter(count.keys(), np.int64, len(count))
    x = np.log1p(np.fromiter(count.values(), np.float64, len(count)))
    x /= max(1e-9, np.sqrt((x * x).sum()))
    meta = len(text) if n_chars is None or n_chars != n_chars else max(0.0, n_chars)
    rest = np.array([*stats(text, words), np.log1p(meta) / 10, np.log((1 + meta) / (1 + len(text)))])
    return np.concatenate([at, BUCKETS + np.arange(len(rest))]), np.concatenate([x, rest])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of a batch before the logistic function, about SLICE features at a time."""
        out, sizes = np.empty(len(rows)), np.array([len(r[0]) for r in rows])
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + SLICE, SLICE), "left")
        for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            if a < b:
                out[a:b] = self._batch(rows[a:b])[0]
        return out

    def _batch(self, rows):
        """(scores, places, values, begins, v * x of each feature, their sums a row)."""
        at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        begins = np.cumsum([0, *[len(r[0]) for r in rows[:-1]]])
        v = self.factors[at] * x[:, None]
        s = np.add.reduceat(v, begins)
        z = self.bias + np.add.reduceat(self.linear[at] * x, begins) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), begins))
        return z, at, x, begins, v, s

    def gradient(self, rows, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(places, linear, factors, bias): of the mean log loss of the batch, at the places it has."""
        z, at, x, begins, v, s = self._batch(rows)
        err = (logistic(z) - y) / len(y)
        sizes = np.diff(np.append(begins, len(at)))
        e = np.repeat(err, sizes)
        places, inverse = np.unique(at, return_inverse=True)
        # d pairs / d factor = x * (sum of all v * x - own v * x)
        each = (e * x)[:, None] * (np.repeat(s, sizes, axis=0) - v)
        factors = np.stack([np.bincount(inverse, each[:, f]) for f in range(FACTORS)], 1)
        return places, np.bincount(inverse, e * x), factors, float(err.sum())

    def score(self, texts: list[str | None], n_chars: list[float | None]) -> np.ndarray:
        return logistic(self.raw([features(t, n) for t, n in zip(texts, n_chars, strict=True)]))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.05,
        l2: float = 1e-5, seed: int = 7) -> Machine:
    """Adagrad on mini-batches; without both classes, the machine is the smoothed base rate."""
    size, rng = BUCKETS + len(STATS) + METADATA, np.random.default_rng(seed)
    y = np.asarray(y, np.float64)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    m = Machine(base, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    if not len(y) or y.min() == y.max():
        m.factors[:] = 0
        return m
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            at, dw, dv, db = m.gradient([rows[i] for i in part], y[part])
            dw, dv = dw + l2 * m.linear[at], dv + l2 * m.factors[at]
            gw[at] += dw * dw
            gv[at] += dv * dv
            gb += db * db
            m.linear[at] -= rate * dw / np.sqrt(gw[at])
            m.factors[at] -= rate * dv / np.sqrt(gv[at])
            m.bias -= rate * db / gb**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on at most ``max_train`` labelled documents outside the held-out fold.

    Only text and n_chars make features; lang, source, ids and labels don't.
    The sample is taken and sorted by hashes and ids, so the machine is the
    same in each run. Null texts are empty ones; labels without an id, without
    a value or without a document don't count; without both classes (so for
    empty tables) the machine gives the base rate.
    """
    chosen = bounded_labels(labels, "quality", FOLD, FOLDS, max_train)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [features(t, n) for t, n in zip(pdf["text"], pdf["n_chars"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "at": [a.astype(np.int32).tobytes() for a, _ in got],
                                "x": [x.astype(np.float32).tobytes() for _, x in got]})

    got = (
        docs.select("doc_id", "text", F.col("n_chars").cast("double")).join(F.broadcast(chosen), "doc_id")
        .mapInPandas(made, "doc_id long, y int, at binary, x binary").orderBy("doc_id", "at", "x").limit(max_train)
    )
    rows, y = [], []
    for r in got.toLocalIterator():
        rows.append((np.frombuffer(bytes(r.at), np.int32), np.frombuffer(bytes(r.x), np.float32)))
        y.append(r.y)
    return fit(rows, np.array(y))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and: score double, predicted int (these names are replaced).

    Each row is scored by itself; null and empty texts get the score of an
    empty one, a null n_chars counts as the text's length; texts of any length
    count whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def quality(texts: pd.Series, n_chars: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist(), n_chars.tolist()), dtype="float64")

    out = docs.withColumn("score", quality("text", F.col("n_chars").cast("double")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    return F.coalesce(crc32_mod("doc_id", FOLDS) == FOLD, F.lit(False))
