"""Toxicity: a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios.

Training. A bounded, documented sample of labelled rows (``MAX_TRAIN``) outside
the held-out fold is turned into sets of hashed character n-grams. For each
n-gram, r = log((1 + toxic documents with it) / toxic total) minus the same of
the others; a logistic regression is then fitted on the features r * [present].
N-grams in fewer than ``MIN_DOCS`` documents or with a small ratio get weight 0.

Scoring is a map over whole texts; only the weight table (4 bytes for each of
2**20 buckets, whatever the corpus) goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, crc32_mod, stored

BITS = 20
ORDERS = (3, 4, 5, 6)
MAX_TRAIN = 6000
MIN_DOCS = 5
MIN_RATIO = 1.5
THRESHOLD = 0.3
FOLD, FOLDS = 2, 4
SLICE = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(text: str | None) -> Iterator[np.ndarray]:
    """Hash buckets of all character n-grams of the text, in pieces.

    The text is lower-cased and gets a space at both ends. Long texts are cut
    into overlapping slices, so that memory stays bounded and no n-gram is lost.
    """
    text = f" {(text or '').lower()} "
    for at in range(0, max(1, len(text)), SLICE):
        part = text[at : at + SLICE + max(ORDERS) - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = codes
        for n in range(2, max(ORDERS) + 1):
            if len(codes) < n:
                break
            h = (h[:-1] * _MIX) ^ (h[:-1] >> np.uint64(29)) ^ codes[n - 1 :]
            if n in ORDERS:
                keep = h[: SLICE]
                yield ((keep * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a text, ascending."""
    parts = list(ngram_buckets(text))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


@dataclass
class Model:
    weights: np.ndarray  # one per bucket, r already in it
    bias: float

    def score(self, text: str | None) -> float:
        hit = [b[self.weights[b] != 0] for b in ngram_buckets(text)]
        seen = np.unique(np.concatenate(hit)) if hit else np.empty(0, np.int32)
        z = self.bias + float(self.weights[seen].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def chosen_buckets(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask, ratio): which n-grams are frequent and telling enough, and their log-count ratios."""
    ratio = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
    return (pos + neg >= MIN_DOCS) & (np.abs(ratio) >= MIN_RATIO), ratio


def fit(rows: list[np.ndarray], y: np.ndarray, buckets: np.ndarray, ratio: np.ndarray, steps: int = 120, l2: float = 1.0) -> Model:
    """Fit on sets of chosen ``buckets`` (ascending) with their ratios.

    Without both classes or without chosen buckets, the model is the smoothed base rate.
    """
    weights, y = np.zeros(1 << BITS, np.float32), np.asarray(y, np.float64)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -2.0
    if not len(y) or y.min() == y.max() or not len(buckets):
        return Model(weights, base)
    cols = [np.searchsorted(buckets, x) for x in rows]
    doc = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    col = np.concatenate(cols)
    w, b = np.zeros(len(buckets)), base
    sums = lambda v: np.bincount(doc, v[col], minlength=len(rows))
    mean, var, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(sums(w * ratio) + b, -30, 30)))
        err = (p - y) / len(y)
        g = np.bincount(col, err[doc], minlength=len(buckets)) * ratio + l2 * w / len(y)
        gb = err.sum()
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (mean / c1) / (np.sqrt(var / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / ((vb / c2) ** 0.5 + 1e-8)
    weights[buckets] = (w * ratio).astype(np.float32)
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` labelled documents outside the held-out fold.

    The labels' side has at most ``max_train`` rows, which bounds the broadcast.
    N-grams are counted where the texts are and summed by Spark; the driver
    gets the chosen ones (at most 2**BITS) and, in a second pass over the
    sample, which of them each document has. A null text is an empty one;
    labels without an id, a value or a document don't count, and an id with
    several documents counts once; without both
    classes (so for empty tables) the model gives the base rate.
    """
    chosen = bounded_labels(labels, "toxic", FOLD, FOLDS, max_train)
    # of rows that repeat an id one stays, the same in each run
    sample = stored(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "sample")
    sizes = sample.agg(F.sum("y").alias("pos"), F.count("*").alias("all")).head()
    n_pos, n_all = int(sizes["pos"] or 0), int(sizes["all"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for pdf in batches:
            for y, text in zip(pdf["y"], pdf["text"], strict=True):
                seen[int(y > 0), features(text)] += 1
        have = np.flatnonzero(seen.any(0))
        for at in range(0, len(have), 1 << 17):
            part = have[at : at + (1 << 17)]
            yield pd.DataFrame({"bucket": part, "neg": seen[0, part], "pos": seen[1, part]})

    spread = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism)
    counts = spread.mapInPandas(count, "bucket int, neg int, pos int").groupBy("bucket").agg(
        F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(F.col("neg") + F.col("pos") >= MIN_DOCS)
    # the same test as chosen_buckets makes, so that only what may stay comes here
    ratio = F.log((F.col("pos") + 1) / (n_pos + 2.0)) - F.log((F.col("neg") + 1) / (n_all - n_pos + 2.0))
    got = counts.where(F.abs(ratio) >= MIN_RATIO).orderBy("bucket").toArrow()
    buckets = got.column("bucket").to_numpy().astype(np.int32)
    mask, ratios = chosen_buckets(got.column("pos").to_numpy(), got.column("neg").to_numpy(), n_pos, n_all - n_pos)
    buckets, ratios = buckets[mask], ratios[mask]
    shared = sample.sparkSession.sparkContext.broadcast(buckets)

    def chosen_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [np.intersect1d(features(t), shared.value, True).astype(np.int32).tobytes() for t in pdf["text"]]})

    # sorted, so that sums are made in the same order in each run
    rows = spread.mapInPandas(chosen_of, "doc_id long, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    return fit([np.frombuffer(x.as_py(), np.int32) for x in rows.column("x")], rows.column("y").to_numpy(), buckets, ratios)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and: score double, predicted int.

    Columns of these names in ``docs`` are replaced. Each row is scored by
    itself, so repeats and ties get equal scores; null and empty texts get the
    score of the bias alone (about); very long texts count whole, SLICE
    characters at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    out = docs.withColumn("score", toxicity("text"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    return F.coalesce(crc32_mod("doc_id", FOLDS) == FOLD, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't call toxic, with their own columns.

    Each row is judged by itself: repeats go or stay together, a null text is
    an empty one, columns of any names stay as they are, an empty table stays so.
    """
    scored = score(docs.select(F.struct(*docs.columns).alias("row"), "text"), train(docs, labels))
    return scored.where("predicted = 0").select("row.*")
