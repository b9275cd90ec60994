"""Metrics of many short lists under many profiles, without a row for each item and profile.

Lists are dealt whole and sorted by their old rank; a task holds one list and
sorts a number for each item and some profiles at a time: its rounded score,
its old place and whether it is relevant. Only sums over lists leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Items of a list that is held whole, and numbers that are sorted at a time.
LIST_ROWS = 1 << 20
AT_A_TIME = 1 << 18
#: Bound of a signal, so that a rounded score fits beside a place.
MOST = 100.0
DIGITS = 9
SUMS = ("top1", "top3", "mrr", "map", "ndcg", "exam")


def list_sums(signals: np.ndarray, relevant: np.ndarray, weights: np.ndarray, k: int = 3) -> np.ndarray:
    """(profiles, SUMS) of one list of distinct items: ``signals`` (signal, item) by old rank, ``weights`` (profile, signal)."""
    n, truth, out = len(relevant), int(relevant.sum()), np.zeros((len(weights), len(SUMS)))
    if not truth:
        out[:, 5] = 1.0
        return out
    tail = np.arange(n, dtype=np.int64) << 1 | relevant
    places, step = np.arange(1, n + 1), max(1, AT_A_TIME // n)
    gains = 1 / np.log2(places[:k] + 1.0)
    for at in range(0, len(weights), step):
        w = weights[at : at + step]
        score = np.zeros((len(w), n))
        for i, x in enumerate(signals):
            score += w[:, i, None] * x
        # halves are rounded away from zero, as in SQL
        size = np.abs(score) * 10.0**DIGITS
        whole = np.floor(size)
        units = np.copysign(whole + (size - whole >= 0.5), score).astype(np.int64)
        hit = np.sort(-units * (LIST_ROWS << 1) + tail, axis=1) & 1
        first = hit.argmax(1) + 1
        part = out[at : at + step]
        part[:, 0], part[:, 1], part[:, 2] = first <= 1, first <= 3, 1 / first
        part[:, 3] = (hit * (hit.cumsum(1) / places)).sum(1) / truth
        part[:, 4] = (hit[:, :k] * gains[: n if n < k else k]).sum(1) / gains[:truth].sum()
        part[:, 5] = (first - 1) / n
    return out


def profile_sums(lists: DataFrame, weights: list[list[float]], signals: list[str], by: list[str], tasks: int) -> DataFrame:
    """(profile, by, cases, SUMS): sums over the lists of case_id and grp; parts of them, to be added up.

    ``lists``: case_id, grp, relevant, old and the signals, none of them null but for case_id
    and grp, signals of at most MOST; a list has at most LIST_ROWS items. ``by``: of case_id and grp.
    """
    kinds = dict(lists.dtypes)
    w = np.array(weights).reshape(len(weights), len(signals))
    if 10.0**DIGITS * MOST * np.abs(w).sum(1).max(initial=0) >= 1 << 41:
        raise ValueError("weights are too large")
    dealt = lists.select("case_id", "grp", "old", "relevant", *signals).repartition(tasks, "case_id", "grp").sortWithinPartitions("case_id", "grp", "old")
    where = [("case_id", "grp").index(b) for b in by]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, sums = None, [], {}

        def close() -> None:
            if parts:
                rows = np.concatenate(parts, axis=1)
                own = sums.setdefault(tuple(held[i] for i in where), np.zeros((len(w), len(SUMS) + 1)))
                own[:, 0] += 1
                own[:, 1:] += list_sums(rows[:-1], rows[-1].astype(np.int64), w)

        def told() -> pa.RecordBatch:
            columns = [pa.array(np.tile(np.arange(len(w), dtype=np.int32), len(sums)))]
            columns += [pa.array([key[i] for key in sums for _ in range(len(w))], types[j]) for i, j in enumerate(where)]
            columns.append(pa.array(np.concatenate([s[:, 0] for s in sums.values()]).astype(np.int64)))
            columns += [pa.array(np.concatenate([s[:, 1 + i] for s in sums.values()])) for i in range(len(SUMS))]
            return pa.RecordBatch.from_arrays(columns, ["profile", *by, "cases", *SUMS])

        for batch in batches:
            types = [batch.column(i).type for i in (0, 1)]
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            rows = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in (*signals, "relevant")], np.float64)
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != held:
                    close()
                    held, parts = keys[a], []
                    if len(sums) > 64:
                        yield told()
                        sums.clear()
                parts.append(rows[:, a:b])
        close()
        if sums:
            yield told()

    columns = ["profile int", *[f"{b} {kinds[b]}" for b in by], "cases long", *[f"{s} double" for s in SUMS]]
    return dealt.mapInArrow(walk, ", ".join(columns))
