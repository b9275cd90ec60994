"""Sequences cut into ranges give what whole sequences give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators import coverage, sequences


def sequences_of(spark, seed):
    """One run has over a third of all rows, one is null, most are short."""
    chance = random.Random(seed)
    rows = [(1, i, chance.randrange(3), chance.random() < 0.1) for i in range(900)]
    rows += [(None, i, chance.randrange(2), False) for i in range(300)]
    rows += [(r, i, chance.randrange(3), chance.random() < 0.5) for r in range(2, 300) for i in range(chance.randrange(1, 6))]
    chance.shuffle(rows)
    return rows, spark.createDataFrame(rows, "run_id int, seq int, value int, flagged boolean")


def by_run(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        out.setdefault(r[0], []).append(r[1:])
    return out


def test_hot_run_is_many_tasks(spark):
    rows, frame = sequences_of(spark, 1)
    placed = sequences.cut(frame, "run_id", "seq", 24)
    assert placed.where("run_id = 1").select("_part").distinct().count() > 5
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert max(sizes) < len(rows) / 8
    # the windows run by part: no window of the plan is by run alone over all rows
    near = sequences.with_neighbours(placed, "run_id", "seq", ["value"], back=2, ahead=3)
    assert near.count() == len(rows)


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_neighbours_and_numbers(spark, parts):
    rows, frame = sequences_of(spark, parts)
    placed = sequences.cut(frame, "run_id", "seq", parts)
    w = Window.partitionBy("run_id").orderBy("seq")
    names = {f"_prev{i}_value": F.lag("value", i).over(w) for i in (1, 2)} | {f"_next{i}_value": F.lead("value", i).over(w) for i in (1, 2, 3)}
    want = frame.withColumns(names)
    got = sequences.with_neighbours(placed, "run_id", "seq", ["value"], back=2, ahead=3).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    n = sequences.numbered(placed, "run_id", "seq", "at").drop("_part")
    want = frame.withColumn("at", F.row_number().over(w))
    assert n.exceptAll(want).count() == 0 and want.exceptAll(n).count() == 0


def test_collapse_and_fragments(spark):
    rows, frame = sequences_of(spark, 5)
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    try:
        kept = coverage.collapse_runs(frame, "run_id", "seq", "value", keep_parts=True)
        got = sorted((r.run_id is None, r.run_id or 0, r.seq, r.value, r["at"]) for r in kept.collect())
        grams = {tuple(r) for r in coverage.ngram_fragments(kept, "run_id", "at", "value", "p:", flag="flagged").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want, fragments = [], set()
    for run, steps in by_run(rows).items():
        left = [s for i, s in enumerate(steps) if i == 0 or steps[i - 1][1] != s[1]]
        want += [(run is None, run or 0, s[0], s[1], n) for n, s in enumerate(left, 1)]
        for size in (2, 3):
            for i in range(len(left) - size + 1):
                part = left[i : i + size]
                values = [s[1] for s in part]
                if len(set(values)) > 1 and any(s[2] for s in part):
                    fragments |= {(run, v, "p:" + " -> ".join(map(str, values))) for v in values}
    assert got == sorted(want) and grams == fragments
    assert coverage.collapse_runs(frame.limit(0), "run_id", "seq", "value").count() == 0
