"""Large tables are dealt to tasks of bounded rows, with the same results."""

import pytest

from tesserae import registry, tables
from tesserae.operators import coverage, sequences


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["exception_paths", "neighbours_top"])
def test_views_in_small_tasks(spark, small, monkeypatch, name):
    want = rows(registry.QUERIES[name](spark, small))
    assert tables.tasks_for(tables.table(spark, small, "lineitem")) == 0
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    steps = tables.VIEWS["steps"](spark, small)
    assert steps.rdd.getNumPartitions() == -(-steps.count() // 300)
    assert rows(registry.QUERIES[name](spark, small)) == want


@pytest.mark.parametrize("name", ["seq_ngrams", "seq_ngrams_flag"])
def test_ngrams_in_small_tasks(spark, small, monkeypatch, name):
    want = rows(registry.QUERIES[name](spark, small))
    for module in (sequences, coverage):
        monkeypatch.setattr(module, "RANGE_ROWS", 300)
    dealt = []
    frame = type(spark.range(1))
    by_range, by_hash = frame.repartitionByRange, frame.repartition
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *c: dealt.append(n) or by_range(self, n, *c))
    monkeypatch.setattr(frame, "repartition", lambda self, n, *c: dealt.append(n) or by_hash(self, n, *c))
    assert rows(registry.QUERIES[name](spark, small)) == want
    assert len(dealt) == 2 and min(dealt) > 8
