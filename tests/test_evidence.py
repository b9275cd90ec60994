"""Counts of the evidence of runs."""

import random

from pyspark.sql import functions as F

from tesserae.operators import logs


def test_counts_equal_the_pairs(spark):
    """Runs without frames, without tests, tests without a target or with several, targets that frames name too."""
    chance = random.Random(4)
    tests = spark.createDataFrame([(chance.randrange(30), f"n{chance.randrange(12)}") for _ in range(70)], "run_id long, nodeid string")
    matches = spark.createDataFrame([(f"n{i}", e) for i in range(9) for e in range(i % 3 + 1)], "nodeid string, entity long")
    framed = spark.createDataFrame([(chance.randrange(10, 40), chance.randrange(6)) for _ in range(60)], "run_id long, entity long")
    pairs = logs.evidence_spectrum(tests, matches, framed)
    want = pairs.groupBy("run_id").agg(F.count("*"), F.countDistinct("test"), F.countDistinct("entity")).collect()
    got = logs.evidence_counts(tests, matches, framed).select("run_id", "n", "tests", "entities")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 20
    assert dict(got.dtypes) == {"run_id": "bigint", "n": "bigint", "tests": "bigint", "entities": "bigint"}


def test_a_run_of_many_tests_and_frames_makes_no_pairs(spark):
    """20,000 tests and 20,000 entities of one run would be 400 million rows."""
    tests = spark.range(20000).selectExpr("1 as run_id", "concat('n', id) as nodeid")
    framed = spark.range(20000).selectExpr("1 as run_id", "id as entity")
    matches = spark.range(100).selectExpr("concat('n', id) as nodeid", "id + 20000 - 50 as entity")
    assert [tuple(r) for r in logs.evidence_counts(tests, matches, framed).collect()] == [(1, 400_000_050, 20000, 20050)]


def test_shapes_of_lines_are_worked_out_once(spark):
    """A pattern stands in the plan once for each group that is taken, not once for each use of it."""
    lines = spark.createDataFrame([(1, 1, "FAILED a.py::t")], "run_id long, line_no int, text string")
    plan = logs.failing_tests(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(FAIL|ERROR)") == 2 and plan.count("stdout|stderr") == 1
