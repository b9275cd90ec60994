"""Small inputs with known values, and the operators that SQL can't express against plain versions."""

import math
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tesserae import registry
from tesserae.functions import tokens
from tesserae.operators import calibration, coverage, experiments, graph, logs, metrics, quality, reports, scoring, selection, similarity
from tesserae.sources import manifests, storage
from tesserae.tables import VIEWS

REPO = Path(__file__).parents[1]


def test_ochiai(spark):
    runs = spark.createDataFrame([(1, True), (2, False), (3, True)], "run_id int, failed boolean")
    cov = spark.createDataFrame([(1, "A", "l1"), (1, "A", "l2"), (2, "A", "l1"), (2, "B", "l9")], "run_id int, component string, element string")
    got = {r.component: r.s for r in coverage.spectrum(cov, runs, [], ["component"]).select("component", coverage.ochiai().alias("s")).collect()}
    assert got == {"A": pytest.approx(0.5), "B": 0.0}  # one of two failing runs and one passing
    best = coverage.ochiai_by_element(cov, runs.where("run_id < 3").withColumn("case_id", F.lit(1)), ["case_id"], "component", "element").collect()
    assert {r.component: r.score for r in best} == {"A": 1.0, "B": 0.0}
    none = coverage.spectrum(cov, runs.where("not failed"), [], ["component"]).select(coverage.ochiai().alias("s")).collect()
    assert all(r.s == 0 for r in none)


def lists(spark, rows):
    return spark.createDataFrame([(c, i, r, rel) for c, items in rows.items() for r, (i, rel) in enumerate(items, 1)], "case_id string, item string, rank int, relevant boolean")


def test_ranking_metrics(spark):
    yes, no = True, False
    rows = lists(spark, {"one": [("a", yes), ("b", no), ("c", no)], "two": [("a", no), ("b", no), ("c", yes)], "ap": [("a", yes), ("x", no), ("b", yes), ("c", no)],
                         "ndcg": [("clean", no), ("bug_a", yes), ("bug_b", yes), ("late", yes)], "again": [("x", no), ("x", no), ("a", yes), ("a", yes)]})
    sizes = spark.createDataFrame([("one", 1), ("two", 1), ("ap", 2), ("ndcg", 3), ("again", 1), ("empty", 1), ("bare", 0)], "case_id string, n_truth int")
    got = {r.case_id: r for r in metrics.per_case(rows, sizes).collect()}
    assert got["ap"].ap == pytest.approx(0.8333, abs=1e-4) and (got["one"].ap + got["two"].ap) / 2 == pytest.approx(0.6667, abs=1e-4)
    assert got["ndcg"].ndcg == pytest.approx(0.5307, abs=1e-4) and got["ndcg"].exam == 0.25 and got["one"].exam == 0.0
    assert got["empty"].exam == 1.0 and got["empty"].reciprocal == 0.0 and got["bare"].ap == 0.0
    assert got["again"].ap == pytest.approx(1 / 3) and got["again"].exam == 0.5  # positions count repeats, EXAM doesn't
    top = metrics.summary(metrics.per_case(rows.where("case_id in ('one', 'two')"), sizes.where("case_id in ('one', 'two')"))).head()
    assert (top.top1, top.top3, top.mrr) == (0.5, 1.0, pytest.approx(0.6667, abs=1e-4))


def test_noisy_or_and_normalise(spark):
    d = spark.createDataFrame([(0.8,), (0.75,)], "confidence double")
    assert d.agg(scoring.noisy_or().alias("x")).head().x == pytest.approx(0.95)
    assert d.limit(0).agg(scoring.noisy_or().alias("x")).head().x == 0.0
    assert d.limit(1).withColumn("confidence", F.lit(1.0)).agg(scoring.noisy_or().alias("x")).head().x == 1.0
    z = spark.createDataFrame([(1, 0.0), (1, 0.0)], "c int, v double")
    assert all(r.normalised == 0 for r in graph.normalised(z, "v", ["c"]).collect())


def test_pareto(spark):
    p = spark.createDataFrame([("static_only", 1.0, 0.0), ("graph_only", 0.0, 0.5), ("other", 1.0, 0.0)], "profile string, top1 double, exam double")
    got = {r.profile: (r.dominates, r.dominated_by, r.optimal) for r in experiments.pareto(p, "profile", ["top1"], ["exam"]).collect()}
    assert got == {"static_only": (1, 0, True), "other": (1, 0, True), "graph_only": (0, 2, False)}

    import random

    rng = random.Random(3)
    rows = [(f"p{i}", float(rng.randrange(6)), float(rng.randrange(6)), float(rng.randrange(6))) for i in range(150)]
    better = lambda a, b: all(x >= y for x, y in zip(a, b, strict=True)) and a != b
    point = {r[0]: (r[1], r[2], -r[3]) for r in rows}
    want = {k: (sum(better(v, o) for o in point.values()), sum(better(o, v) for o in point.values())) for k, v in point.items()}
    frame = spark.createDataFrame(rows, "profile string, a double, b double, c double")
    got = {r.profile: (r.dominates, r.dominated_by) for r in experiments.pareto(frame, "profile", ["a", "b"], ["c"], rows_a_range=7).collect()}
    assert got == want


def test_generalisation(spark):
    c = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 0.5), ("a", 1.0, 1.0, 1.0, 0.5), ("b", 0.0, 0.0, 0.0, 0.0)], "grp string, top1 double, ap double, success double, efficiency double")
    g = experiments.generalisation(c, "grp")
    s = experiments.generalisation_summary(g, "grp").head()
    assert s.entropy == pytest.approx(0.9183, abs=1e-4) and s.imbalance == 2.0 and s.max_gap == 1.0 and s.worst == "b" and s.risk == "high"


def test_calibration_edges(spark):
    rows = spark.createDataFrame([(1, 0.0, False), (2, 0.5, True), (3, 1.0, True)], "id int, confidence double, hit boolean")
    assert {r.bin for r in calibration.reliability(rows).collect()} == {0, 5, 9}
    assert {r.agreement for r in rows.select(calibration.agreement().alias("agreement")).collect()} == {"aligned"}
    assert calibration.group_holdout(rows.withColumn("grp", F.lit("only")), "grp").count() == 0
    one = calibration.bootstrap(rows.limit(1).withColumn("hit", F.col("hit").cast("double")), ["confidence"], [], samples=50)
    assert [(r.low, r.high) for r in one.collect()] == [(0.0, 0.0)]


def test_verdicts(spark):
    rows = spark.createDataFrame([("Prefer", True), ("reject ", True), (None, False), ("fail", False), ("maybe", True)], "verdict string, success boolean")
    r = calibration.verdict_outcomes(rows).head()
    assert (r.accept_success, r.reject_success, r.reject_failure, r.unknown_verdict, r.aligned, r.mismatch) == (1, 1, 1, 2, 2, 1)


def test_flips(spark):
    w = {"sbfl": 0.5, "graph": 0.5}
    rows = spark.createDataFrame([("flip", 1, 0.55, 0.8, 0.3), ("flip", 2, 0.40, 0.2, 0.6), ("stable", 1, 0.80, 0.8, 0.8), ("stable", 2, 0.50, 0.5, 0.5)], "c string, rank int, score double, sbfl double, graph double")
    got = {(r.c, r.component): r.flips for r in calibration.counterfactual_flips(rows, "c", w).collect()}
    assert got == {("flip", "sbfl"): True, ("flip", "graph"): False, ("stable", "sbfl"): False, ("stable", "graph"): False}


def test_lines_in_functions_of_any_length(spark):
    import random

    from tesserae.operators import coverage

    rng = random.Random(6)
    functions = [("f", i, a := rng.randrange(0, 5000), a + rng.choice([0, 1, 3, 20, 300, 5000])) for i in range(60)]
    places = [("f", rng.randrange(0, 9000)) for _ in range(200)]
    want = {(line, i) for _, line in places for _, i, a, z in functions if a < line <= z}
    got = coverage.containing(spark.createDataFrame(places, "file string, line int"), spark.createDataFrame(functions, "file string, function int, start_line int, end_line int"), span=4)
    rows = [(r.line, r.function) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_logs(spark):
    lines = spark.createDataFrame([(1, 1, "FAILED tests/test_math.py::test_average - AssertionError"), (1, 2, "tests/test_more.py::TestStats::test_mean FAILED [100%]"), (1, 3, "FAIL: test_x (pkg.test_a.TestA.test_x)"),
                                   (1, 4, "ERROR: other (pkg.mod.test_y)"), (1, 5, None), (1, 6, '  File "a/b.py", line 3, in fn')], "run_id int, line_no int, text string")
    got = [r.nodeid for r in logs.failing_tests(lines).orderBy("line_no").collect()]
    assert got == ["tests/test_math.py::test_average", "tests/test_more.py::TestStats::test_mean", "pkg/test_a.py::TestA::test_x"]
    f = logs.frames(lines).head()
    assert (f.path, f.line, f.function, f.format) == ("a/b.py", 3, "fn", "python_traceback")


def test_log_lines_with_sources_brackets_and_notes(spark):
    text = ["FAILED tests/test_large.py::test_parse[empty value] - AssertionError", "tests/test_large.py::test_render[case with spaces] FAILED [100%]",
            "[stdout] FAILED tests/t.py::test_a", "[stderr]   FAIL: test_x (pkg.test_a.TestA.test_x)", "FAILED tests/t.py::test_b[a - b] - x - y",
            "FAILED tests/test_retry.py::TestRetry::test_guard (nodeid-scoped pytest command)", "FAILED tests/t.py::test_c[x[0]] - boom", "FAILED something else",
            '[stdout] File "a/b.py", line 3, in fn']
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "run_id int, line_no int, text string")
    got = {r.line_no: r.nodeid for r in logs.failing_tests(lines).collect()}
    assert got == {0: "tests/test_large.py::test_parse[empty value]", 1: "tests/test_large.py::test_render[case with spaces]", 2: "tests/t.py::test_a", 3: "pkg/test_a.py::TestA::test_x",
                   4: "tests/t.py::test_b[a - b]", 5: "tests/test_retry.py::TestRetry::test_guard", 6: "tests/t.py::test_c[x[0]]"}
    assert logs.frames(lines).head().path == "a/b.py"


def test_matches_against_every_pair(spark):
    import random

    rng = random.Random(4)
    paths = ["a/__init__.py", "b/__init__.py", "__init__.py", "x/a/__init__.py", "a/m.py", "m.py", "b/m.py"]
    names = ["f", "g", "test_x", "T.test_x", "pkg.f", "q.pkg.f"]
    entities = [(f"e{i:02d}", rng.choice(paths), n.split(".")[-1], rng.choice(["", "k.", "q."]) + n, a := rng.randrange(1, 150), a + rng.randrange(0, 80)) for i in range(40) for n in [rng.choice(names)]]
    tests = [(f"n{i}", rng.choice(paths), rng.choice(["f", "test_x", "z"]), rng.choice(names)) for i in range(60)]
    frames = [(rng.choice(paths), rng.randrange(1, 220), rng.choice(["f", "test_x", "z"])) for _ in range(60)]
    base = lambda p: p.split("/")[-1]
    under = lambda p, q: p == q or p.endswith("/" + q)
    e = spark.createDataFrame(entities, "entity string, path string, name string, qualified string, start_line int, end_line int")
    want = {}
    for n, p, t, q in tests:
        for x, xp, xn, xq, *_ in entities:
            score = 4 * (q == xq) + 3 * xq.endswith("." + q) + 2 * (t == xn) + (under(p, xp) or under(xp, p))
            if base(p) == base(xp) and score > 0:
                want[n] = max(want.get(n, (0, "")), (score, x), key=lambda s: (s[0], [-ord(c) for c in s[1]]))
    t = spark.createDataFrame(tests, "nodeid string, path string, test string, qualified string")
    assert {r.nodeid: (r.score, r.entity) for r in logs.match_tests(t, e).collect()} == want
    want = {}
    for p, line, fn in frames:
        for x, xp, xn, xq, a, z in entities:
            score = 8 * (a <= line <= z) + 4 * (fn == xn) + 2 * xq.endswith("." + fn) + under(p, xp)
            if base(p) == base(xp) and score > 1:
                want[p, line, fn] = max(want.get((p, line, fn), (0, "")), (score, x), key=lambda s: (s[0], [-ord(c) for c in s[1]]))
    f = spark.createDataFrame(frames, "path string, line int, function string")
    assert {(r.path, r.line, r.function): (r.score, r.entity) for r in logs.match_frames(f, e, lines=16).collect()} == want


def test_counts_and_score(spark):
    t = spark.createDataFrame([("1 passed, 2 failed, 1 error, 3 skipped in 1s\n4 passed",), ("Ran 3 tests in 0.1s",), ("",), (None,)], "output string")
    got = [(r.passed, r.failed, r.skipped, r.total) for r in t.select(*logs.test_counts()).collect()]
    assert got == [(5, 3, 3, 11), (3, 0, 0, 3), (0, 0, 0, 0), (0, 0, 0, 0)]
    s = spark.createDataFrame([("total / len(x)",), ("if not x: raise ValueError\ny = a / len(x)",), ("rows.sort(key=1)\nexcept Exception:",), ("x\ndef test_a(): pass",)], "t string")
    assert [r.s for r in s.select(logs.pattern_score("t").alias("s")).collect()] == [150, 40, 110, -90]


def test_diff_and_tokens(spark):
    d = spark.createDataFrame([("--- a/x.py\n+++ b/x.py\n+one\n-two\n same",), (None,)], "d string")
    assert [(r.n, r.f) for r in d.select(scoring.diff_size("d").alias("n"), scoring.diff_files("d").alias("f")).collect()][0] == (2, 1)
    t = spark.createDataFrame([("getUserName2 = snake_case_x + 42 self",)], "t string").select(tokens("t").alias("w")).head().w
    assert set(t) == {"get", "user", "name2", "snake_case_x", "snake", "case_x"} - {"case_x"} | {"42"}


def test_novelty(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b"], True), (1, 2, ["a", "b"], False), (1, 3, ["a", "c"], False), (1, 4, [], False), (2, 1, ["a"], False)], "c int, i int, t array<string>, ok boolean")
    got = {(r.c, r.i): r.novelty for r in similarity.jaccard_novelty(rows, "c", "i", "t", "ok").collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (1, 3): pytest.approx(2 / 3), (1, 4): 0.0, (2, 1): 1.0}


@pytest.mark.parametrize("levels", [(), (0.5,), (0.8, 0.3)])
def test_novelty_levels(spark, levels):
    """Whatever the levels, the nearest accepted row before is found."""
    chance = random.Random(4)
    rows = []
    for c in range(4):
        for i in range(25):
            near = rows[-1][2] if rows and chance.random() < 0.5 else []
            rows.append((c, i, [*near[: len(near) - chance.randrange(3)], *chance.choices("abcdefghijklmnop", k=chance.randrange(5))], chance.random() < 0.5))
    got = {(r.c, r.i): r.novelty for r in similarity.jaccard_novelty(spark.createDataFrame(rows, "c int, i int, t array<string>, ok boolean"), "c", "i", "t", "ok", levels).collect()}
    for c, i, t, _ in rows:
        known = [set(o) for d, j, o, ok in rows if d == c and j < i and ok]
        want = 1.0 if not known else 0.0 if not t else 1 - max(len(set(t) & o) / len(set(t) | o) for o in known)
        assert got[c, i] == pytest.approx(want), (c, i)


def test_candidate_novelty(spark):
    text = spark.createDataFrame([("x_1 != y2 + 10 <= Foo",)], "t string").select(similarity.code_tokens("t").alias("t")).head().t
    assert text == ["x_1", "!=", "y2", "10", "<=", "Foo"]
    rows = spark.createDataFrame([(1, 1, ["a", "b"], ["a"], True), (1, 2, ["a", "b"], ["a"], False), (1, 3, ["a", "b"], ["z"], False), (1, 4, [], [], True)],
                                 "c int, i int, s array<string>, e array<string>, ok boolean")
    got = {r.i: (r.novelty, r.accepted, r.reason) for r in similarity.candidate_novelty(rows, "c", "i", "s", "e", "ok").collect()}
    assert got == {1: (1.0, True, "accepted"), 2: (0.0, False, "low_novelty_against_batch"), 3: (0.55, True, "accepted"), 4: (0.0, False, "low_novelty_against_batch")}


def test_graph_walks(spark):
    e = spark.createDataFrame([("a", "b", "calls", True), ("b", "c", "calls", False), ("a", "c", "calls", False), ("c", "c", "calls", False)], "src string, dst string, kind string, awaited boolean")
    n = spark.createDataFrame([("a", "f", False), ("b", "f", False), ("c", "g", False), ("z", "g", False)], "id string, file string, is_test boolean")
    d = {(r.source, r.id): r.distance for r in graph.bfs(e, n.select(F.col("id").alias("source"))).collect()}
    assert d[("a", "c")] == 1 and ("b", "a") not in d and d[("a", "a")] == 0
    paths = graph.bfs_paths(e, spark.createDataFrame([("a", "c"), ("b", "a")], "source string, target string")).collect()
    assert [r.path for r in paths] == [["a", "c"]]
    deg = {r.id: (r.degree, r.incoming, r.outgoing) for r in graph.degree(e).collect()}
    assert deg["c"] == (3, 3, 1)
    ranks = {r.id: r.rank for r in graph.pagerank(e, n).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks["c"] > ranks["b"] > ranks["a"]
    assert ranks == pytest.approx(slow_pagerank([("a", "b"), ("b", "c"), ("a", "c"), ("c", "c")], "abcz"))
    near = {r.id: r.proximity for r in graph.proximity(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert near == {"a": 1.0, "b": 0.5, "c": 0.5}


def test_pagerank_over_blocks(spark):
    """Blocks of one node: arcs of a node from several blocks, a node without a way out and one without any arc."""
    pairs = [(1, 2), (2, 3), (1, 3), (3, 3), (4, 3), (3, 5)]
    e, n = spark.createDataFrame(pairs, "src long, dst long"), spark.range(1, 7)
    ranks = {r.id: r.rank for r in graph.pagerank(e, n, rounds=3, block=1).collect()}
    assert ranks == pytest.approx(slow_pagerank(pairs, range(1, 7), 3))


def slow_pagerank(edges, ids, rounds=30):
    out = {i: sorted({b for a, b in edges if a == i}) for i in ids}
    r = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        sink = sum(r[i] for i in ids if not out[i])
        r = {i: 0.15 / len(ids) + 0.85 * (sum(r[j] / len(out[j]) for j in ids if i in out[j]) + sink / len(ids)) for i in ids}
    return r


def test_path_distance(spark):
    d = spark.createDataFrame([("a/b/x.py", "a/c/y.py"), ("x.py", "a/y.py"), ("a/b/x.py", "a/b/y.py"), ("a/b/c/x.py", "y.py")], "a string, b string")
    assert [r.d for r in d.select(graph.path_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [2, 1, 0, 3]


def test_greedy_is_a_permutation(spark, small):
    base = registry.QUERIES["diversity_rerank"](spark, small).toPandas()
    for _, g in base.groupby("case_id"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1)) and g["id"].is_unique
    first = base[base["rank"] == 1]
    assert (first.bonus - 1.0).abs().max() < 1e-9  # all four are new
    gain = registry.QUERIES["gain_subset"](spark, small).toPandas().sort_values(["case_id", "place"])
    assert all(g["gain"].is_monotonic_decreasing for _, g in gain.groupby("case_id"))  # gains only shrink
    kept = registry.QUERIES["tiered_retention"](spark, small).toPandas()
    assert kept.groupby("case_id").size().max() <= 8 and kept.duplicated(["case_id", "id"]).sum() == 0
    batches = registry.QUERIES["distinct_batches"](spark, small).toPandas()
    assert set(batches.groupby(["case_id", "batch"]).size()) == {3}


def test_diversity_by_hand(spark):
    rows = spark.createDataFrame([(1, 1, 0.50, 1, "f", "r", 0, "low"), (1, 2, 0.49, 2, "f", "r", 0, "low"), (1, 3, 0.45, 3, "g", "s", 1, "high")], "case_id int, id long, prior double, base_rank int, function string, rule string, variant int, risk_bucket string")
    got = [(r.id, round(r.bonus, 2)) for r in selection.diversity_rerank(rows).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_gates_and_validation(spark):
    m = spark.createDataFrame([("s", 0.7, 0.9)], "key string, top1 double, exam double")
    got = {r["check"]: r.passed for r in quality.gate(m, {"min_top1": 0.7, "max_exam": 0.5, "min_gone": 1}, "key").collect()}
    assert got == {"min_top1": True, "max_exam": False, "min_gone": False}
    p = spark.createDataFrame([("a/b.py",), ("/a",), ("a/../b",), ("",), (None,), ("a..b",)], "p string")
    assert [r.s for r in p.select(quality.safe_path("p").alias("s")).collect()] == [True, False, False, False, False, True]


def test_compare_runs(spark):
    old = spark.createDataFrame([("a", 0.0, 1.0), ("gone", 1.0, 1.0), ("same", 1.0, 1.0)], "run string, passed double, n double")
    new = spark.createDataFrame([("a", 1.0, 3.0), ("new", 1.0, 1.0), ("same", 1.0, 1.0)], "run string, passed double, n double")
    got = {r.run: (r.change, r.d_n) for r in reports.compare_runs(old, new, "run", ["passed", "n"]).collect()}
    assert got == {"a": ("improved", 2.0), "gone": ("missing", 0.0), "new": ("added", 0.0), "same": ("unchanged", 0.0)}


def test_manifest_and_sink(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text('{"cases": [{"name": "one", "failing_tests": ["t"]},\n {"name": "two", "metadata": {"k": "v"}}]}')
    c = manifests.read_cases(spark, f"{tmp_path}/m")
    assert {r.name: (r.failing_tests, r.passed_tests, r.metadata) for r in c.collect()} == {"one": (["t"], [], {}), "two": ([], [], {"k": "v"})}
    storage.sink(c.select("name", "repo_path"), f"{tmp_path}/out", by=["name"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    storage.sink(c.select("name"), f"{tmp_path}/json", "json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_stream_equals_batch(spark, small, tmp_path):
    from tesserae.streaming.spectrum import windowed_failures

    o = VIEWS["outcomes"](spark, small).withColumn("at", F.timestamp_seconds(F.col("run_id") * 60))
    o.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windowed_failures(spark.readStream.schema(o.schema).parquet(f"{tmp_path}/in"), "at")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("failures").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.window.start, r.failure_class, r.n) for r in df.collect())
    assert key(spark.table("failures")) == key(windowed_failures(o, "at"))


def test_difficulty_default(spark):
    c = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.0), (2, 2, 0, 0, 0, 2, 4, 0, 0, 0, 0.0)], "case_id int, truth int, chain int, flows int, cross_file int, candidates int, evaluated int, failures int, depth int, rounds int, risk double").withColumn("bundle", F.lit(0))
    got = {r.case_id: (r.labels, r.score, r.bucket) for r in experiments.difficulty(c).collect()}
    assert got[1] == (["single_function_direct"], 0, "easy") and got[2] == (["multi_ground_truth", "patch_candidate_competition", "wide_beam_search"], 4, "hard")


def test_broken_manifests_are_rows(spark, tmp_path):
    good = '{\n "cases": [{"name": "a", "failing_tests": ["t"]},\n {"name": "b", "metadata": {"k": "v"}}], "more": 1}'
    for name, text in (("good", good), ("broken", '{"cases": [{"name": '), ("other", '{"runs": []}'), ("empty", '{"cases": []}'), ("kind", '{"cases": "none"}')):
        (tmp_path / f"{name}.json").write_text(text)
    cases = {r.name: r for r in manifests.read_cases(spark, str(tmp_path)).collect()}
    assert set(cases) == {"a", "b"} and cases["a"].passed_tests == [] and cases["a"].metadata == {} and cases["b"].metadata == {"k": "v"}
    assert all(r.file.endswith("/good.json") for r in cases.values())
    why = {Path(r.file).stem: r.reason for r in manifests.unread(spark, str(tmp_path)).collect()}
    assert why == {"broken": "not_readable", "other": "no_fields", "empty": "no_cases", "kind": "not_readable"}


def test_bootstrap_brackets_the_mean(spark, small):
    for r in registry.QUERIES["bootstrap_ci"](spark, small).collect():
        assert r.low - 1e-9 <= r["mean"] <= r.high + 1e-9 and not math.isnan(r.low)


def test_library_stands_without_llm(tmp_path, small):
    """A copy of the tree without the corpus operators, their tests and their pipeline imports and answers."""
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json", "*.txt"))
    code = "import __spark_entry__ as e, sys\nfrom tesserae.session import local_session\n" \
           "assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())\n" \
           "assert not [k for k in e.queries() if k.startswith('op1') or k == 'pipeline'] and not [m for m in sys.modules if 'llm' in m]\n" \
           f"assert e.queries()['ochiai'](local_session(2), {small!r}).count() > 0"
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=300, env=env)


def test_failure_line_takes_only_blanks_away(spark):
    texts = ["0997 | 0", "  \u3000\n\u00a0 11 of 1 \u2009\nmore", "\t\nx", "", None, "1" * 121, " " + "0" * 120]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", logs.failure_line("text").alias("line"))
    got = [r.line for r in rows.orderBy("i").collect()]
    assert got == ["0997 | 0", "11 of 1", "\t", "", "", "1" * 117 + "...", "0" * 120]


def test_role_ranking_settles_full_ties_by_id(spark):
    one = ("b", "f", "src/a.py", 1, 1, 1, 2.0)
    rows = spark.createDataFrame([(i, *one) for i in (7, 3, 9, 1, 8, 2)], "id long, brand string, name string, path string, findings int, rules int, types int, graph double").coalesce(1)
    got = scoring.role_ranking(rows, "brand", "path", "name").orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2, 3, 7, 8, 9]


def test_entities_alike_in_all_points_are_one(spark, monkeypatch):
    """2,000 entities of four kinds: four rows meet the tests and frames, and the first of a kind is the answer."""
    rows = [(i, f"src/m{i % 2}.py", f"fn_{i % 4}", f"pkg.fn_{i % 4}", 10 * (i % 4), 10 * (i % 4) + 5) for i in range(2000)]
    entities = spark.createDataFrame(rows, "entity long, path string, name string, qualified string, start_line int, end_line int")
    sizes, real = [], storage.stored

    def counted(df, name):
        out = real(df, name)
        if name == "entities":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(logs, "stored", counted)
    frames = spark.createDataFrame([("/w/src/m1.py", 12, "fn_1"), ("m1.py", 33, "other"), ("m0.py", 99, "fn_2")], "path string, line int, function string")
    got = {(r.path, r.line): (r.entity, r.score) for r in logs.match_frames(frames, entities).collect()}
    assert got == {("/w/src/m1.py", 12): (1, 15), ("m1.py", 33): (3, 8), ("m0.py", 99): (2, 6)}
    tests = spark.createDataFrame([("n", "src/m1.py", "fn_3", "fn_3")], "nodeid string, path string, test string, qualified string")
    assert [tuple(r) for r in logs.match_tests(tests, entities).select("entity", "score").collect()] == [(3, 6)]
    assert sizes == [4, 4]


def test_covering_tests_makes_no_row_for_a_test_and_function(spark, monkeypatch):
    rng = random.Random(5)
    hits = [(rng.randrange(40), f"f{rng.randrange(2)}", rng.randrange(1, 60)) for _ in range(600)] + [(None, "f0", 5)]
    functions = [(f"f{i % 2}", i, a, a + rng.randrange(-1, 30), i % 7 == 0) for i in range(300) for a in [rng.randrange(50)]]
    want = {}
    for file, f, a, b, test in functions:
        n = len({t for t, g, line in hits if g == file and a < line <= b and t is not None})
        if n and not test:
            want[f] = n
    rows, real = [], storage.stored
    monkeypatch.setattr(coverage, "stored", lambda df, name: (rows.append(real(df, name)), rows[-1])[1])
    h = spark.createDataFrame(hits, "test int, file string, line int")
    f = spark.createDataFrame(functions, "file string, function int, start_line int, end_line int, is_test boolean")
    assert {r.function: r.tests for r in coverage.covering_tests(h, f).collect()} == want
    assert rows and all(r.count() <= 600 for r in rows)


def test_innermost_function_of_many_on_the_same_lines(spark, monkeypatch):
    sizes, real = [], storage.stored
    monkeypatch.setattr(coverage, "stored", lambda df, name: (sizes.append(df.count()), real(df, name))[1])
    f = spark.createDataFrame([("f", i, 10 * (i % 3), 40) for i in range(900)], "file string, function int, start_line int, end_line int")
    got = coverage.innermost_function(spark.createDataFrame([("f", 25), ("f", 5)], "file string, line int"), f).collect()
    assert {(r.line, r.function) for r in got} == {(25, 899), (5, 897)} and sizes == [3]


def test_best_match_of_kinds(spark, monkeypatch):
    """500 seeds of two kinds and 300 candidates of three; against every pair."""
    seeds = [(s, t, v) for s in range(500) for t, v in (("failure_type", s % 2), ("rule", s % 2))] + [(500, "focus", 9)]
    catalogue = [(c, t, v, c % 3 / 10) for c in range(300) for t, v in (("failure_type", c % 3), ("rule", c % 3), ("focus", 1))]
    sizes, real = {}, storage.stored
    monkeypatch.setattr(selection, "stored", lambda df, name: (sizes.update({name: df.count()}), real(df, name))[1])
    got = {r.seed: (r.candidate, r.score, r.status) for r in selection.best_match(
        spark.createDataFrame(seeds, "seed int, tag string, value int"), spark.createDataFrame(catalogue, "candidate int, tag string, value int, bonus double")).collect()}
    assert got == {s: (s % 2, 5 + s % 2 / 10, "realized") for s in range(500)} | {500: (None, 0.0, "unmatched")}
    assert sizes["kinds"] == 3 and sizes["candidates"] == 3


def test_target_priority_by_row_and_without_a_shuffle(spark):
    rows = spark.createDataFrame(
        [(1, [1, 2, None, 1], "A", ["x"], "deep", 3), (1, [9], "A", ["x"], "deep", 3), (2, None, "B", [], "n", 1), (3, [2], "B", ["x"] * 9, "n", None)],
        "id long, rules array<bigint>, kind string, failures array<string>, name string, grp bigint")
    signals = spark.createDataFrame([("deep", [1, 2, 3, None], ["A"], 3), ("wide", [2], ["C"], None)], "signal string, rules array<bigint>, kinds array<string>, grp bigint")
    got = scoring.target_priority(rows, signals, "id")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.signal, r.priority) for r in got.collect()) == [(1, "deep", 67.5), (1, "wide", 11.5), (3, "deep", 9.0), (3, "wide", 14.0)]


def test_target_priority_of_every_pair(spark, small):
    rows = spark.createDataFrame(
        [(1, [9], "A", ["x"], "deep", 3), (2, None, "B", [], "n", 1), (3, [2], "B", None, "n", None)],
        "id long, rules array<bigint>, kind string, failures array<string>, name string, grp bigint")
    signals = spark.createDataFrame([("deep", [1, 2], ["A"], 3), ("free", [], ["C"], None)], "signal string, rules array<bigint>, kinds array<string>, grp bigint")
    got = scoring.target_priority(rows, signals, "id", every=True)
    assert sorted((r.id, r.signal, r.priority) for r in got.collect()) == [
        (1, "deep", 50.5), (1, "free", 0.5), (2, "deep", -10.0), (2, "free", 0.0), (3, "deep", 6.0), (3, "free", 0.0)]
    orders = spark.read.parquet(f"{small}/orders.parquet").count()
    assert registry.QUERIES["target_priority"](spark, small).count() == 3 * orders
