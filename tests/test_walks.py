"""Walks from many sources and condensations against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import graph, taskwalks, walks
from tesserae.sources.storage import made


def frame(spark, arcs):
    return spark.createDataFrame(arcs, "src long, dst long")


def distances(arcs, source):
    out, front, d = {source: 0}, [source], 0
    ways = {}
    for a, b in arcs:
        ways.setdefault(a, set()).add(b)
    while front:
        d += 1
        front = sorted({b for a in front for b in ways.get(a, ())} - set(out))
        out.update(dict.fromkeys(front, d))
    return out


def random_graph(seed, n, m):
    chance = random.Random(seed)
    arcs = [(chance.randrange(n), chance.randrange(n)) for _ in range(m)]
    # chains, rings, a component with a tail, a node with an arc to itself
    arcs += [(1000 + i, 1001 + i) for i in range(9)] + [(3, 1000), (1009, 5)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    arcs += [(3000, 3001), (3001, 3002), (3002, 3000), (3002, 3003), (3003, 3004), (3004, 3004), (3005, 3000), (3010, 3011), (3011, 3012), (3012, 3010), (3009, 3010)]
    return arcs + arcs[:5]


@pytest.mark.parametrize("seed, n, m", [(2, 60, 110)])
def test_reach_counts(spark, monkeypatch, seed, n, m):
    arcs = random_graph(seed, n, m)
    sources = sorted({a for pair in arcs for a in pair} | {9999})
    got = {}
    for r in walks.reach_counts(frame(spark, arcs), spark.createDataFrame([(s,) for s in sources + sources[:2]], "source long"), 4).collect():
        got[r.source, r.distance] = r.reached
    want = {}
    for s in sources:
        for d in distances(arcs, s).values():
            if d <= 4:
                want[s, d] = want.get((s, d), 0) + 1
    assert got == want


def test_walk_table_is_nodes_by_blocks(spark):
    """A complete graph of 300 nodes from 300 sources: 300 x 2 rows hold the 90,000 pairs."""
    arcs = frame(spark, [(a, b) for a in range(300) for b in range(300) if a != b])
    placed = walks.with_bits(spark.range(300).select(F.col("id").alias("source")).coalesce(1))
    start = walks.words(placed, F.col("source"))
    for distance, front, seen in walks.fronts(arcs, start):
        assert distance == 1 and front.count() <= 600 and seen.count() == 600
    assert walks.bits_by_source(seen, placed).agg(F.sum("n")).head()[0] == 90_000


@pytest.mark.parametrize("seed, n, m", [(4, 60, 70)])
def test_condensed(spark, seed, n, m):
    arcs = random_graph(seed, n, m)
    nodes = sorted({a for pair in arcs for a in pair})
    reach = {a: set(distances(arcs, a)) for a in nodes}
    groups, acyclic = walks.condensed(frame(spark, arcs))
    at = {r.id: (r.grp, r.at, r.weight) for r in groups.collect()}
    assert sorted(at) == nodes
    for a in nodes:
        own = {b for b in nodes if at[b][0] == at[a][0]}
        assert own & reach[a] == {b for b in own if at[b][1] >= at[a][1]} and len(own) == at[a][2]
        assert len(own & reach[a]) == at[a][2] - at[a][1]
    over = [(r.src, r.dst) for r in acyclic.collect()]
    assert len(over) == len(set(over))
    for a in nodes:
        groups_of = set(distances(over, at[a][0]))
        assert {at[b][0] for b in reach[a]} == groups_of
    # no way back
    assert all(a not in set(distances(over, b)) for a, b in over)


@pytest.mark.parametrize("seed, n, m", [(1, 30, 25)])
def test_dependency_fanout(spark, seed, n, m):
    arcs = random_graph(seed, n, m)
    kinds = [("data_flow", "control_flow")[(a + b) % 2] for a, b in arcs]
    edges = spark.createDataFrame([(*a, k) for a, k in zip(arcs, kinds, strict=True)] + [(1, 77_777, "calls")], "src long, dst long, kind string")
    sources = sorted({a for pair in arcs for a in pair}) + [88_888]
    changed = spark.createDataFrame([(s,) for s in sources], "source long")
    before = set(made())
    got = {r.source: r.fanout for r in graph.dependency_fanout(edges, changed).collect()}
    assert len(set(made()) - before) == 1  # rounds don't stay on disk
    for s in sources:
        beside = {a for a, b in arcs if b == s} | {b for a, b in arcs if a == s}
        n_keys = sum((k == "control_flow") * ((a == s) + (b == s)) for (a, b), k in zip(arcs, kinds, strict=True))
        assert got[s] == len((set(distances(arcs, s)) | beside) - {s}) + n_keys
    few = {r.source: r.fanout for r in graph.dependency_fanout(edges, changed, depth=1).collect()}
    assert all(few[s] <= got[s] for s in sources)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 5,000 and a ring of 3,000: rounds grow with the logarithm of the length."""
    arcs = frame(spark, [(i, i + 1) for i in range(5000)] + [(10_000 + i, 10_000 + (i + 1) % 3000) for i in range(3000)])
    rounds = []
    real = walks.stored
    monkeypatch.setattr(walks, "stored", lambda df, name: (rounds.append(name), real(df, name))[1])
    sources = spark.createDataFrame([(0,), (4990,), (10_005,)], "source long")
    got = {r.source: r.n for r in walks.fanout_counts(arcs, sources, spark.createDataFrame([], "source long, id long")).collect()}
    assert got == {0: 5000, 4990: 10, 10_005: 2999}
    assert len(rounds) < 60


def test_empty_graph(spark):
    none = frame(spark, [])
    groups, arcs = walks.condensed(none)
    assert groups.count() == 0 and arcs.count() == 0
    one = spark.createDataFrame([(1,)], "source long")
    assert [tuple(r) for r in walks.reach_counts(none, one).collect()] == [(1, 0, 1)]
    assert walks.reach_counts(none, one.limit(0)).count() == 0


def test_blocks_have_sources_that_follow_each_other(spark):
    """40 rings of 32 nodes: a block of 256 sources reaches few rings, so there are about as many rows as nodes."""
    arcs = frame(spark, [(1000 * r + i, 1000 * r + (i + 1) % 32) for r in range(40) for i in range(32)])
    sources = arcs.select(F.col("src").alias("source")).repartition(8, F.xxhash64("src"))
    seen, placed = walks.reach_bits(arcs, sources, 40)
    assert walks.bits_by_source(seen, placed).where("n <> 32").count() == 0
    assert seen.count() <= 3 * 40 * 32


@pytest.mark.parametrize("seed", [3, 8])
def test_shortest_paths(spark, seed):
    arcs = random_graph(seed, 40, 110) + [(500, 501), (501, 500)]
    nodes = sorted({a for pair in arcs for a in pair})
    rng = random.Random(seed)
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)] + [(nodes[0], nodes[0]), (nodes[0], 9999), (9999, nodes[0])]
    for depth in (2, 8):
        want = {}
        for s, t in pairs:
            front, before = {s: [s]}, set()
            for _ in range(depth + 1):
                if t in front:
                    want[s, t] = front[t]
                    break
                before |= set(front)
                step = {}
                for a, b in arcs:
                    if a in front and b not in before:
                        step[b] = min(step.get(b, front[a] + [b]), front[a] + [b])
                front = step
        got = graph.bfs_paths(frame(spark, arcs), spark.createDataFrame(pairs, "source long, target long").distinct(), depth).collect()
        assert {(r.source, r.target): r.path for r in got} == want


def test_caller_impact_in_small_tasks(spark, monkeypatch):
    chance = random.Random(4)
    n = 40
    edges = [(a, b, chance.random() < 0.3) for a, b in ((chance.randrange(n), chance.randrange(n)) for _ in range(110)) if a != b]
    edges += [(a, 7, False) for a in range(n) if a != 7]
    files = {i: None if i == 3 else f"f{i % 4}" for i in range(n)}
    tests = {i for i in range(n) if i % 9 == 0}
    want = {}
    for target in range(n):
        front, seen = {target: False}, {target}
        for hops in (1, 2, 3):
            step = {}
            for a, b, awaited in edges:
                if b in front and a not in seen and a not in tests:
                    step[a] = step.get(a, False) or front[b] or awaited
            for a, waits in step.items():
                other = None not in (files[a], files[target]) and files[a] != files[target]
                want[target] = want.get(target, 0) + 0.5 ** (hops - 1) * (1 + 0.5 * other + 0.15 * waits)
            front, seen = step, seen | set(step)
    dealt = []
    repartition = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, tasks, *by: dealt.append(tasks) or repartition(self, tasks, *by))
    e = spark.createDataFrame([(a, b, "calls", w) for a, b, w in edges], "src long, dst long, kind string, awaited boolean")
    nodes = spark.createDataFrame([(i, files[i], i in tests) for i in range(n)], "id long, file string, is_test boolean")
    got = {r.id: r.impact for r in graph.caller_impact(e, nodes, task_rows=100).collect()}
    assert got == pytest.approx(want)
    assert dealt[-1] > 5
    assert max(r.n for r in graph.caller_lists(frame(spark, [(a, 1) for a in range(900)]).withColumn("mark", F.lit(0)), 30).select(F.size("ids").alias("n")).collect()) < 90


@pytest.mark.parametrize("small", [False, True])
def test_walks_in_tasks_equal_those_by_shuffles(spark, monkeypatch, small):
    """Reach, slices and paths from 320 sources; no front is stored, also with one word at a time and many files."""
    chance = random.Random(6)
    arcs = [(chance.randrange(400), chance.randrange(400)) for _ in range(900)] + [(1000 + i, 1001 + i) for i in range(6)] + [(7, 7), (8, 1000)]
    edges = spark.createDataFrame(
        [(a, b, chance.choice(["calls", "data_flow", "control_flow", "other", None])) for a, b in arcs + arcs[:200] + arcs[:3] * 2], "src long, dst long, kind string")
    sources = spark.createDataFrame([(i,) for i in range(318)] + [(9999,), (1000,)], "source long")
    targets = sources.withColumnRenamed("source", "target")
    pairs = spark.createDataFrame([(chance.randrange(320), chance.choice([chance.randrange(400), 1003])) for _ in range(900)], "source long, target long").distinct()

    def found():
        return [sorted(map(str, f.collect())) for f in (
            walks.reach_counts(edges, sources, 5), graph.slice_summary(edges, targets, 2), walks.shortest_paths(edges, pairs, 6))]

    if small:
        for name, value in {"WORD_BYTES": 1, "ARCS": 100, "HELD": 0, "BACK": 1}.items():
            monkeypatch.setattr(taskwalks, name, value)
    names, real = [], walks.stored
    monkeypatch.setattr(walks, "stored", lambda df, name: (names.append(name), real(df, name))[1])
    got = found()
    assert not {"front", "seen", "start", "ways"} & set(names)
    monkeypatch.setattr(taskwalks, "NODES", -1)
    assert got == found() and all(len(g) > 100 for g in got)
    assert "front" in names


def test_hops_of_pairs_in_tasks(spark, monkeypatch):
    """As by shuffles, up to odd and even numbers of steps, also where lists are made for a few pairs at a time; no row a node and end is stored."""
    chance = random.Random(12)
    arcs = [(chance.randrange(300), chance.randrange(300)) for _ in range(500)] + [(i, 299) for i in range(250)] + [(400, 401), (401, 402), (402, 403), (403, 404), (7, 7)]
    edges = spark.createDataFrame([(a, b, "calls" if a % 9 else "data_flow", 1) for a, b in arcs], "src long, dst long, kind string, distance int")
    pairs = [(chance.randrange(300), chance.randrange(300)) for _ in range(400)] + [(400, 403), (404, 400), (5, 5), (9999, 3)]
    p = spark.createDataFrame(sorted(set(pairs)), "a long, b long")
    names, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: (names.append(name), real(df, name))[1])
    for hops in (3, 4):
        monkeypatch.setattr(taskwalks, "NODES", 1 << 24)
        monkeypatch.setattr(taskwalks, "MOST_BACK", 1 << 23 if hops == 3 else 50)
        got = sorted(map(str, graph.pair_links(p, edges, hops).collect()))
        assert not {"forward", "back"} & set(names)
        monkeypatch.setattr(taskwalks, "NODES", -1)
        assert got == sorted(map(str, graph.pair_links(p, edges, hops).collect()))
        names.clear()
    assert sum("hops=None" in g for g in got) not in (0, len(got))
