"""The best bundles against all bundles."""

import random
from itertools import combinations, product

import pytest

from tesserae.operators import scoring


def plain(members, links, k, most):
    """{case: [(members, priority)]} by the whole product."""
    out = {}
    for case in {m[0] for m in members}:
        groups = {}
        for m in members:
            if m[0] == case:
                groups.setdefault(m[1], []).append(m)
        own = lambda m: m[3] + 0.10 * (1 - min(1.0, m[5])) - 0.03 * m[2] - 0.02 * min(1.0, m[6] / 20)
        groups = {f: sorted(ms, key=lambda m: (-own(m), m[2]))[:2] for f, ms in groups.items()}
        found = []
        for size in range(2, most + 1):
            for fs in combinations(sorted(groups), size):
                ties = [links[p] for p in combinations(fs, 2) if p in links]
                bonus = sum(b for b, i in ((0.08, 0), (0.06, 1), (0.04, 2)) if any(t[i] for t in ties))
                bonus = min(0.20, bonus + 0.04 * sum(t[3] for t in ties) / (size * (size - 1) / 2))
                for ms in product(*(groups[f] for f in fs)):
                    priority = (sum(m[3] for m in ms) - 0.08 * sum(m[5] for m in ms)) / size + 0.08 * len({m[4] for m in ms}) + bonus - 0.02 * min(1.0, sum(m[6] for m in ms) / 40)
                    found.append((round(-priority, 9), [(m[1], m[2]) for m in ms]))
        out[case] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("seed, k, most", [(1, 8, 3), (2, 3, 2), (3, 5, 4)])
def test_bundles(spark, seed, k, most):
    chance = random.Random(seed)
    members = []
    for case, n in ((1, 30), (2, 9), (3, 2), (4, 1)):
        for f in chance.sample(range(100), n):
            members += [(case, f, v, round(chance.random() * chance.choice([0.3, 1]), 3), chance.randrange(4), round(chance.random() * 1.2, 2), chance.randrange(60)) for v in range(chance.randrange(1, 4))]
    links = {p: (chance.randrange(2), chance.randrange(2), chance.randrange(2), chance.random() < 0.4) for p in combinations(range(100), 2) if chance.random() < 0.08}
    frame = spark.createDataFrame(members, "case_id int, function int, variant int, localisation double, rule int, risk double, size int")
    tied = spark.createDataFrame([(*p, *t) for p, t in links.items()], "a int, b int, calls int, data_flow int, control_flow int, connected boolean")
    got = {}
    for r in sorted(scoring.bundles(frame, tied, k, most).collect(), key=lambda r: (r.case_id, r["rank"])):
        got.setdefault(r.case_id, []).append((round(-r.priority, 9), [tuple(m) for m in r.members]))
    assert got == {c: b for c, b in plain(members, links, k, most).items() if b}


def test_a_large_case_is_not_multiplied(monkeypatch):
    """Of 3,000 members, 4.5 billion triples, some hundreds are looked at."""
    import pandas as pd

    chance = random.Random(5)
    rows = [(1, f, 0, f % 7, 0.1, 5, chance.random()) for f in range(3000)]
    members = pd.DataFrame(rows, columns=["case_id", "function", "variant", "rule", "risk", "size", "_worth"])
    links = pd.DataFrame([(1, 2, 1, 1, 1, True)], columns=["a", "b", "calls", "data_flow", "control_flow", "connected"])
    looked, real = [], scoring._by_worth
    monkeypatch.setattr(scoring, "_by_worth", lambda *a: (looked.append(c) or c for c in real(*a)))
    best = scoring._best_bundles(members, links, 8, 3)
    assert len(best) == 8 and len(looked) < 20_000
