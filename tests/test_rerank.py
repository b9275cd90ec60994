"""Greedy rerankings against a walk over all rows."""

import random

import pytest

from tesserae.operators import selection


def walk(rows, kinds, worth, tie, weight, most=None, plain_first=False):
    """{id: (bonus, rank)} of one case's dicts."""
    left, seen, out = sorted(rows, key=lambda r: (-r[worth], r[tie], r["id"])), {k: set() for k, _ in kinds}, {}
    while left:
        def bonus(r):
            new = sum(w for k, w in kinds if r[k] not in seen[k]) if out or not plain_first else 0.0
            return min(new, most) if most else new

        best = max(range(len(left)), key=lambda i: (left[i][worth] + weight * bonus(left[i]), left[i][worth], -i))
        r = left.pop(best)
        out[r["id"]] = (bonus(r), len(out) + 1)
        for k, _ in kinds:
            seen[k].add(r[k])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rerank(spark, seed):
    """One case has most rows and few kinds of them, one has a kind a row; many ties."""
    chance = random.Random(seed)
    cases = {1: (300, 2), 2: (60, 50), 3: (1, 1)}
    rows = [{"case_id": c, "id": 1000 * c + i, "prior": chance.randrange(8) / 16, "score": float(chance.randrange(12)), "base_rank": chance.randrange(40),
             **{k: chance.randrange(most) for k in ("function", "rule", "variant", "risk_bucket", "kind", "upstream", "source")}} for c, (n, most) in cases.items() for i in range(n)]
    frame = spark.createDataFrame(rows)
    by_prior = (("function", 0.35), ("rule", 0.35), ("variant", 0.20), ("risk_bucket", 0.10))
    by_score = (("rule", 3.0), ("kind", 2.0), ("upstream", 2.0), ("function", 1.5), ("source", 1.0))
    one = {r.id: (r.bonus, r["rank"]) for r in selection.diversity_rerank(frame, weight=0.5).collect()}
    two = {r.id: (r.bonus, r["rank"]) for r in selection.feature_rerank(frame).collect()}
    for c in cases:
        own = [r for r in rows if r["case_id"] == c]
        want = walk(own, by_prior, "prior", "base_rank", 0.5)
        assert {i: one[i][1] for i in want} == {i: n for i, (_, n) in want.items()} and all(one[i][0] == pytest.approx(b) for i, (b, _) in want.items())
        want = walk(own, by_score, "score", "id", 1.0, 8.0, True)
        assert {i: two[i] for i in want} == want


def test_only_heads_have_a_bonus(spark):
    """Of a case with 4,000 rows of two kinds, two have a bonus; its ranks are whole."""
    frame = spark.range(4000).selectExpr("1 as case_id", "id", "cast(id % 100 as double) / 100 as prior", "cast(id as int) as base_rank", "id % 2 as function", "id % 2 as rule", "1 as variant", "1 as risk_bucket")
    got = selection.diversity_rerank(frame).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 4001)) and sum(r.bonus > 0 for r in got) == 2


def test_bonuses_add_up_as_in_sql(spark):
    """.35 + .35 + .2 + .1 is a bit less than 1 in doubles, added from left to right; where decimals tie, that bit decides."""
    priors = [(0.0357, 0.0957), (0.0362, 0.0962), (0.042, 0.102), (0.0483, 0.1083)]
    rows = [(c, 3 * c + i, p, i, *[kind] * 4) for c, (new, old) in enumerate(priors) for i, (p, kind) in enumerate([(0.95, 0), (new, 1), (old, 0)])]
    got = {r.id: r["rank"] for r in selection.diversity_rerank(spark.createDataFrame(rows, "case_id long, id long, prior double, base_rank int, function int, rule int, variant int, risk_bucket int")).collect()}
    for c, (new, old) in enumerate(priors):
        first = new + 0.06 * (0.35 + 0.35 + 0.20 + 0.10) > old
        assert [got[3 * c + i] for i in range(3)] == ([1, 2, 3] if first else [1, 3, 2])
