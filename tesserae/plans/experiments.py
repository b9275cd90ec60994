"""Experiment queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clamp, rounded
from ..operators import calibration as K
from ..operators import experiments as E
from ..operators.scoring import ATTEMPT_WEIGHTS, rank_within
from ..sources.storage import stored
from ..tables import VIEWS, table
from .base import query
from .calibration import SIGNALS_SQL, WEIGHTS, judged, signals
from .metrics import _CASES, ANALYSIS_SQL, analysis, cases, with_depth

# ---- ablations: the fused score without one signal each

ABLATED = {"full": [], **{f"without_{c}": [c] for c in WEIGHTS}}
_VARIANTS = SIGNALS_SQL + ", v AS (" + " UNION ALL ".join(
    f"SELECT case_id, grp, item, relevant, rank AS old, '{v}' AS variant, round({' + '.join(f'{w} * {c}' for c, w in WEIGHTS.items() if c not in off)}, 9) AS s FROM r" for v, off in ABLATED.items()) + """),
q AS (SELECT *, row_number() OVER (PARTITION BY variant, case_id ORDER BY s DESC, old) AS rnk FROM v),
h AS (SELECT *, sum(CASE WHEN relevant THEN 1 ELSE 0 END) OVER (PARTITION BY variant, case_id ORDER BY rnk) AS hits FROM q),
pc AS (SELECT variant, grp, case_id, sum(CASE WHEN relevant THEN 1 ELSE 0 END) AS nt, min(CASE WHEN relevant THEN rnk END) AS first, count(*) AS n,
  sum(CASE WHEN relevant THEN hits / rnk ELSE 0 END) AS prec, sum(CASE WHEN relevant AND rnk <= 3 THEN 1 / log2(rnk + 1.0) ELSE 0 END) AS dcg FROM h GROUP BY 1, 2, 3),
pm AS (SELECT variant, grp, case_id, CASE WHEN first <= 1 THEN 1.0 ELSE 0 END AS top1, CASE WHEN first <= 3 THEN 1.0 ELSE 0 END AS top3, coalesce(1.0 / first, 0) AS mrr, coalesce(prec / nullif(nt, 0), 0) AS map,
  coalesce(dcg / nullif(CASE WHEN nt >= 1 THEN 1.0 ELSE 0 END + CASE WHEN nt >= 2 THEN 1 / log2(3.0) ELSE 0 END + CASE WHEN nt >= 3 THEN 1 / log2(4.0) ELSE 0 END, 0), 0) AS ndcg, coalesce((first - 1) / n, 1.0) AS exam FROM pc),
ab AS (SELECT variant, count(*) AS cases, avg(top1) AS top1, avg(top3) AS top3, avg(mrr) AS mrr, avg(map) AS map, avg(ndcg) AS ndcg, avg(exam) AS exam FROM pm GROUP BY 1)"""


def _ablation(spark, sf):
    profiles = [{"profile": v, **{c: (0.0 if c in off else abs(w)) for c, w in WEIGHTS.items()}} for v, off in ABLATED.items()]
    lists = signals(spark, sf)
    m = E.profile_metrics(lists, profiles, list(WEIGHTS))
    return m.withColumnRenamed("profile", "variant")


_SIX = ("top1", "top3", "mrr", "map", "ndcg", "exam")


@query(_VARIANTS + " SELECT variant, cases, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SIX) + " FROM ab", "ranked")
def ablation_summary(spark, sf):
    return _ablation(spark, sf).select("variant", "cases", *[rounded(c).alias(c) for c in _SIX])


IMPACT = {"top1": 0.18, "map": 0.16, "mrr": 0.14, "ndcg": 0.12, "exam": 0.10}
_IMPACT = _VARIANTS + ", d AS (SELECT a.variant, " + ", ".join(
    f"{w} * ({'b' if m == 'exam' else 'a'}.{m} - {'a' if m == 'exam' else 'b'}.{m}) AS c_{m}" for m, w in IMPACT.items()) + """ FROM ab a, (SELECT * FROM ab WHERE variant = 'full') b WHERE a.variant <> 'full'),
im AS (SELECT variant, """ + " + ".join(f"c_{m}" for m in IMPACT) + " AS impact, list_sort([" + ", ".join(f"ROW(round(abs(c_{m}), 9), '{m}')" for m in IMPACT) + """])[-1] AS top FROM d),
ia AS (SELECT variant, impact, CASE WHEN impact <= -0.05 THEN 'regression' WHEN impact >= 0.05 THEN 'improvement' ELSE 'neutral' END AS direction, top[2] AS dominant FROM im)"""


def _impact(spark, sf):
    return E.ablation_impact(_ablation(spark, sf), IMPACT, ("exam",), "full")


@query(_IMPACT + " SELECT variant, round(impact, 6) AS impact, direction, dominant FROM ia", "ranked")
def ablation_impact(spark, sf):
    return _impact(spark, sf).withColumn("impact", rounded("impact"))


COMPONENTS = {"without_sbfl": "dynamic", "without_graph": "structure", "without_static": "static", "without_semantic": "text", "without_llm": "text", "without_risk": "structure"}


@query(_IMPACT + """, k AS (SELECT *, CASE variant WHEN 'without_sbfl' THEN 'dynamic' WHEN 'without_static' THEN 'static' WHEN 'without_semantic' THEN 'text' WHEN 'without_llm' THEN 'text' ELSE 'structure' END AS component FROM ia)
SELECT component, count(*) AS variants, count(*) FILTER (direction = 'regression') AS regressions, count(*) FILTER (direction = 'improvement') AS improvements,
max(ROW(round(abs(impact), 9), variant))[2] AS strongest, round(max(abs(impact)), 6) AS impact FROM k GROUP BY 1""", "ranked")
def component_rollup(spark, sf):
    return E.component_rollup(_impact(spark, sf), COMPONENTS).withColumn("impact", rounded("impact"))


# ---- strategies

_STRAT = """, a AS (SELECT *, (rank - 1) // 10 AS depth, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, rank) AS bs, row_number() OVER (PARTITION BY case_id, rule ORDER BY rank) AS rn FROM attempts),
u AS (SELECT case_id, id, success, 'full' AS strategy, rank AS o FROM a UNION ALL SELECT case_id, id, success, 'top1_only', rank FROM a WHERE rank = 1 UNION ALL SELECT case_id, id, success, 'depth0_only', rank FROM a WHERE depth = 0
  UNION ALL SELECT case_id, id, success, 'reflection_only', rank FROM a WHERE depth > 0 UNION ALL SELECT case_id, id, success, 'prior_order', bs FROM a UNION ALL SELECT case_id, id, success, 'first_per_rule', rank FROM a WHERE rn = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY strategy, case_id ORDER BY o, id) AS place FROM u),
g AS (SELECT strategy, case_id, count(*) AS evaluated, count(*) FILTER (success) AS successes, min(CASE WHEN success THEN place END) AS fr FROM p GROUP BY 1, 2),
c AS (SELECT g.*, CASE WHEN coalesce(g.fr, 999999) = coalesce(b.fr, 999999) THEN 'same' WHEN coalesce(g.fr, 999999) < coalesce(b.fr, 999999) THEN 'improvement' ELSE 'regression' END AS change
  FROM g LEFT JOIN (SELECT case_id, fr FROM g WHERE strategy = 'full') b USING (case_id))"""


@query(_STRAT + """ SELECT strategy, change, count(*) AS cases, round(avg(successes / evaluated), 6) AS mean_rate, CAST(sum(coalesce(fr - 1, evaluated)) AS BIGINT) AS failures FROM c GROUP BY 1, 2""", "attempts")
def strategy_delta(spark, sf):
    s = E.strategy_delta(E.strategies(with_depth(spark, sf)))
    return s.groupBy("strategy", "change").agg(F.count("*").alias("cases"), rounded(F.avg("rate")).alias("mean_rate"), F.sum("failures_before").alias("failures"))


# ---- weight grid

DEFAULT = {c: abs(w) for c, w in WEIGHTS.items()}
PROFILES = E.grid_profiles(default=DEFAULT)
_GRID_SQL = ("g AS (SELECT CASE WHEN sbfl = 0.3 AND graph = 0.25 AND static = 0.15 AND semantic = 0.1 AND llm = 0.15 AND risk = 0.05 THEN 'default' "
             "ELSE 'grid_' || lpad(CAST(row_number() OVER (ORDER BY sbfl, graph, static, semantic, llm, risk) - 1 AS VARCHAR), 3, '0') END AS profile, * FROM "
             "(SELECT unnest([0.2, 0.3, 0.4]::DOUBLE[]) AS sbfl), (SELECT unnest([0.15, 0.25, 0.35]::DOUBLE[]) AS graph), (SELECT unnest([0.1, 0.15, 0.2]::DOUBLE[]) AS static), "
             "(SELECT unnest([0.05, 0.1]::DOUBLE[]) AS semantic), (SELECT unnest([0.1, 0.15]::DOUBLE[]) AS llm), (SELECT unnest([0.0, 0.05, 0.1]::DOUBLE[]) AS risk))")


@query(SIGNALS_SQL + f""", {_GRID_SQL}, a AS (SELECT count(DISTINCT case_id) AS cases, count(*) AS items, avg(sbfl) AS m1, avg(graph) AS m2, avg(static) AS m3, avg(semantic) AS m4, avg(llm) AS m5, avg(risk) AS m6 FROM r)
SELECT profile, sbfl, graph, static, semantic, llm, risk, cases, items, round(sbfl * m1 + graph * m2 + static * m3 + semantic * m4 + llm * m5 - risk * m6, 6) AS mean_score FROM g, a""", "ranked")
def weight_grid(spark, sf):
    """The grid with the lists it is tried on: their number, their items and the items' mean score under each profile."""
    from ..functions import attach

    lists = signals(spark, sf).agg(F.countDistinct("case_id").alias("cases"), F.count("*").alias("items"), *[F.avg(c).alias(f"_{c}") for c in DEFAULT])
    score = sum(((-1 if c == "risk" else 1) * F.col(c) * F.col(f"_{c}") for c in DEFAULT), F.lit(0.0))
    return attach(E.weight_grid(spark, default=DEFAULT), lists, []).select("profile", *DEFAULT, "cases", "items", rounded(score).alias("mean_score"))


_PROF = SIGNALS_SQL + f""", {_GRID_SQL}, v AS (SELECT case_id, grp, item, relevant, rank AS old, profile AS variant,
  round(g.sbfl * r.sbfl + g.graph * r.graph + g.static * r.static + g.semantic * r.semantic + g.llm * r.llm - g.risk * r.risk, 9) AS s FROM r, g), """ + _VARIANTS.split("),\nq AS ", 1)[1].join(["q AS ", ""])
_VAL = "0.25 * map + 0.25 * mrr + 0.20 * ndcg + 0.15 * top1 + 0.10 * top3 + 0.05 * (1 - exam)"


def _profiled(spark, sf, *by):
    lists = signals(spark, sf)
    return E.profile_metrics(lists, PROFILES, list(DEFAULT), *by)


@query(_PROF + f" SELECT variant AS profile, cases, {', '.join(f'round({c}, 6) AS {c}' for c in _SIX)}, round({_VAL}, 6) AS validation FROM ab", "ranked")
def weight_search(spark, sf):
    return _profiled(spark, sf).select("profile", "cases", *[rounded(c).alias(c) for c in (*_SIX, "validation")])


@query(_PROF + """, s AS (SELECT variant AS profile, round(top1, 9) AS top1, round(map, 9) AS map, round(exam, 9) AS exam FROM ab),
d AS (SELECT a.profile, a.top1 - b.top1 AS d1, a.map - b.map AS d2, b.exam - a.exam AS d3 FROM s a JOIN s b ON a.profile <> b.profile)
SELECT profile, count(*) FILTER (greatest(d1, d2, d3) > 1e-9 AND least(d1, d2, d3) >= -1e-9) AS dominates, count(*) FILTER (least(d1, d2, d3) < -1e-9 AND greatest(d1, d2, d3) <= 1e-9) AS dominated_by,
count(*) FILTER (least(d1, d2, d3) < -1e-9 AND greatest(d1, d2, d3) <= 1e-9) = 0 AS optimal FROM d GROUP BY 1""", "ranked")
def pareto(spark, sf):
    m = stored(_profiled(spark, sf).select("profile", *[F.round(c, 9).alias(c) for c in ("top1", "map", "exam")]), "profiles")
    return E.pareto(m, "profile", ["top1", "map"], ["exam"])


@query(_PROF + f""", gm AS (SELECT variant AS profile, grp, count(*) AS n, avg(top1) AS top1, avg(map) AS map, avg({_VAL}) AS v FROM pm GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER w AS nn, sum(n * top1) OVER w AS t1, sum(n * map) OVER w AS t2, sum(n * v) OVER w AS tv FROM gm WINDOW w AS (PARTITION BY profile)),
rb AS (SELECT profile, max(tv / nn) AS validation, max(abs(coalesce((t1 - n * top1) / nullif(nn - n, 0), 0) - top1)) AS gap_top1, max(abs(coalesce((t2 - n * map) / nullif(nn - n, 0), 0) - map)) AS gap_map FROM t GROUP BY 1)
SELECT profile, round(validation, 6) AS validation, round(gap_top1, 6) AS gap_top1, round(gap_map, 6) AS gap_map, round(greatest(0.0, validation - 0.10 * gap_top1 - 0.10 * gap_map), 6) AS robust FROM rb""", "ranked")
def robust_score(spark, sf):
    r = E.holdout_robustness(_profiled(spark, sf, "grp"))
    return r.select("profile", *[rounded(c).alias(c) for c in ("validation", "gap_top1", "gap_map", "robust")])


# ---- repair profiles: the attempt score under 45 weightings, and the default one with a judge at three weights

REPAIR = [(p["profile"] if p["profile"] != "default" else "default", p["feedback"], p["diff"], p["risk"], 0.0)
          for p in E.grid_profiles(E.REPAIR_GRID, {"feedback": 0.08, "diff": 0.06, "risk": 0.03})]
REPAIR += [(f"default_judge{round(w * 100):02d}", 0.08, 0.06, 0.03, w) for w in E.JUDGE_WEIGHTS]
_FIXED = {c: w for c, w in ATTEMPT_WEIGHTS.items() if c not in E.REPAIR_GRID}
_REP = """, rg AS (SELECT * FROM (SELECT CASE WHEN f = 0.08 AND d = 0.06 AND k = 0.03 THEN 'default' ELSE 'grid_' || lpad(CAST(row_number() OVER (ORDER BY f, d, k) - 1 AS VARCHAR), 3, '0') END AS profile, f, d, k, 0.0::DOUBLE AS j
  FROM (SELECT unnest([0, 0.04, 0.08, 0.12, 0.16]::DOUBLE[]) AS f), (SELECT unnest([0.03, 0.06, 0.10]::DOUBLE[]) AS d), (SELECT unnest([0, 0.03, 0.06]::DOUBLE[]) AS k))
  UNION ALL SELECT 'default_judge' || n, 0.08, 0.06, 0.03, w FROM (VALUES ('04', 0.04::DOUBLE), ('08', 0.08), ('12', 0.12)) AS y(n, w)),
e AS (SELECT *, rule / 6.0 AS feedback, k / 99.0 AS ratio, variant / 5.0 AS risk, (id % 11) / 10.0 AS judge FROM attempts),
bs AS (SELECT *, 0.60 * ratio + 0.20 * score + 0.10 * CASE WHEN variant <> 4 THEN 1 ELSE 0 END - 0.01 * CASE WHEN variant = 3 THEN 1 ELSE 0 END + 0.12 * CASE WHEN success THEN 1 ELSE 0 END AS fixed FROM e),
v AS (SELECT case_id, grp, id, success, rank, feedback, profile, j > 0 AS judged, round((1 - j) * greatest(0.0, least(1.0, fixed + f * feedback - d * (1 - ratio) - rg.k * risk)) + j * judge, 9) AS s FROM bs, rg),
q AS (SELECT *, row_number() OVER (PARTITION BY profile, case_id ORDER BY s DESC, feedback DESC, rank) AS rnk FROM v),
c AS (SELECT profile, judged, grp, case_id, min(CASE WHEN success THEN rnk END) AS first, max(CASE WHEN success THEN s END) AS good, max(CASE WHEN NOT success THEN s END) AS bad FROM q GROUP BY 1, 2, 3, 4),
x AS (SELECT *, CASE WHEN good IS NULL THEN 0.0 ELSE greatest(0.0, good - coalesce(bad, 0)) END AS margin FROM c)"""


def _repair(spark, sf):
    """Attempts under each repair profile: score, then feedback, then the old rank."""
    a = VIEWS["attempts"](spark, sf)
    a = a.select("case_id", "id", "success", "grp", "rank", (F.col("k") / 99.0).alias("pass_ratio"), F.col("score").alias("localisation"), (F.col("variant") != 4).cast("double").alias("static_ok"),
                 F.lit(0.0).alias("prior"), (F.col("rule") / 6.0).alias("feedback"), (1 - F.col("k") / 99.0).alias("diff"), (F.col("variant") / 5.0).alias("risk"),
                 (F.col("variant") == 3).cast("double").alias("warning"), (F.col("id") % 11 / 10.0).alias("judge"))
    a = a.withColumn("fixed", sum((F.col(c) * w if c != "success" else F.col("success").cast("double") * w for c, w in _FIXED.items()), F.lit(0.0)))
    tried = [dict(zip(("profile", "f", "d", "r", "j"), x, strict=True)) for x in REPAIR]
    base = clamp(F.col("fixed") + F.col("p.f") * F.col("feedback") - F.col("p.d") * F.col("diff") - F.col("p.r") * F.col("risk"))
    rows = E.beside_profiles(a, tried).select(
        "block", "case_id", "id", "success", "grp", "rank", "feedback", "p.profile", F.round((1 - F.col("p.j")) * base + F.col("p.j") * F.col("judge"), 9).alias("score"))
    w = Window.partitionBy("block", "profile", "case_id", "grp").orderBy(F.desc("score"), F.desc("feedback"), "rank")
    return rows.withColumn("rank", F.row_number().over(w))


@query(_REP + """ SELECT profile, count(*) AS cases, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(first), 6) AS mean_rank,
round(avg(margin), 6) AS margin, round(0.55 * avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END) + 0.35 * avg(coalesce(1.0 / first, 0)) + 0.10 * least(1.0, avg(margin)), 6) AS score FROM x GROUP BY 1""", "attempts")
def patch_weight_search(spark, sf):
    m = E.repair_metrics(_repair(spark, sf))
    return m.select("profile", "cases", *[rounded(c).alias(c) for c in ("top1", "mrr", "mean_rank", "margin", "score")])


@query(_REP + """, m AS (SELECT profile, judged, round(0.55 * avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END) + 0.35 * avg(coalesce(1.0 / first, 0)) + 0.10 * least(1.0, avg(margin)), 9) AS score FROM x GROUP BY 1, 2),
b AS (SELECT max(ROW(score, profile)) FILTER (NOT judged) AS a, max(ROW(score, profile)) FILTER (judged) AS b FROM m)
SELECT a[2] AS plain, b[2] AS judged, round(b[1] - a[1], 6) AS gain, CASE WHEN b[1] - a[1] IS NULL THEN 'not_evaluated' WHEN b[1] - a[1] > 1e-9 THEN 'improved' ELSE 'no_gain' END AS status FROM b""", "attempts")
def judge_fusion(spark, sf):
    m = E.repair_metrics(_repair(spark, sf)).join(spark.createDataFrame([(p, j) for p, *_, j in [(*x[:4], x[4] > 0) for x in REPAIR]], "profile string, judged boolean"), "profile")
    return E.judge_gain(m, []).withColumn("gain", rounded("gain"))


# ---- generalisation, difficulty, budgets

_GEN = _CASES.replace(", c AS (SELECT case_id, grp,", ", c AS (SELECT case_id, grp,", 1) + """, sa AS (SELECT case_id, max(CASE WHEN success THEN 1.0 ELSE 0 END) AS success, min(CASE WHEN success THEN rank END) AS fr, count(*) AS ev FROM attempts GROUP BY 1),
y AS (SELECT m.grp, CASE WHEN m.first <= 1 THEN 1.0 ELSE 0 END AS top1, ap, success, CASE WHEN fr IS NULL THEN 0.0 ELSE 1.0 / fr END AS eff FROM m JOIN sa USING (case_id)),
g AS (SELECT grp, count(*) AS n, sum(top1) AS t, sum(ap) AS a, sum(success) AS s, sum(eff) AS e FROM y GROUP BY 1), tt AS (SELECT sum(n) AS nn, sum(t) AS tt, sum(a) AS ta FROM g),
gg AS (SELECT grp, n, t / n AS top1, coalesce((tt - t) / nullif(nn - n, 0), 0) AS train_top1, coalesce((ta - a) / nullif(nn - n, 0), 0) - a / n AS gap_map,
  0.35 * t / n + 0.30 * a / n + 0.25 * s / n + 0.10 * least(1.0, e / n) AS score FROM g, tt)"""


def _general(spark, sf):
    c = cases(spark, sf).select("case_id", "grp", F.coalesce(F.col("first") <= 1, F.lit(False)).cast("double").alias("top1"), "ap")
    s = VIEWS["attempts"](spark, sf).groupBy("case_id").agg(
        F.max(F.col("success").cast("double")).alias("success"), F.coalesce(1.0 / F.min(F.when(F.col("success"), F.col("rank"))), F.lit(0.0)).alias("efficiency"))
    return E.generalisation(c.join(s, "case_id"), "grp")


@query(_GEN + " SELECT grp, n, round(top1, 6) AS top1, round(train_top1, 6) AS train_top1, round(train_top1 - top1, 6) AS gap_top1, round(gap_map, 6) AS gap_map, round(score, 6) AS score FROM gg", "ranked", "attempts")
def generalization(spark, sf):
    return _general(spark, sf).select("grp", "n", *[rounded(c).alias(c) for c in ("top1", "train_top1", "gap_top1", "gap_map", "score")])


@query(_GEN + """, z AS (SELECT -sum(n / nn * log2(n / nn)) AS entropy, max(n) / min(n) AS imbalance, greatest(0.0, max(train_top1 - top1)) AS max_gap, min(ROW(round(score, 9), -n, grp)) AS w, max(score) AS best FROM gg, tt)
SELECT round(entropy, 6) AS entropy, round(imbalance, 6) AS imbalance, round(max_gap, 6) AS max_gap, w[3] AS worst, round(w[1], 6) AS worst_score, round(greatest(0.0, least(1.0, 1 - (best - w[1]))), 6) AS stability,
CASE WHEN max_gap >= 0.35 THEN 'high' WHEN max_gap >= 0.15 THEN 'medium' ELSE 'low' END AS risk FROM z""", "ranked", "attempts")
def generalization_summary(spark, sf):
    s = E.generalisation_summary(_general(spark, sf), "grp")
    return s.select(*[rounded(c).alias(c) for c in ("entropy", "imbalance", "max_gap")], "worst", *[rounded(c).alias(c) for c in ("worst_score", "stability")], "risk")


_DIFF = """, c AS (SELECT o_orderkey AS case_id, o_custkey % 3 AS truth, o_orderkey % 4 AS chain, o_custkey % 2 AS flows, o_orderkey % 3 AS cross_file, o_custkey % 4 AS candidates, o_orderkey % 7 AS evaluated,
  o_custkey % 5 - 2 AS failures, o_orderkey % 5 - 3 AS depth, o_custkey % 3 AS rounds, o_orderkey % 6 - 3 AS bundle, o_totalprice / 500000.0 AS risk, o_orderstatus = 'F' AS failed FROM orders),
l AS (SELECT *, list_filter([""" + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, (r, _) in E.DIFFICULTY.items()) + "], lambda x: x IS NOT NULL) AS ls, " + " + ".join(f"CASE WHEN {r} THEN {w} ELSE 0 END" for r, w in E.DIFFICULTY.values()) + """ AS score FROM c),
d AS (SELECT *, CASE WHEN len(ls) = 0 THEN ['single_function_direct'] ELSE ls END AS labels, CASE WHEN score >= 4 THEN 'hard' WHEN score >= 2 THEN 'medium' ELSE 'easy' END AS bucket FROM l)"""


def _difficulty(spark, sf):
    o = table(spark, sf, "orders")
    m = lambda c, n, less=0: (F.col(c) % n - less)
    return E.difficulty(o.select(
        F.col("o_orderkey").alias("case_id"), m("o_custkey", 3).alias("truth"), m("o_orderkey", 4).alias("chain"), m("o_custkey", 2).alias("flows"), m("o_orderkey", 3).alias("cross_file"),
        m("o_custkey", 4).alias("candidates"), m("o_orderkey", 7).alias("evaluated"), m("o_custkey", 5, 2).alias("failures"), m("o_orderkey", 5, 3).alias("depth"), m("o_custkey", 3).alias("rounds"),
        m("o_orderkey", 6, 3).alias("bundle"), (F.col("o_totalprice") / 500000.0).alias("risk"), (F.col("o_orderstatus") == "F").alias("failed")))


@query("WITH" + _DIFF[1:] + " SELECT bucket, label, count(*) AS cases, round(avg(CASE WHEN failed THEN 1.0 ELSE 0 END), 6) AS failed_rate, round(avg(score), 6) AS mean_score FROM (SELECT *, unnest(labels) AS label FROM d) GROUP BY 1, 2")
def difficulty(spark, sf):
    d = _difficulty(spark, sf).withColumn("label", F.explode("labels"))
    return d.groupBy("bucket", "label").agg(F.count("*").alias("cases"), rounded(F.avg(F.col("failed").cast("int"))).alias("failed_rate"), rounded(F.avg("score")).alias("mean_score"))


@query(ANALYSIS_SQL + ", b AS (SELECT unnest([1, 2, 3, 5, 8]) AS budget), s AS (SELECT budget, count(*) FILTER (first_success_rank <= budget) AS solved, count(*) AS n FROM n, b GROUP BY 1) "
       "SELECT budget, solved, round(solved / n, 6) AS rate, solved - coalesce(lag(solved) OVER (ORDER BY budget), 0) AS marginal FROM s", "attempts")
def budget_curve(spark, sf):
    return E.budget_curve(analysis(spark, sf)).withColumn("rate", rounded("rate"))


@query(ANALYSIS_SQL + """ SELECT case_id, round(CASE WHEN first_success_rank IS NULL THEN 1.0 ELSE first_success_rank / evaluated END, 6) AS effort, CAST(coalesce(evaluated - first_success_rank, 0) AS BIGINT) AS wasted,
round(failures_before / evaluated, 6) AS pressure FROM n""", "attempts")
def budget_effort(spark, sf):
    e = E.budget_effort(analysis(spark, sf))
    return e.select("case_id", rounded("effort").alias("effort"), "wasted", rounded("pressure").alias("pressure"))


_COMP = """, g AS (SELECT case_id, grp, count(*) AS evaluated, min(CASE WHEN success THEN rank END) AS fr, count(DISTINCT rule) AS rules, count(DISTINCT CASE WHEN NOT success THEN failure_type END) AS failures,
count(DISTINCT variant) AS variants FROM attempts GROUP BY 1, 2), k AS (SELECT *, coalesce(fr > 1, false) AS inversion, coalesce(fr - 1, evaluated) / evaluated AS pressure FROM g)"""


@query(_COMP + " SELECT case_id, grp, evaluated, inversion, round(pressure, 6) AS pressure, rules, failures, variants FROM k", "attempts")
def competition(spark, sf):
    return E.competition(VIEWS["attempts"](spark, sf), "case_id", "grp").withColumn("pressure", rounded("pressure"))


@query(""", b AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS nr, k / 99.0 AS bonus FROM attempts),
s AS (SELECT case_id, max(ROW(CASE WHEN rank > 3 AND nr <= 3 THEN 1 ELSE 0 END, rank - nr, bonus, -nr)) FILTER (success) AS b FROM b GROUP BY 1)
SELECT case_id, coalesce(b[1], 0) AS sensitive, CAST(b[2] AS INTEGER) AS lift, CAST(-b[4] AS INTEGER) AS rank FROM s""", "attempts")
def rerank_lift(spark, sf):
    a = VIEWS["attempts"](spark, sf).withColumn("base_rank", F.col("rank")).withColumn("bonus", F.col("k") / 99.0)
    return E.rerank_lift(rank_within(a, ["case_id"], "score", ["id"]))


@query(""" SELECT coalesce(p.failure_type, 'unknown') AS parent_failure, count(*) AS children, round(avg(CASE WHEN c.success THEN 1.0 ELSE 0 END), 6) AS rate, round(avg(c.score - p.score), 6) AS mean_delta
FROM attempts c LEFT JOIN attempts p ON c.case_id = p.case_id AND c.parent_id = p.id WHERE c.parent_id IS NOT NULL GROUP BY 1""", "attempts")
def reflection(spark, sf):
    r = E.reflection(VIEWS["attempts"](spark, sf))
    return r.select("parent_failure", "children", rounded("rate").alias("rate"), rounded("mean_delta").alias("mean_delta"))


_CLUSTER = """, j AS (SELECT *, CASE WHEN success THEN 1.0 ELSE 0.45 * (k / 99.0) + 0.35 * score + 0.20 * (1 - variant / 5.0) END AS evidence FROM attempts),
w AS (SELECT *, CASE WHEN abs(score - evidence) <= 0.25 THEN 'aligned' WHEN score > evidence THEN 'optimistic' ELSE 'conservative' END AS agreement FROM j),
cl AS (SELECT failure_type, agreement, rule, count(*) AS n, avg(score) AS raw, avg(evidence) AS calibrated, array_to_string(list_slice(list_sort(list(id)), 1, 3), ',') AS examples
  FROM w WHERE NOT (success AND agreement = 'aligned') GROUP BY 1, 2, 3)"""


def _clusters(spark, sf):
    return E.failure_clusters(judged(spark, sf), ["failure_type", "agreement", "rule"])


@query(_CLUSTER + " SELECT failure_type, agreement, rule, n, round(raw, 6) AS raw, round(calibrated, 6) AS calibrated, round(calibrated - raw, 6) AS delta, examples FROM cl", "attempts")
def failure_clusters(spark, sf):
    c = _clusters(spark, sf)
    return c.select("failure_type", "agreement", "rule", "n", *[rounded(x).alias(x) for x in ("raw", "calibrated", "delta")], F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query(_CLUSTER + """ SELECT failure_type, agreement, rule, CASE WHEN n >= 3 OR abs(calibrated - raw) >= 0.35 THEN 'high' WHEN n >= 2 OR abs(calibrated - raw) >= 0.20 THEN 'medium' ELSE 'low' END AS priority,
CASE agreement WHEN 'optimistic' THEN 'judge false-positive hardening' WHEN 'conservative' THEN 'judge false-negative recovery' ELSE 'execution-evidence calibration' END AS focus FROM cl""", "attempts")
def cluster_priority(spark, sf):
    long = F.when(F.col("agreement") == "aligned", "aligned").otherwise(F.concat(F.lit("judge_more_"), "agreement"))
    c = _clusters(spark, sf).withColumn("short", F.col("agreement")).withColumn("agreement", long)
    return c.select("failure_type", F.col("short").alias("agreement"), "rule", E.cluster_priority().alias("priority"), E.cluster_focus().alias("focus"))


_TARGETS = [("difficulty_bucket", "hard", 5 * 2000), *[("difficulty_label", k, v * 2000) for k, v in E.LABEL_TARGETS.items()], ("generalization_source_groups", "source_group_count", E.MIN_GROUPS * 2),
            ("difficulty_label", "cross_file_patch", 3 * 2000)]


@query("WITH" + _DIFF[1:] + """, n AS (SELECT 'difficulty_label' AS source, label AS signal, count(*) AS n FROM (SELECT unnest(labels) AS label FROM d) GROUP BY 2
  UNION ALL SELECT 'difficulty_bucket', bucket, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'generalization_source_groups', 'source_group_count', count(DISTINCT o_custkey % 4) FROM orders
  UNION ALL SELECT 'generalization_source_group_balance', CAST(o_custkey % 4 AS VARCHAR), count(*) FROM orders GROUP BY 2),
t AS (SELECT * FROM (VALUES ('difficulty_bucket', 'hard', 10000), ('difficulty_label', 'multi_ground_truth', 4000), ('difficulty_label', 'multi_patch_bundle', 4000), ('difficulty_label', 'wide_beam_search', 4000),
  ('difficulty_label', 'failed_before_success', 4000), ('difficulty_label', 'reflection_depth', 4000), ('difficulty_label', 'cross_file_patch', 6000), ('difficulty_label', 'patch_candidate_competition', 16000),
  ('difficulty_label', 'cross_function_trace', 16000), ('generalization_source_groups', 'source_group_count', 8)) v(source, signal, wanted)
  UNION ALL SELECT DISTINCT 'generalization_source_group_balance', CAST(o_custkey % 4 AS VARCHAR), 1000000 FROM orders),
j AS (SELECT t.source, t.signal, wanted, coalesce(n, 0) AS have, wanted - coalesce(n, 0) AS gap, CASE WHEN coalesce(n, 0) = 0 OR wanted - coalesce(n, 0) >= 3 THEN 3 WHEN wanted - coalesce(n, 0) >= 2 THEN 2 ELSE 1 END AS r
  FROM t LEFT JOIN n ON t.source = n.source AND t.signal = n.signal WHERE wanted > coalesce(n, 0))
SELECT source, signal, CAST(wanted AS BIGINT) AS wanted, have, gap, ['low', 'medium', 'high'][r] AS priority, CAST(row_number() OVER (ORDER BY r DESC, gap DESC, source DESC, signal DESC) AS INTEGER) AS place FROM j""")
def target_gaps(spark, sf):
    """Of difficulty labels and buckets, the number of source groups and the cases of each group."""
    d = _difficulty(spark, sf)
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 4).cast("string").alias("signal"))
    named = lambda rows, source: rows.select(F.lit(source).alias("source"), "signal", "n")
    counts = named(d.select(F.explode("labels").alias("signal")).groupBy("signal").agg(F.count("*").alias("n")), "difficulty_label").unionByName(
        named(d.groupBy(F.col("bucket").alias("signal")).agg(F.count("*").alias("n")), "difficulty_bucket")).unionByName(
        named(orders.agg(F.countDistinct("signal").alias("n")).withColumn("signal", F.lit("source_group_count")), "generalization_source_groups")).unionByName(
        named(orders.groupBy("signal").agg(F.count("*").alias("n")), "generalization_source_group_balance"))
    fixed = spark.createDataFrame([(*t, i) for i, t in enumerate(_TARGETS)], "source string, signal string, wanted long, ordinal int")
    groups = orders.distinct().select(F.lit("generalization_source_group_balance").alias("source"), "signal", F.lit(E.MIN_CASES_A_GROUP * 200_000).cast("long").alias("wanted"), F.lit(0).alias("ordinal"))
    return E.target_gaps(counts, fixed.unionByName(groups))


_PROV = """p AS (SELECT p_brand AS grp, p_partkey AS case_id, CASE p_size % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'v1.2.3' WHEN 2 THEN 'refs/heads/x' WHEN 3 THEN 'refs/tags/y' WHEN 4 THEN sha1(p_name) ELSE '' END AS ref,
  CASE WHEN p_size % 4 > 0 THEN sha256(p_name) END AS sha, CASE WHEN p_size % 5 > 0 THEN 'MIT' END AS licence, p_size % 3 > 0 AS mutated, p_name AS file, p_type || p_size AS signature FROM part),
g AS (SELECT grp, count(*) AS n, avg(CASE WHEN licence IS NOT NULL THEN 1.0 ELSE 0 END) AS provenance, avg(CASE WHEN sha IS NOT NULL THEN 1.0 ELSE 0 END) AS digest,
  avg(CASE WHEN ref LIKE 'v1%' OR ref LIKE 'refs/tags/%' OR length(ref) = 40 THEN 1.0 ELSE 0 END) AS stable, avg(CASE WHEN licence IS NOT NULL THEN 1.0 ELSE 0 END) AS licensed, avg(CASE WHEN mutated THEN 1.0 ELSE 0 END) AS mutation FROM p GROUP BY 1),
f AS (SELECT grp, max(c) AS most FROM (SELECT grp, file, count(*) AS c FROM p GROUP BY 1, 2) GROUP BY 1), s AS (SELECT grp, sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS d FROM (SELECT grp, signature, count(*) AS c FROM p GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT g.*, most / n AS concentration, d / n AS duplicates FROM g JOIN f USING (grp) JOIN s USING (grp)),
l AS (SELECT *, 0.20 * (1 - provenance) + 0.20 * (1 - mutation) + 0.15 * CASE WHEN digest > 0 THEN 1 - digest ELSE 0 END + 0.10 * (1 - stable) + 0.25 * duplicates + 0.10 * least(1.0, greatest(0.0, concentration - 0.5) / 0.5) AS leakage FROM v)"""


def _provenance(spark, sf):
    ref = F.when(F.col("p_size") % 6 == 0, "main").when(F.col("p_size") % 6 == 1, "v1.2.3").when(F.col("p_size") % 6 == 2, "refs/heads/x").when(F.col("p_size") % 6 == 3, "refs/tags/y").when(
        F.col("p_size") % 6 == 4, F.sha1(F.col("p_name").cast("binary"))).otherwise("")
    p = table(spark, sf, "part").select(
        F.col("p_brand").alias("grp"), F.col("p_partkey").alias("case_id"), ref.alias("ref"), F.when(F.col("p_size") % 4 > 0, F.sha2("p_name", 256)).alias("sha"),
        F.when(F.col("p_size") % 5 > 0, "MIT").alias("licence"), (F.col("p_size") % 3 > 0).alias("mutated"), F.col("p_name").alias("file"), F.concat("p_type", "p_size").alias("signature"))
    return E.provenance(p, "grp")


@query(f"WITH {_PROV} SELECT grp, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("provenance", "digest", "stable", "licensed", "mutation", "concentration", "duplicates", "leakage")) +
       ", CASE WHEN leakage >= 0.50 THEN 'high' WHEN leakage >= 0.25 THEN 'medium' ELSE 'low' END AS risk FROM l")
def provenance(spark, sf):
    p = _provenance(spark, sf)
    return p.select("grp", "n", *[rounded(c).alias(c) for c in ("provenance", "digest", "stable", "licensed", "mutation", "concentration", "duplicates", "leakage")], "risk")


@query(f"""WITH {_PROV}, x AS (SELECT p_brand AS grp, count(DISTINCT p_size) AS sources, count(DISTINCT CASE WHEN p_size % 3 = 0 THEN p_size END) AS hits, count(DISTINCT p_name) / count(*) AS density, count(DISTINCT p_size % 12) AS rules,
  count(DISTINCT p_type) AS types, count(DISTINCT p_size % 2) AS groups FROM part GROUP BY 1)
SELECT grp, round((hits / sources + least(1.0, density) + least(1.0, rules / 3.0) + least(1.0, types / 3.0) + least(1.0, groups / 2.0) + provenance + stable + CASE WHEN digest > 0 THEN digest ELSE 1 END + licensed + 1 - leakage) / 10, 6) AS quality,
provenance >= 0.95 AND leakage <= 0.30 AS ready FROM l JOIN x USING (grp)""")
def mining_quality(spark, sf):
    x = table(spark, sf, "part").groupBy(F.col("p_brand").alias("grp")).agg(
        F.countDistinct("p_size").alias("sources"), F.countDistinct(F.when(F.col("p_size") % 3 == 0, F.col("p_size"))).alias("hits"), (F.countDistinct("p_name") / F.count("*")).alias("density"),
        F.countDistinct(F.col("p_size") % 12).alias("rules"), F.countDistinct("p_type").alias("types"), F.countDistinct(F.col("p_size") % 2).alias("groups"))
    return E.mining_quality(_provenance(spark, sf).join(x, "grp"), "grp").withColumn("quality", rounded("quality"))


_SIGNALS = [*E.SIGNAL_LINKS, "other"]
_LINKS = ", ".join(f"('{s}', '{v}', {i + 1})" for s, vs in E.SIGNAL_LINKS.items() for i, v in enumerate(vs))


@query("WITH l AS (SELECT * FROM (VALUES " + _LINKS + ") v(signal, variant, place)), a AS (SELECT [" + ", ".join(f"'{s}'" for s in _SIGNALS) + f"][event_id % {len(_SIGNALS)} + 1] AS signal FROM events) "
       "SELECT signal, variant, place, CASE WHEN signal = 'search_diversity_reranking' AND variant = 'without_diversity_reranking' THEN 1 ELSE 0 END AS priority, count(*) AS n FROM a JOIN l USING (signal) GROUP BY 1, 2, 3")
def signal_links(spark, sf):
    a = table(spark, sf, "events").select(F.get(F.array(*map(F.lit, _SIGNALS)), (F.col("event_id") % len(_SIGNALS)).cast("int")).alias("signal"))
    return E.signal_links(a, "signal").groupBy("signal", "variant", "place", "priority").agg(F.count("*").alias("n"))


_LABELS = {"error": ("broad_exception_pass", "exception"), "view": ("dict_missing_key_guard", "key access"), "click": ("possible_index_overrun", "boundary")}


@query(_CLUSTER + """, c2 AS (SELECT failure_type, agreement, sum(n) AS n FROM cl GROUP BY 1, 2 ORDER BY n DESC, failure_type, agreement LIMIT 6)
SELECT 'seed-' || regexp_replace(lower(failure_type || '-' || agreement), '[^a-z0-9]+', '-', 'g') AS seed, CASE failure_type WHEN 'error' THEN 'broad_exception_pass' WHEN 'view' THEN 'dict_missing_key_guard'
WHEN 'click' THEN 'possible_index_overrun' ELSE 'unknown_rule' END AS rule, CASE failure_type WHEN 'error' THEN 'exception' WHEN 'view' THEN 'key access' WHEN 'click' THEN 'boundary' ELSE 'general' END AS bug_type, CAST(n AS BIGINT) AS n FROM c2""", "attempts")
def seed_rows(spark, sf):
    c = E.failure_clusters(judged(spark, sf), ["failure_type", "agreement"])
    return E.seed_rows(c, 6, _LABELS)


@query(_COMP + """, t AS (SELECT case_id, list_distinct(list(rule)) AS rules, bool_or(success) AS success FROM attempts WHERE rank <= 5 GROUP BY 1), u AS (SELECT unnest(t.rules) AS tag, t.success, k.inversion, k.pressure FROM t JOIN k USING (case_id))
SELECT tag, count(*) AS cases, round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS success_rate, count(*) FILTER (inversion) AS inversions, round(avg(pressure), 6) AS pressure FROM u GROUP BY 1""", "attempts")
def signal_breakdown(spark, sf):
    a = VIEWS["attempts"](spark, sf)
    t = a.where("rank <= 5").groupBy("case_id").agg(F.collect_set("rule").alias("rules"), F.bool_or("success").alias("success"))
    b = E.breakdown(t.join(E.competition(a, "case_id").drop("rules"), "case_id"), "rules")
    return b.withColumn("success_rate", rounded("success_rate")).withColumn("pressure", rounded("pressure"))


@query(""", u AS (SELECT confidence, hit, 'grp' AS dimension, grp AS value FROM conf UNION ALL SELECT confidence, hit, 'kind', kind FROM conf), b AS (SELECT *, least(9, CAST(floor(confidence * 10) AS INTEGER)) AS bin FROM u),
p AS (SELECT dimension, value, bin, count(*) AS n, sum(confidence) AS c, sum(CASE WHEN hit THEN 1.0 ELSE 0 END) AS h FROM b GROUP BY 1, 2, 3), s AS (SELECT dimension, value, CAST(sum(n) AS BIGINT) AS count, sum(abs(c - h)) / sum(n) AS ece FROM p GROUP BY 1, 2),
w AS (SELECT dimension, max(ROW(round(ece, 9), count, value)) AS w FROM s GROUP BY 1) SELECT dimension, w[3] AS value, round(w[1], 6) AS ece, w[2] AS count FROM w""", "conf")
def worst_stratum(spark, sf):
    s = K.strata(VIEWS["conf"](spark, sf), ["grp", "kind"])
    return E.worst_stratum(s, "dimension").withColumn("ece", rounded("ece"))


