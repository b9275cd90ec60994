"""Calibration, uncertainty and attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import count_if, rounded
from ..operators import calibration as K
from ..operators.scoring import COVERAGE_WEIGHTS
from ..tables import VIEWS, table
from .base import query

_BIN = "least(9, CAST(floor(confidence * 10) AS INTEGER)) AS bin"
_HIT = "CASE WHEN hit THEN 1.0 ELSE 0 END"


@query(f", b AS (SELECT *, {_BIN} FROM conf) SELECT bin, count(*) AS count, round(avg(confidence), 6) AS mean_confidence, round(avg({_HIT}), 6) AS accuracy, "
       f"round(abs(avg(confidence) - avg({_HIT})), 6) AS gap FROM b GROUP BY bin", "conf")
def calib_bins(spark, sf):
    r = K.reliability(VIEWS["conf"](spark, sf))
    return r.select("bin", "count", *[rounded(c).alias(c) for c in ("mean_confidence", "accuracy", "gap")])


def _summary_sql(keys: str, source: str = "conf") -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f""", b AS (SELECT *, {_BIN} FROM {source}), p AS (SELECT {lead}bin, count(*) AS n, sum(confidence) AS c, sum({_HIT}) AS h,
sum((confidence - {_HIT}) ** 2) AS s, sum(abs(confidence - {_HIT})) AS a FROM b GROUP BY {lead}bin)
SELECT {lead}CAST(sum(n) AS BIGINT) AS count, round(sum(abs(c - h)) / sum(n), 6) AS ece, round(max(abs(c - h) / n), 6) AS mce,
round(sum(s) / sum(n), 6) AS brier, round(sum(a) / sum(n), 6) AS mae FROM p {group}"""


def _four(df, *keys):
    return df.select(*keys, "count", *[rounded(c).alias(c) for c in ("ece", "mce", "brier", "mae")])


@query(_summary_sql(""), "conf")
def calib_summary(spark, sf):
    return _four(K.calibration(VIEWS["conf"](spark, sf)))


@query(" SELECT CASE WHEN hit AND confidence < 0.5 THEN 'underconfident' WHEN NOT hit AND confidence >= 0.5 THEN 'overconfident' ELSE 'aligned' END AS agreement, "
       "count(*) AS n FROM conf GROUP BY 1", "conf")
def calib_agreement(spark, sf):
    return VIEWS["conf"](spark, sf).groupBy(K.agreement().alias("agreement")).agg(F.count("*").alias("n"))


@query(f""", b AS (SELECT *, {_BIN}, {_HIT} AS y FROM conf), s AS (SELECT bin, count(*) AS n, sum(y) AS pos FROM b GROUP BY 1),
p AS (SELECT greatest(0.05, least(0.95, avg(y))) AS p0 FROM b)
SELECT id, b.bin, round((pos - y + 10 * p0) / (n - 1 + 10), 6) AS calibrated FROM b JOIN s ON b.bin = s.bin, p""", "conf")
def calib_loo(spark, sf):
    return K.leave_one_out(VIEWS["conf"](spark, sf)).select("id", "bin", rounded("calibrated").alias("calibrated"))


@query(f""", b AS (SELECT *, {_BIN}, {_HIT} AS y FROM conf), o AS (SELECT grp, bin, count(*) AS n, sum(y) AS pos FROM b GROUP BY 1, 2),
t AS (SELECT o.*, sum(n) OVER (PARTITION BY bin) AS nb, sum(pos) OVER (PARTITION BY bin) AS pb, sum(n) OVER (PARTITION BY grp) AS ng,
  sum(pos) OVER (PARTITION BY grp) AS pg, sum(n) OVER () AS na, sum(pos) OVER () AS pa FROM o),
q AS (SELECT *, (pb - pos + 10 * greatest(0.05, least(0.95, coalesce((pa - pg) / nullif(na - ng, 0), 0)))) / (nb - n + 10) AS p FROM t WHERE na <> ng)
SELECT grp, CAST(sum(n) AS BIGINT) AS count, round(sum(abs(n * p - pos)) / sum(n), 6) AS ece, round(sum(pos * (1 - p) ** 2 + (n - pos) * p ** 2) / sum(n), 6) AS brier
FROM q GROUP BY grp""", "conf")
def calib_holdout(spark, sf):
    r = K.group_holdout(VIEWS["conf"](spark, sf), "grp")
    return r.select("grp", "count", rounded("ece").alias("ece"), rounded("brier").alias("brier"))


@query(""", u AS (SELECT confidence, hit, 'grp' AS dimension, grp AS value FROM conf UNION ALL SELECT confidence, hit, 'kind', kind FROM conf)"""
       + _summary_sql("dimension, value", "u"), "conf")
def calib_strata(spark, sf):
    return _four(K.strata(VIEWS["conf"](spark, sf), ["grp", "kind"]), "dimension", "value")


_JUDGE = """, j AS (SELECT case_id, rank, success, score, k / 99.0 AS ratio, CASE WHEN success THEN 1.0
  ELSE 0.45 * (k / 99.0) + 0.35 * score + 0.20 * (1 - variant / 5.0) END AS evidence, rule, variant, failure_type FROM attempts),
w AS (SELECT *, CASE WHEN abs(score - evidence) <= 0.25 THEN 'aligned' WHEN score > evidence THEN 'optimistic' ELSE 'conservative' END AS agreement FROM j)"""


def judged(spark, sf):
    ratio, risk = F.col("k") / 99.0, F.col("variant") / 5.0
    evidence = F.when(F.col("success"), 1.0).otherwise(0.45 * ratio + 0.35 * F.col("score") + 0.20 * (1 - risk))
    a = VIEWS["attempts"](spark, sf).withColumn("evidence", evidence)
    return a.withColumn("agreement", K.within_tolerance("score", F.col("evidence")))


@query(""", g AS (SELECT case_id, avg(score) AS confidence, bool_or(success) AS hit, avg(k / 99.0) AS recall, max(CASE WHEN success THEN 1.0 ELSE 0 END) AS repair,
  max(CASE WHEN rank = 1 AND success THEN 1.0 ELSE 0 END) AS loc FROM attempts GROUP BY 1),
e AS (SELECT *, 0.35 * loc + 0.20 * recall + 0.35 * repair + 0.10 * 1.0 AS evidence FROM g)
SELECT CASE WHEN abs(confidence - evidence) <= 0.25 THEN 'aligned' WHEN confidence > evidence THEN 'optimistic' ELSE 'conservative' END AS agreement,
count(*) AS cases, round(avg(confidence), 6) AS mean_confidence, round(avg(evidence), 6) AS mean_evidence FROM e GROUP BY 1""", "attempts")
def judge_case(spark, sf):
    ok = F.col("success").cast("double")
    g = VIEWS["attempts"](spark, sf).groupBy("case_id").agg(
        F.avg("score").alias("confidence"), F.avg(F.col("k") / 99.0).alias("recall"), F.max(ok).alias("repair"),
        F.max(F.when(F.col("rank") == 1, ok).otherwise(0.0)).alias("loc"))
    g = g.withColumn("evidence", 0.35 * F.col("loc") + 0.20 * F.col("recall") + 0.35 * F.col("repair") + 0.10)
    return g.groupBy(K.within_tolerance("confidence", F.col("evidence")).alias("agreement")).agg(
        F.count("*").alias("cases"), rounded(F.avg("confidence")).alias("mean_confidence"), rounded(F.avg("evidence")).alias("mean_evidence"))


@query(_JUDGE + """ SELECT failure_type, agreement, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(evidence), 6) AS mean_evidence,
round(avg((score - evidence) ** 2), 6) AS brier FROM w GROUP BY 1, 2""", "attempts")
def judge_candidate(spark, sf):
    return judged(spark, sf).groupBy("failure_type", "agreement").agg(
        F.count("*").alias("n"), rounded(F.avg("score")).alias("mean_score"), rounded(F.avg("evidence")).alias("mean_evidence"),
        rounded(F.avg(F.pow(F.col("score") - F.col("evidence"), 2))).alias("brier"))


@query(""", v AS (SELECT grp, success, CASE rule WHEN 0 THEN 'prefer' WHEN 1 THEN ' Accept' WHEN 2 THEN 'PASS' WHEN 3 THEN 'reject' WHEN 4 THEN 'fail' WHEN 5 THEN 'maybe' END AS verdict FROM attempts),
w AS (SELECT grp, success, lower(trim(coalesce(verdict, 'unknown'))) IN ('prefer', 'accept', 'pass') AS y, lower(trim(coalesce(verdict, 'unknown'))) IN ('reject', 'fail') AS n FROM v)
SELECT grp, count(*) FILTER (y AND success) AS accept_success, count(*) FILTER (y AND NOT success) AS accept_failure, count(*) FILTER (n AND success) AS reject_success,
count(*) FILTER (n AND NOT success) AS reject_failure, count(*) FILTER (NOT y AND NOT n) AS unknown_verdict,
count(*) FILTER ((y AND success) OR (n AND NOT success)) AS aligned, count(*) FILTER ((y AND NOT success) OR (n AND success)) AS mismatch FROM w GROUP BY grp""", "attempts")
def judge_confusion(spark, sf):
    names = F.array(*map(F.lit, ("prefer", " Accept", "PASS", "reject", "fail", "maybe")))
    return K.verdict_outcomes(VIEWS["attempts"](spark, sf).withColumn("verdict", F.get(names, F.col("rule"))), "grp")


@query(""", c AS (SELECT id, grp, confidence, CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END AS accuracy FROM conf), b AS (SELECT *, unnest(range(1, 1001)) AS b FROM c),
m AS (SELECT *, (id * 48271 + b * 69621 + 17) % 2147483647 AS m1 FROM b), n AS (SELECT *, (m1 * m1 + b) % 2147483647 AS m2 FROM m), o AS (SELECT *, ((m2 * m2 + id) % 2147483647) / 2147483647.0::DOUBLE AS draw FROM n),
w AS (SELECT *, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]::DOUBLE[], lambda p: draw >= p)) AS w FROM o),
s AS (SELECT grp, b, sum(w)::DOUBLE AS n, sum(w * confidence) AS c, sum(w * accuracy) AS a FROM w GROUP BY 1, 2 HAVING sum(w) > 0),
u AS (SELECT grp, 'confidence' AS metric, c / n AS x FROM s UNION ALL SELECT grp, 'accuracy', a / n FROM s), r AS (SELECT grp, 'confidence' AS metric, avg(confidence) AS mean FROM c GROUP BY 1 UNION ALL SELECT grp, 'accuracy', avg(accuracy) FROM c GROUP BY 1)
SELECT grp, metric, round(max(mean) + 1e-9, 6) AS mean, round(quantile_cont(x, 0.025) + 1e-9, 6) AS low, round(quantile_cont(x, 0.975) + 1e-9, 6) AS high FROM u JOIN r USING (grp, metric) GROUP BY 1, 2""", "conf")
def bootstrap_ci(spark, sf):
    """Intervals of the mean confidence and accuracy in each group."""
    rows = VIEWS["conf"](spark, sf).select("id", "grp", "confidence", F.col("hit").cast("double").alias("accuracy"))
    found = K.bootstrap(rows, ["confidence", "accuracy"], ["grp"], samples=1000)
    return found.select("grp", "metric", *[rounded(F.col(c) + 1e-9).alias(c) for c in ("mean", "low", "high")])


WEIGHTS = COVERAGE_WEIGHTS
SIGNALS_SQL = """, f AS (SELECT case_id, item, score, (item * 7919 % 101) / 100.0 AS sbfl, (item * 104729 % 103) / 102.0 AS graph, (item * 1299709 % 107) / 106.0 AS static,
  (item * 15485863 % 109) / 108.0 AS semantic, (item * 32452843 % 113) / 112.0 AS llm, (item * 49979687 % 127) / 126.0 AS risk, relevant, grp FROM ranked),
x AS (SELECT *, greatest(0.0, least(1.0, 0.30 * sbfl + 0.25 * graph + 0.15 * static + 0.10 * semantic + 0.15 * llm + -0.05 * risk)) AS fused FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY fused DESC, item) AS rank FROM x)"""
_PRIMES = {"sbfl": (7919, 101), "graph": (104729, 103), "static": (1299709, 107), "semantic": (15485863, 109), "llm": (32452843, 113), "risk": (49979687, 127)}


def signals(spark, sf):
    """Ranked items with six signals (from the item id) and their fused score."""
    from ..operators.scoring import fuse, rank_within

    r = VIEWS["ranked"](spark, sf).drop("rank", "score")
    r = r.select("*", *[(F.col("item") * p % m / float(m - 1)).alias(c) for c, (p, m) in _PRIMES.items()])
    return rank_within(r.withColumn("score", fuse(WEIGHTS)), ["case_id"], "score", ["item"])


_PARTS = SIGNALS_SQL + """, u AS (""" + " UNION ALL ".join(
    f"SELECT case_id, item, rank, fused, '{c}' AS component, {w} * {c} AS contribution FROM r" for c, w in WEIGHTS.items()) + ")"


@query(_PARTS + """ SELECT component, round(sum(contribution), 4) AS total, round(avg(contribution), 6) AS mean, count(*) FILTER (contribution > 0) AS positive FROM u GROUP BY 1""", "ranked")
def contributions(spark, sf):
    parts = K.contributions(signals(spark, sf), ["case_id", "item"], WEIGHTS)
    return parts.groupBy("component").agg(
        F.round(F.sum("contribution"), 4).alias("total"), rounded(F.avg("contribution")).alias("mean"), count_if(F.col("contribution") > 0).alias("positive"))


@query(SIGNALS_SQL + """, m AS (SELECT case_id, max(CASE WHEN rank = 1 THEN fused END) AS top1, max(CASE WHEN rank = 2 THEN fused END) AS runner_up FROM r GROUP BY 1)
SELECT case_id, round(top1, 6) AS top1, round(runner_up, 6) AS runner_up, round(top1 - coalesce(runner_up, 0), 6) AS margin, top1 - coalesce(runner_up, 0) <= 0.02 AS fragile FROM m""", "ranked")
def margin_fragile(spark, sf):
    m = K.margins(signals(spark, sf), "case_id")
    return m.select("case_id", *[rounded(c).alias(c) for c in ("top1", "runner_up", "margin")], "fragile")


@query(_PARTS + """, l AS (SELECT case_id, component, rank, greatest(0.0, least(1.0, fused - contribution)) AS left_over FROM u),
m AS (SELECT case_id, component, max(CASE WHEN rank = 1 THEN left_over END) AS top, max(CASE WHEN rank > 1 THEN left_over END) AS other FROM l GROUP BY 1, 2)
SELECT component, count(*) AS cases, count(*) FILTER (other > top) AS flips FROM m GROUP BY 1""", "ranked")
def cf_flips(spark, sf):
    f = K.counterfactual_flips(signals(spark, sf), "case_id", WEIGHTS)
    return f.groupBy("component").agg(F.count("*").alias("cases"), count_if("flips").alias("flips"))


@query(_PARTS + """, g AS (SELECT case_id, max(ROW(contribution, component)) FILTER (component <> 'risk' AND contribution > 0) AS good,
  max(ROW(abs(contribution), component)) AS any_ FROM u WHERE rank = 1 GROUP BY 1),
c AS (SELECT coalesce(good[2], any_[2]) AS component, count(*) AS n FROM g GROUP BY 1),
t AS (SELECT sum(n) AS a, count(*) AS k FROM c), e AS (SELECT coalesce(-sum(n / a * log2(n / a)) / nullif(log2(max(k)), 0), 0) AS entropy FROM c, t)
SELECT component, n, round(entropy, 6) AS entropy FROM c, e""", "ranked")
def primary_entropy(spark, sf):
    top = K.contributions(signals(spark, sf).where("rank = 1"), ["case_id", "item"], WEIGHTS)
    counts = K.primary_component(top, "case_id").groupBy("component").agg(F.count("*").alias("n"))
    from ..functions import attach

    return attach(counts, K.entropy(counts).select(rounded("entropy").alias("entropy")), [])
