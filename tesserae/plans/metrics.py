"""Ranking and search metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import count_if, mean_or_zero, rounded, share
from ..operators import metrics as M
from ..tables import VIEWS
from .base import query

_CASES = """, c AS (SELECT case_id, grp, CAST(sum(CASE WHEN relevant THEN 1 ELSE 0 END) AS BIGINT) AS n_truth, min(CASE WHEN relevant THEN rank END) AS first,
  count(*) AS n FROM ranked GROUP BY 1, 2),
h AS (SELECT *, sum(CASE WHEN relevant THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY rank) AS hits FROM ranked),
s AS (SELECT case_id, sum(CASE WHEN relevant THEN hits / rank ELSE 0 END) AS precisions,
  sum(CASE WHEN relevant AND rank <= 3 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM h GROUP BY 1),
m AS (SELECT c.case_id, c.grp, c.n_truth, c.first, coalesce(1.0 / c.first, 0) AS reciprocal, coalesce(precisions / nullif(n_truth, 0), 0) AS ap,
  coalesce(dcg / nullif(CASE WHEN n_truth >= 1 THEN 1.0 ELSE 0 END + CASE WHEN n_truth >= 2 THEN 1 / log2(3.0) ELSE 0 END
    + CASE WHEN n_truth >= 3 THEN 1 / log2(4.0) ELSE 0 END, 0), 0) AS ndcg, coalesce((first - 1) / n, 1.0) AS exam FROM c JOIN s USING (case_id))"""


def cases(spark, sf, k=3):
    r = VIEWS["ranked"](spark, sf)
    sizes = r.groupBy("case_id", "grp").agg(count_if("relevant").alias("n_truth"))
    return M.per_case(r, sizes, k)


@query(_CASES + " SELECT grp, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS top3, "
       "round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS top5 FROM m GROUP BY grp", "ranked")
def topk_accuracy(spark, sf):
    return cases(spark, sf).groupBy("grp").agg(*[rounded(F.avg(M.within(k))).alias(f"top{k}") for k in (1, 3, 5)])


def _mean(column, alias):
    @query(_CASES + f" SELECT grp, round(avg({column}), 6) AS {alias} FROM m GROUP BY grp", "ranked", name=alias)
    def q(spark, sf):
        return cases(spark, sf).groupBy("grp").agg(rounded(mean_or_zero(column)).alias(alias))


for _column, _alias in (("reciprocal", "mrr"), ("ap", "map"), ("ndcg", "ndcg"), ("exam", "exam")):
    _mean(_column, _alias)


@query(" SELECT grp, round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(score), 6) AS mean_score FROM attempts GROUP BY grp", "attempts")
def success_rate(spark, sf):
    return VIEWS["attempts"](spark, sf).groupBy("grp").agg(
        rounded(mean_or_zero(F.col("success").cast("int"))).alias("success_rate"), rounded(mean_or_zero("score")).alias("mean_score"))


_SETS = """, e AS (SELECT case_id, list_sort(list(DISTINCT rule) FILTER (success)) AS expected, list_sort(list(DISTINCT rule) FILTER (rank <= 5)) AS detected
  FROM attempts GROUP BY 1), p AS (SELECT case_id, coalesce(expected, []) AS expected, coalesce(detected, []) AS detected FROM e)"""


@query(_SETS + """ SELECT case_id, round(coalesce(len(list_intersect(expected, detected)) / nullif(len(expected), 0), 0), 6) AS recall,
round(coalesce(len(list_intersect(expected, detected)) / nullif(len(detected), 0), 0), 6) AS precision,
array_to_string(list_sort(list_filter(detected, lambda x: NOT list_contains(expected, x))), ',') AS extra FROM p""", "attempts")
def rule_pr(spark, sf):
    sets = VIEWS["attempts"](spark, sf).groupBy("case_id").agg(
        F.collect_set(F.when(F.col("success"), F.col("rule"))).alias("expected"), F.collect_set(F.when(F.col("rank") <= 5, F.col("rule"))).alias("detected"))
    recall, precision, extra = M.rule_overlap("expected", "detected")
    return sets.select("case_id", recall, precision, extra).select(
        "case_id", rounded("recall").alias("recall"), rounded("precision").alias("precision"), F.array_join(F.col("extra").cast("array<string>"), ",").alias("extra"))


ANALYSIS_SQL = """, a AS (SELECT *, CAST((rank - 1) // 10 AS INTEGER) AS depth FROM attempts),
g AS (SELECT case_id, grp, count(*) AS evaluated, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS successful, max(depth) AS max_depth,
  min(CASE WHEN success THEN rank END) AS fr, min_by(depth, rank) FILTER (success) AS fd, min_by(score, rank) FILTER (success) AS fs,
  max(CASE WHEN NOT success THEN score END) AS bf FROM a GROUP BY 1, 2),
n AS (SELECT case_id, grp, evaluated, successful, max_depth, fr AS first_success_rank, fd AS first_success_depth, CAST(coalesce(fr - 1, evaluated) AS BIGINT) AS failures_before,
  fs - coalesce(bf, 0) AS margin, CASE WHEN fr IS NULL THEN 0.0 ELSE 1.0 / (1 + coalesce(fr - 1, evaluated) + fd) END AS efficiency FROM g)"""


def with_depth(spark, sf):
    return VIEWS["attempts"](spark, sf).withColumn("depth", F.floor((F.col("rank") - 1) / 10).cast("int"))


def analysis(spark, sf):
    return M.search_analysis(with_depth(spark, sf), "case_id", "grp")


@query(ANALYSIS_SQL + """ SELECT case_id, grp, evaluated, successful, max_depth, CAST(first_success_rank AS INTEGER) AS first_success_rank, first_success_depth, failures_before,
round(margin, 6) AS margin, round(efficiency, 6) AS efficiency FROM n""", "attempts")
def search_analysis(spark, sf):
    return analysis(spark, sf).withColumn("margin", rounded("margin")).withColumn("efficiency", rounded("efficiency"))


@query(ANALYSIS_SQL + """ SELECT grp, count(*) AS cases, round(avg(CASE WHEN successful > 0 THEN 1.0 ELSE 0 END), 6) AS search_success,
round(avg(CASE WHEN first_success_rank = 1 THEN 1.0 ELSE 0 END), 6) AS top1_success, round(avg(coalesce(1.0 / first_success_rank, 0)), 6) AS search_mrr,
round(avg(first_success_rank), 6) AS mean_first_rank, round(coalesce(sum(CASE WHEN max_depth > 1 AND successful > 0 THEN 1 ELSE 0 END)
/ nullif(sum(CASE WHEN max_depth > 1 THEN 1 ELSE 0 END), 0), 0), 6) AS reflection_success FROM n GROUP BY grp""", "attempts")
def search_rates(spark, sf):
    r = M.search_rates(analysis(spark, sf), "grp")
    return r.select("grp", "cases", *[rounded(c).alias(c) for c in r.columns[2:]])


@query(""", c AS (SELECT o_custkey, count(*) AS candidates, sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS evaluated FROM orders GROUP BY 1),
k AS (SELECT CASE WHEN candidates IS NULL THEN 'no_candidate' WHEN evaluated = 0 THEN 'not_evaluated' END AS failure_type
  FROM customer LEFT JOIN c ON c_custkey = o_custkey)
SELECT failure_type, count(*) AS n FROM (SELECT CASE WHEN failure_type = 'view' THEN 'unknown_failure' ELSE failure_type END AS failure_type FROM attempts
  UNION ALL SELECT failure_type FROM k WHERE failure_type IS NOT NULL) GROUP BY 1""", "attempts")
def failure_taxonomy(spark, sf):
    from ..tables import table

    blank = F.when(F.col("failure_type") == "view", " ").otherwise(F.col("failure_type"))
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("candidates"), count_if(F.col("o_orderstatus") != "P").alias("evaluated"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")).join(orders, "o_custkey", "left")
    return M.failure_taxonomy(VIEWS["attempts"](spark, sf).withColumn("failure_type", blank), customers)


_BLOCK = """round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS top3,
round(avg(reciprocal), 6) AS mrr, round(avg(ap), 6) AS map, round(avg(ndcg), 6) AS ndcg, round(avg(exam), 6) AS exam"""


def rounded_summary(df, keys):
    return df.select(*keys, "cases", *[rounded(c).alias(c) for c in df.columns if c not in (*keys, "cases")])


@query(_CASES + f", k AS (SELECT case_id, kind FROM ranked WHERE rank = 1) SELECT kind, count(*) AS cases, {_BLOCK} FROM m JOIN k USING (case_id) GROUP BY kind", "ranked")
def metrics_by_type(spark, sf):
    kinds = VIEWS["ranked"](spark, sf).where("rank = 1").select("case_id", "kind")
    return rounded_summary(M.summary(cases(spark, sf).join(kinds, "case_id"), "kind"), ["kind"])


@query(_CASES + f""", r AS (SELECT DISTINCT case_id, 'rule_' || rule AS rule FROM attempts WHERE success),
j AS (SELECT m.*, coalesce(r.rule, 'no_expected_rule') AS rule FROM m LEFT JOIN r ON m.case_id = r.case_id)
SELECT rule, count(*) AS cases, {_BLOCK} FROM j GROUP BY rule""", "ranked", "attempts")
def metrics_by_rule(spark, sf):
    rules = VIEWS["attempts"](spark, sf).where("success").select("case_id", F.concat(F.lit("rule_"), "rule").alias("rule")).distinct()
    rows = cases(spark, sf).join(rules, "case_id", "left").withColumn("rule", F.coalesce("rule", F.lit("no_expected_rule")))
    return rounded_summary(M.summary(rows, "rule"), ["rule"])


@query("""SELECT l_orderkey AS bundle, count(*) AS members, sum(l_quantity) AS size, CAST(sum(l_linenumber) AS BIGINT) AS callers, max(l_discount) AS max_risk,
round(avg(l_discount), 6) AS mean_risk FROM lineitem GROUP BY 1""")
def bundle_risk(spark, sf):
    from ..tables import table

    members = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("bundle"), F.col("l_quantity").alias("size"), F.col("l_linenumber").alias("callers"), F.col("l_discount").alias("risk"))
    return M.bundle_risk(members, "bundle").withColumn("mean_risk", rounded("mean_risk"))


@query(ANALYSIS_SQL + " SELECT grp, " + ", ".join(
    f"round(coalesce(avg(CASE WHEN first_success_rank <= {k} THEN 1.0 ELSE 0 END) FILTER (first_success_rank IS NOT NULL), 0), 6) AS success_at_{k}" for k in (1, 3, 5)) +
    " FROM n GROUP BY grp", "attempts")
def success_at_k(spark, sf):
    return analysis(spark, sf).groupBy("grp").agg(*[rounded(M.success_at(k)).alias(f"success_at_{k}") for k in (1, 3, 5)])
