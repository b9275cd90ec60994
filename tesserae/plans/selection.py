"""Selection queries over users' attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import selection as D
from ..tables import VIEWS, table, with_views
from .base import query
from .scoring import RULES, rule_name


def attempts(spark, sf):
    a = VIEWS["attempts"](spark, sf)
    return a.withColumns({
        "function": F.col("id") % 10, "prior": F.col("score"), "base_rank": F.col("rank"), "risk_bucket": F.col("k") % 3, "bucket": F.col("k") % 3,
        "rules": F.array("rule", F.col("k") % 5), "kind": F.col("failure_type"), "source": F.col("id") % 6, "folder": F.col("id") % 8, "upstream": F.col("id") % 9})


_ATTEMPTS = """, a AS MATERIALIZED (SELECT case_id, id, score, score AS prior, rank AS base_rank, id % 10 AS function, rule, variant, k % 3 AS risk_bucket, k % 3 AS bucket, [rule::BIGINT, (k % 5)::BIGINT] AS rules,
  failure_type, failure_type AS kind, id % 6 AS source, id % 8 AS folder, id % 9 AS upstream, grp, success FROM attempts)"""


def _greedy(kinds: dict[str, str], bonus: str, order: str, out: str, steps: int = 1 << 20) -> str:
    """SQL of a greedy choice: a row of the recursion for each row taken, with what each case has seen."""
    seen = ", ".join(f"s_{k}" for k in kinds)
    add = ", ".join(v.format(f"list_append(s_{k}, t.{k})", f"list_concat(s_{k}, t.{k})") for k, v in kinds.items())
    start = ", ".join(f"[]::{'VARCHAR' if k == 'kind' else 'BIGINT'}[] AS s_{k}" for k in kinds)
    return with_views(f"""{_ATTEMPTS}, w AS (SELECT case_id, 0 AS place, NULL::BIGINT AS id, NULL::DOUBLE AS prior, NULL::BIGINT AS base_rank, NULL::DOUBLE AS gain, []::BIGINT[] AS taken, {start} FROM (SELECT DISTINCT case_id FROM a)
  UNION ALL SELECT t.case_id, place + 1, t.id, t.prior, t.base_rank, gain, list_append(taken, t.id), {add} FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS nth FROM (
      SELECT a.*, w.place, w.taken, {seen}, CAST({bonus} AS DOUBLE) AS gain FROM w JOIN a USING (case_id) WHERE w.place < {steps} AND NOT list_contains(w.taken, a.id))) t WHERE nth = 1)
SELECT case_id, id, {out} FROM w WHERE place > 0""", "attempts").replace("WITH ", "WITH RECURSIVE ", 1)


def _new(kind: str, worth: float) -> str:
    return f"CASE WHEN list_contains(s_{kind}, a.{kind}) THEN 0::DOUBLE ELSE {worth}::DOUBLE END"


@query(_greedy({k: "{0}" for k in ("function", "rule", "variant", "risk_bucket")}, f"{_new('function', 0.35)} + {_new('rule', 0.35)} + {_new('variant', 0.20)} + {_new('risk_bucket', 0.10)}",
               "prior + 0.06::DOUBLE * gain DESC, prior DESC, base_rank", "prior, base_rank, round(gain, 6) AS bonus, place AS rank"))
def diversity_rerank(spark, sf):
    return D.diversity_rerank(attempts(spark, sf)).withColumn("bonus", rounded("bonus"))


@query(_greedy({"rules": "{1}", "kind": "{0}", "source": "{0}"}, f"100 * len(list_filter(list_distinct(a.rules), lambda x: NOT list_contains(s_rules, x))) + {_new('kind', 30)} + {_new('source', 10)}",
               "gain DESC, id", "CAST(gain AS BIGINT) AS gain, place", 6))
def gain_subset(spark, sf):
    return D.gain_subset(attempts(spark, sf), 6)


@query(_greedy({"grp": "{0}", "folder": "{0}"}, f"{_new('grp', 1)} + {_new('folder', 1)}", "prior DESC, gain DESC, id", "prior AS score, place", 6))
def score_diverse_subset(spark, sf):
    return D.score_diverse_subset(attempts(spark, sf), 6)


@query(""", t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY case_id, rule ORDER BY score DESC, id) = 1 THEN 0 ELSE 1 END AS tier FROM attempts)
SELECT case_id, id, tier, CAST(row_number() OVER (PARTITION BY case_id ORDER BY tier, score DESC, id) AS INTEGER) AS place FROM t QUALIFY place <= 8""", "attempts")
def first_per_key_fill(spark, sf):
    return D.first_per_key_fill(attempts(spark, sf), "case_id", "rule", "score", "id", 8).select("case_id", "id", "tier", "place")


@query(_ATTEMPTS + """, t AS (SELECT *, CASE WHEN success THEN 0 WHEN bool_or(success) OVER q OR row_number() OVER (PARTITION BY case_id, function, rule, failure_type, bucket ORDER BY score DESC, id) > 1 THEN 3
  WHEN failure_type IN ('patch_apply_error', 'syntax_error', 'import_error', 'safety_gate_blocked', 'timeout') THEN 2 ELSE 1 END AS tier FROM a WINDOW q AS (PARTITION BY case_id, function, rule, failure_type, bucket))
SELECT case_id, id, tier, CAST(row_number() OVER (PARTITION BY case_id ORDER BY tier, score DESC, id) AS INTEGER) AS place FROM t QUALIFY place <= 8""", "attempts")
def tiered_retention(spark, sf):
    return D.tiered_retention(attempts(spark, sf), 8)


@query(_greedy({k: "{0}" for k in ("rule", "kind", "upstream", "function", "source")},
               f"CASE WHEN place = 0 THEN 0 ELSE least(8::DOUBLE, {_new('rule', 3.0)} + {_new('kind', 2.0)} + {_new('upstream', 2.0)} + {_new('function', 1.5)} + {_new('source', 1.0)}) END",
               "prior + gain DESC, prior DESC, id", "gain AS bonus, place AS rank"))
def feature_rerank(spark, sf):
    return D.feature_rerank(attempts(spark, sf))


@query("""WITH s AS (SELECT DISTINCT o_orderkey AS seed, unnest([ROW('failure_type', o_custkey % 50), ROW('focus', o_orderkey % 40), ROW('rule', o_custkey % 30)]) AS t FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT DISTINCT p_partkey AS candidate, unnest([ROW('failure_type', p_size), ROW('focus', p_partkey % 60), ROW('rule', p_partkey % 45)]) AS t, p_size / 100.0 AS bonus FROM part WHERE p_type = 'ECONOMY'),
m AS (SELECT seed, candidate, sum(CASE s.t[1] WHEN 'failure_type' THEN 4.0 WHEN 'focus' THEN 3.0 ELSE 1.0 END) + max(bonus) AS score FROM s JOIN c ON s.t = c.t GROUP BY 1, 2),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, candidate) = 1)
SELECT x.seed, b.candidate, round(coalesce(b.score, 0), 6) AS score, CASE WHEN b.candidate IS NULL THEN 'unmatched' ELSE 'realized' END AS status
FROM (SELECT DISTINCT seed FROM s) x LEFT JOIN b ON x.seed = b.seed""")
def best_match(spark, sf):
    tag = lambda n, v: F.struct(F.lit(n).alias("tag"), v.cast("long").alias("value"))
    seeds = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("seed"), F.explode(F.array(tag("failure_type", F.col("o_custkey") % 50), tag("focus", F.col("o_orderkey") % 40), tag("rule", F.col("o_custkey") % 30))).alias("t"))
    catalogue = table(spark, sf, "part").where("p_type = 'ECONOMY'").select(
        F.col("p_partkey").alias("candidate"), (F.col("p_size") / 100.0).alias("bonus"),
        F.explode(F.array(tag("failure_type", F.col("p_size")), tag("focus", F.col("p_partkey") % 60), tag("rule", F.col("p_partkey") % 45))).alias("t"))
    m = D.best_match(seeds.select("seed", "t.*"), catalogue.select("candidate", "t.*", "bonus"))
    return m.withColumn("score", rounded("score"))


_BUGS = ["api misuse", "boundary", "Zero Division", "missing key", "exception swallowing", "type confusion", "logic"]
_BUGS_SQL = "[" + ", ".join(f"'{b}'" for b in _BUGS) + "]"
_RULES_SQL = "[" + ", ".join(f"'{r}'" for r in RULES) + "]"


def _words(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_PARTS = [_words(D.ALWAYS)] + [f"CASE WHEN list_contains(rules, '{r}') THEN {_words(t)} ELSE [] END" for r, t in D.RULE_FAILURES.items()] + [
    f"CASE WHEN contains(bug, '{w}') THEN {_words(t)} ELSE [] END" for w, t in D.TYPE_FAILURES.items()]


@query(f"""WITH p AS (SELECT p_partkey AS id, [{_RULES_SQL}[p_partkey % 12 + 1], {_RULES_SQL}[p_size % 12 + 1]] AS rules, lower({_BUGS_SQL}[p_partkey % 7 + 1]) AS bug FROM part)
SELECT id, array_to_string(list_sort(list_distinct(flatten([{', '.join(_PARTS)}]))), ',') AS failures FROM p""")
def tag_infer(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.array(rule_name("p_partkey"), rule_name("p_size")).alias("rules"), F.get(F.array(*map(F.lit, _BUGS)), (F.col("p_partkey") % 7).cast("int")).alias("bug_type"))
    return D.infer_failures(p).select("id", F.array_join("failures", ",").alias("failures"))


_BATCHES = _ATTEMPTS + """, b AS MATERIALIZED (SELECT case_id, id, function, row_number() OVER (PARTITION BY case_id ORDER BY id) AS n FROM a WHERE rule IN (0, 2, 4, 6)),
w AS (SELECT case_id, 0::BIGINT AS n, NULL::BIGINT AS id, false AS added, 0 AS batch, 0 AS full_, []::BIGINT[] AS open_ FROM (SELECT DISTINCT case_id FROM b)
  UNION ALL SELECT case_id, n, id, added, full_ + 1, full_ + CASE WHEN len(now) = 3 THEN 1 ELSE 0 END, CASE WHEN len(now) = 3 THEN [] ELSE now END FROM (
    SELECT w.case_id, b.n, b.id, w.full_, NOT list_contains(open_, b.function) AS added, CASE WHEN list_contains(open_, b.function) THEN open_ ELSE list_append(open_, b.function) END AS now
    FROM w JOIN b ON b.case_id = w.case_id AND b.n = w.n + 1))
SELECT case_id, batch, id FROM w WHERE added QUALIFY count(*) OVER (PARTITION BY case_id, batch) = 3"""


@query(with_views(_BATCHES, "attempts").replace("WITH ", "WITH RECURSIVE ", 1))
def distinct_batches(spark, sf):
    return D.distinct_batches(attempts(spark, sf), 3, [0, 2, 4, 6])


@query(""", c AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS n FROM attempts) WHERE n <= 5)
SELECT grp, rule, count(*) FILTER (id IN (SELECT id FROM c)) AS selected, count(*) FILTER (id NOT IN (SELECT id FROM c)) AS omitted,
round(avg(CASE WHEN id IN (SELECT id FROM c) THEN 1.0 ELSE 0 END), 6) AS coverage FROM attempts GROUP BY 1, 2""", "attempts")
def selection_audit(spark, sf):
    from ..operators.scoring import rank_within

    a = VIEWS["attempts"](spark, sf).drop("rank")
    chosen = rank_within(a, ["case_id"], "score", ["id"], 5)
    return D.selection_audit(a, chosen, "id", "grp", "rule").withColumn("coverage", rounded("coverage"))
