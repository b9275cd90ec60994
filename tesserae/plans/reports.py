"""Report queries: yearly suites of orders, owners, stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import count_if, rounded
from ..operators import quality as V
from ..operators import reports as R
from ..tables import VIEWS, table
from .base import query

_YEARS = """, y AS (SELECT suite, owner, count(*) AS runs, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS pass_rate, avg(CASE WHEN failed THEN 0.0 ELSE 1 END) AS clean_rate FROM suites GROUP BY 1, 2)"""


def _yearly(spark, sf, year):
    s = VIEWS["suites"](spark, sf).where(F.col("suite") == year)
    return s.groupBy("owner").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg((~F.col("failed")).cast("double")).alias("clean_rate"))


@query(_YEARS + """, a AS (SELECT * FROM y WHERE suite = 1997), b AS (SELECT * FROM y WHERE suite = 1998),
d AS (SELECT coalesce(a.owner, b.owner) AS owner, a.owner IS NULL AS added, b.owner IS NULL AS gone, coalesce(b.pass_rate - a.pass_rate, 0) AS d1, coalesce(b.clean_rate - a.clean_rate, 0) AS d2 FROM a FULL JOIN b ON a.owner = b.owner)
SELECT owner, CASE WHEN added THEN 'added' WHEN gone THEN 'missing' WHEN greatest(d1, d2) > 1e-9 AND least(d1, d2) < -1e-9 THEN 'mixed' WHEN least(d1, d2) < -1e-9 THEN 'regressed' WHEN greatest(d1, d2) > 1e-9 THEN 'improved' ELSE 'unchanged' END AS change,
round(d1, 6) AS d_pass_rate, round(d2, 6) AS d_clean_rate FROM d""", "suites")
def run_compare(spark, sf):
    """1998's runs of each owner against 1997's."""
    c = R.compare_runs(_yearly(spark, sf, 1997), _yearly(spark, sf, 1998), "owner", ["pass_rate", "clean_rate"])
    return c.select("owner", "change", rounded("d_pass_rate").alias("d_pass_rate"), rounded("d_clean_rate").alias("d_clean_rate"))


@query(""", u AS (SELECT run_id, unnest([ROW('suite', CAST(suite AS VARCHAR)), ROW('name', name), ROW('status', CASE WHEN failed THEN 'failed' WHEN passed THEN 'passed' ELSE 'pending' END), ROW('size', CASE WHEN cost > 300000 THEN 'large' ELSE 'small' END)]) AS x FROM suites)
SELECT x[1] AS dimension, x[2] AS value, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT run_id)), 1, 3), ',') AS names FROM u GROUP BY 1, 2""", "suites")
def suite_rollup(spark, sf):
    status = F.when(F.col("failed"), "failed").when(F.col("passed"), "passed").otherwise("pending")
    r = R.rollup(VIEWS["suites"](spark, sf), {"suite": F.col("suite"), "name": F.col("name"), "status": status, "size": F.when(F.col("cost") > 300000, "large").otherwise("small")}, "run_id")
    return r.withColumn("names", F.array_join(F.col("names").cast("array<string>"), ","))


@query(""", b AS (SELECT suite, CASE WHEN passed THEN 'ready' ELSE 'blocked' END AS status, CASE WHEN failed THEN 'issue_' || owner % 7 END AS issue FROM suites),
t AS (SELECT suite, issue, count(*) AS c FROM b WHERE issue IS NOT NULL GROUP BY 1, 2), m AS (SELECT suite, max(ROW(c, issue)) AS m FROM t GROUP BY 1)
SELECT b.suite, count(*) AS n, round(avg(CASE WHEN status = 'ready' THEN 1.0 ELSE 0 END), 6) AS ready, max(m.m)[2] AS top_issue FROM b LEFT JOIN m ON b.suite = m.suite GROUP BY 1""", "suites")
def batch_rollup(spark, sf):
    s = VIEWS["suites"](spark, sf).select("suite", F.when(F.col("passed"), "ready").otherwise("blocked").alias("status"), F.when(F.col("failed"), F.concat(F.lit("issue_"), F.col("owner") % 7)).alias("issue"))
    return R.batch_rollup(s, "suite", "status", "issue").withColumn("ready", rounded("ready"))


SCENARIOS = ["purchase", "click", "view", "error", "signup", "refund", "chargeback", "export", "import", "audit"]


@query(f"WITH w AS (SELECT unnest({SCENARIOS}) AS event_type), h AS (SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1) SELECT w.event_type, coalesce(n, 0) AS n, first FROM w LEFT JOIN h ON w.event_type = h.event_type")
def scenario_coverage(spark, sf):
    return R.required_coverage(table(spark, sf, "events"), "event_type", "event_id", SCENARIOS)


_KINDS = ["A", "N", "R", "X"]


@query(f"""WITH o AS (SELECT o_orderkey AS id, coalesce(list(DISTINCT l_returnflag) FILTER (l_returnflag IS NOT NULL), []) AS have FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), x AS (SELECT id, have, unnest({_KINDS}) AS artifact FROM o)
SELECT artifact, count(*) FILTER (list_contains(have, artifact)) AS present, count(*) FILTER (NOT list_contains(have, artifact)) AS missing, min(CASE WHEN NOT list_contains(have, artifact) THEN id END) AS first_gap FROM x GROUP BY 1""")
def artifact_coverage(spark, sf):
    have = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("have"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(have, "id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    return R.artifact_coverage(o, "id", "have", _KINDS)


_OUT = """o AS (SELECT o_orderkey AS id, o_orderpriority AS grp, CASE o_custkey % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'hybrid' ELSE 'rules' END AS mode, CASE o_orderkey % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'failed' ELSE 'pass' END AS status,
  o_custkey % 6 AS candidates, o_orderkey % 3 AS validated, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS reflections, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 1000 END AS runtime, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey / 100.0 END AS cost, o_custkey % 9 AS safety,
  ['safety gate hit', 'no tests found', 'missing api_key', 'ModuleNotFoundError: x', 'tox broke', 'something', 'dynamic evidence not usable'][o_orderkey % 7 + 1] AS blocker FROM orders),
c AS (SELECT *, CASE WHEN reflections > 0 THEN 'llm_reflection_success' WHEN mode IN ('llm', 'hybrid') AND status = 'pass' AND candidates > 0 AND validated > 0 THEN 'llm_direct_success' ELSE 'llm_blocker' END AS outcome FROM o)"""
_TEXTS = ["safety gate hit", "no tests found", "missing api_key", "ModuleNotFoundError: x", "tox broke", "something", "dynamic evidence not usable"]


def _outcomes(spark, sf):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf, "orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("grp"), F.when(u % 4 == 0, "llm").when(u % 4 == 1, "hybrid").otherwise("rules").alias("mode"), F.when(k % 5 == 0, "blocked").when(k % 5 == 1, "failed").otherwise("pass").alias("status"),
        (u % 6).alias("candidates"), (k % 3).alias("validated"), F.when(k % 11 == 0, 1).otherwise(0).alias("reflections"), F.when(k % 4 > 0, F.col("o_totalprice") / 1000).alias("runtime"), F.when(k % 7 > 0, u / 100.0).alias("cost"),
        (u % 9).alias("safety"), F.get(F.array(*map(F.lit, _TEXTS)), (k % 7).cast("int")).alias("blocker"))
    return o.withColumn("outcome", R.outcome_class())


@query(f"WITH {_OUT} SELECT grp, outcome, count(*) AS n FROM c GROUP BY 1, 2")
def outcome_class(spark, sf):
    return _outcomes(spark, sf).groupBy("grp", "outcome").agg(F.count("*").alias("n"))


_CATEGORY = """CASE WHEN safety > 6 AND validated <= 0 THEN 'safety_gate_blocker' WHEN contains(lower(blocker), 'safety gate') THEN 'safety_gate_blocker'
WHEN contains(lower(blocker), 'no tests') OR contains(lower(blocker), 'dynamic evidence not usable') THEN 'no_test_oracle_blocker'
WHEN status IN ('blocked', 'failed') OR contains(lower(blocker), 'api_key') THEN 'llm_failed_blocker' WHEN contains(lower(blocker), 'modulenotfounderror') OR contains(lower(blocker), 'tox') THEN 'environment_blocker' ELSE 'generic_blocker' END"""


@query(f"WITH {_OUT} SELECT id, {_CATEGORY} AS category FROM c WHERE outcome = 'llm_blocker'")
def blocker_category(spark, sf):
    o = _outcomes(spark, sf).where("outcome = 'llm_blocker'")
    return o.select("id", R.blocker_category(F.col("blocker"), F.col("safety") - 6, F.col("validated"), F.col("status")).alias("category"))


_KNOWN = ("runtime", "tokens", "cost")


@query(f"""WITH {_OUT}, x AS (SELECT *, {_CATEGORY} AS category, CASE WHEN id % 3 > 0 THEN (id % 977) * 10 END AS tokens, validated > 0 AND runtime IS NOT NULL AS complete FROM c)
SELECT grp, count(*) AS n, {", ".join(f"count(*) FILTER (outcome = '{c}') AS {c}, count(*) FILTER (outcome = '{c}' AND complete) AS {c}_evidence" for c in R.OUTCOMES)},
{", ".join(f"count(*) FILTER (outcome = 'llm_blocker' AND category = '{c}') AS {c}" for c in R.CATEGORIES)},
round(avg(CASE WHEN outcome <> 'llm_blocker' THEN 1.0 ELSE 0 END), 6) AS success_rate, CAST(sum(candidates) AS BIGINT) AS candidates,
{", ".join(f"CAST(round(coalesce(sum({c}), 0), 3) AS DOUBLE) AS total_{c}, count({c}) AS known_{c}, round(avg({c}), 4) AS mean_{c}" for c in _KNOWN)} FROM x GROUP BY 1""")
def outcome_metrics(spark, sf):
    rows = _outcomes(spark, sf).withColumn("category", R.blocker_category(F.col("blocker"), F.col("safety") - 6, F.col("validated"), F.col("status")))
    rows = rows.withColumn("tokens", F.when(F.col("id") % 3 > 0, F.col("id") % 977 * 10)).withColumn(
        "evidence", F.when((F.col("validated") > 0) & F.col("runtime").isNotNull(), "complete").otherwise("partial"))
    m = R.outcome_metrics(rows, "grp").withColumn("success_rate", rounded("success_rate"))
    return m.withColumns({f"mean_{c}": F.round(f"mean_{c}", 4) for c in _KNOWN} | {f"total_{c}": F.round(F.col(f"total_{c}").cast("double"), 3) for c in _KNOWN})


@query("""WITH c AS (SELECT c_custkey AS case_id, c_mktsegment AS expected, ['x' || c_custkey % 97, c_name, 'n' || c_nationkey] AS aliases FROM customer), r AS (SELECT 'n' || n_nationkey AS alias, CASE WHEN n_nationkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS actual FROM nation WHERE n_nationkey > 3
UNION ALL SELECT c_name, c_mktsegment FROM customer WHERE c_custkey % 3 = 0), k AS (SELECT case_id, expected, unnest(aliases) AS alias, unnest([0, 1, 2]) AS at_ FROM c), m AS (SELECT case_id, min_by(actual, at_) AS actual FROM k JOIN r USING (alias) GROUP BY 1)
SELECT c.case_id, CASE WHEN actual IS NULL THEN 'missing' WHEN actual = expected THEN 'matched' ELSE 'mismatch' END AS status FROM c LEFT JOIN m ON c.case_id = m.case_id""")
def catalog_audit(spark, sf):
    cust = table(spark, sf, "customer")
    c = cust.select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("expected"), F.array(F.concat(F.lit("x"), F.col("c_custkey") % 97), F.col("c_name"), F.concat(F.lit("n"), F.col("c_nationkey"))).alias("aliases"))
    n = table(spark, sf, "nation").where("n_nationkey > 3").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("alias"), F.when(F.col("n_nationkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("actual"))
    return R.catalogue_audit(c, n.unionByName(cust.where("c_custkey % 3 = 0").select(F.col("c_name").alias("alias"), F.col("c_mktsegment").alias("actual"))))


READY = {"min_pass_rate": 0.30, "max_fail_rate": 0.36, "min_runs": 10}
_READY_SQL = """, m AS (SELECT suite AS key, avg(CASE WHEN failed THEN 1.0 ELSE 0 END) AS fail_rate, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS pass_rate, count(*) AS runs FROM suites GROUP BY 1),
g AS (SELECT key, 'min_pass_rate' AS "check", pass_rate >= 0.30 AS passed FROM m UNION ALL SELECT key, 'max_fail_rate', fail_rate <= 0.36 FROM m UNION ALL SELECT key, 'min_runs', runs >= 10 FROM m)"""


def _readiness(spark, sf):
    s = VIEWS["suites"](spark, sf).groupBy(F.col("suite").alias("key")).agg(F.avg(F.col("failed").cast("double")).alias("fail_rate"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.count("*").alias("runs"))
    return V.gate(s, READY, "key")


@query(_READY_SQL + """ SELECT key, count(*) FILTER (passed) AS passed, count(*) AS checks, coalesce(string_agg(CASE WHEN NOT passed THEN 'raise ' || "check" END, ',' ORDER BY "check"), '') AS next_actions FROM g GROUP BY 1""", "suites")
def readiness_audit(spark, sf):
    bad = F.when(~F.col("passed"), F.concat(F.lit("raise "), F.col("check")))
    return _readiness(spark, sf).groupBy("key").agg(count_if("passed").alias("passed"), F.count("*").alias("checks"), F.array_join(F.array_sort(F.collect_set(bad)), ",").alias("next_actions"))


@query(_READY_SQL + """, a AS (SELECT suite AS key, count(DISTINCT name) AS artifacts FROM suites GROUP BY 1) SELECT g.key, bool_and(passed) AND max(artifacts) >= 5 AS valid, max(artifacts) AS artifacts FROM g JOIN a ON g.key = a.key GROUP BY 1""", "suites")
def smoke_validate(spark, sf):
    a = VIEWS["suites"](spark, sf).groupBy(F.col("suite").alias("key")).agg(F.countDistinct("name").alias("artifacts"))
    return _readiness(spark, sf).join(a, "key").groupBy("key").agg((F.bool_and("passed") & (F.max("artifacts") >= 5)).alias("valid"), F.max("artifacts").alias("artifacts"))


_STEPS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id AS case_id, count(DISTINCT CASE WHEN trim(CASE WHEN event_id % 10 = 0 THEN ' ' ELSE event_type END) <> '' THEN event_type END) = 5 AS complete FROM events GROUP BY 1")
def trace_complete(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("case_id"), "event_type", F.when(F.col("event_id") % 10 == 0, " ").otherwise(F.col("event_type")).alias("text"))
    return R.trace_complete(e, "case_id", "event_type", "text", _STEPS)


@query("""WITH r AS (SELECT l_returnflag AS grp, CASE WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax > 0.06 THEN 'tax' WHEN l_quantity > 40 THEN 'quantity' ELSE 'other' END AS reason, l_orderkey AS id FROM lineitem), g AS (SELECT grp, reason, count(*) AS n FROM r GROUP BY 1, 2)
SELECT g.grp, g.reason, n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, reason) = 1 AS dominant, (SELECT array_to_string(list_slice(list_sort(list(id)), 1, 3), ',') FROM r WHERE r.grp = g.grp AND r.reason = g.reason) AS examples FROM g""")
def rejection_audit(spark, sf):
    reason = F.when(F.col("l_discount") > 0.08, "discount").when(F.col("l_tax") > 0.06, "tax").when(F.col("l_quantity") > 40, "quantity").otherwise("other")
    r = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), reason.alias("reason"), F.col("l_orderkey").alias("id"))
    return R.rejection_audit(r, "grp", "reason", "id").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


_LAYER = """s AS (SELECT l_orderkey AS run_id, l_linenumber AS place, 'layer_' || l_linenumber AS layer, CASE WHEN l_discount > 0.09 THEN 'fail' WHEN l_discount > 0.07 THEN 'warn' WHEN l_discount < 0.02 THEN 'skip' ELSE 'pass' END AS status, CASE WHEN l_tax > 0.05 THEN 'blocked' ELSE '' END AS blocker FROM lineitem)"""


def _stages(spark, sf):
    d = F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("place"), F.concat(F.lit("layer_"), "l_linenumber").alias("layer"),
        F.when(d > 0.09, "fail").when(d > 0.07, "warn").when(d < 0.02, "skip").otherwise("pass").alias("status"), F.when(F.col("l_tax") > 0.05, "blocked").otherwise("").alias("blocker"))


@query(f"""WITH {_LAYER} SELECT run_id, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'fail') AS failed,
coalesce(array_to_string(list_sort(list(DISTINCT layer) FILTER (status = 'fail')), ','), '') AS failed_stages, bool_or(status = 'fail') AS has_blockers, bool_or(status IN ('fail', 'warn')) AS needs_attention FROM s GROUP BY 1""")
def stage_rollup(spark, sf):
    return R.stage_rollup(_stages(spark, sf), "run_id", "status", "layer").withColumn("failed_stages", F.array_join("failed_stages", ","))


@query(f"""WITH {_LAYER}, p AS (SELECT *, CASE WHEN status IN ('fail', 'warn') AND blocker <> '' THEN 0 WHEN status IN ('fail', 'warn') THEN 1 WHEN status = 'skip' THEN 2 ELSE 3 END AS tier FROM s)
SELECT run_id, layer FROM p QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY tier, place, layer) = 1""")
def primary_layer(spark, sf):
    return R.primary_layer(_stages(spark, sf), "run_id")


@query("""SELECT p_brand AS grp, round(100 * avg(CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END), 6) AS readiness FROM part GROUP BY 1""")
def readiness_score(spark, sf):
    k = F.col("p_size") % 3
    p = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.when(k == 0, "ready").when(k == 1, "partial").otherwise("missing").alias("status"))
    return R.readiness_score(p, "grp").withColumn("readiness", rounded("readiness"))
