"""Validation and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import count_if, rounded
from ..operators import quality as V
from ..tables import VIEWS, table
from .base import query


@query("""WITH v AS (SELECT o_orderkey, unnest([CASE WHEN o_totalprice > 400000 THEN 'warning:large' END, CASE WHEN o_orderstatus = 'P' THEN 'error:unfinished' END, CASE WHEN o_custkey % 10 = 0 THEN 'error:blocked owner' END,
CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'warning:old' END]) AS m FROM orders) SELECT o_orderkey, split_part(m, ':', 1) AS severity, split_part(m, ':', 2) AS message FROM v WHERE m IS NOT NULL""")
def validate_rows(spark, sf):
    return V.violations(table(spark, sf, "orders"), ["o_orderkey"], [
        ("warning", "large", F.col("o_totalprice") > 400000), ("error", "unfinished", F.col("o_orderstatus") == "P"), ("error", "blocked owner", F.col("o_custkey") % 10 == 0),
        ("warning", "old", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))])


@query("SELECT p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1")
def validate_unique(spark, sf):
    return V.repeats(table(spark, sf, "part"), "p_name", "p_partkey").select("p_partkey", "p_name")


@query("""WITH g AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey) FILTER (l_returnflag = 'R')) AS wanted, list_distinct(list(l_suppkey) FILTER (l_linestatus = 'F')) AS known FROM lineitem GROUP BY 1),
v AS (SELECT id, unnest(list_filter(coalesce(wanted, []), lambda x: NOT list_contains(known, x))) AS value FROM g WHERE len(known) > 0) SELECT id, value FROM v""")
def validate_reference(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("wanted"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))).alias("known"))
    return V.dangling(g, "id", "wanted", "known")


_PATHS = "CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '^https?://[^/]*/', '') WHEN 1 THEN regexp_replace(url, '^https?:/', '') WHEN 2 THEN 'a/../' || url WHEN 3 THEN '' ELSE url END"


@query(f"SELECT page_id, NOT (p = '' OR starts_with(p, '/') OR list_contains(string_split(p, '/'), '..')) AS safe FROM (SELECT page_id, {_PATHS} AS p FROM pages)")
def validate_paths(spark, sf):
    p = (F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^https?://[^/]*/", "")).when(F.col("page_id") % 5 == 1, F.regexp_replace("url", "^https?:/", ""))
         .when(F.col("page_id") % 5 == 2, F.concat(F.lit("a/../"), "url")).when(F.col("page_id") % 5 == 3, "").otherwise(F.col("url")))
    return table(spark, sf, "pages").withColumn("p", p).select("page_id", V.safe_path("p").alias("safe"))


@query("SELECT doc_id % 3 AS kind, count(*) FILTER (doc_id % 3 = 0) AS digests, count(*) AS n FROM documents GROUP BY 1")
def validate_digest(spark, sf):
    d = F.sha2(F.coalesce("text", F.lit("")), 256)
    x = F.when(F.col("doc_id") % 3 == 0, d).when(F.col("doc_id") % 3 == 1, F.substring(d, 1, 63)).otherwise(F.concat(F.lit("g"), F.substring(d, 1, 63)))
    return table(spark, sf, "documents").withColumn("x", x).groupBy((F.col("doc_id") % 3).alias("kind")).agg(count_if(V.is_digest("x")).alias("digests"), F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (contains(text, 'http') OR contains(text, 'www')) AS has_link, count(*) FILTER (regexp_matches(text, '[0-9]')) AS has_digit, count(*) FILTER (contains(text, '!!')) AS has_marks,
count(*) FILTER (n_chars > 1000) AS long_text FROM documents GROUP BY 1""")
def completeness_audit(spark, sf):
    t = F.col("text")
    return V.completeness(table(spark, sf, "documents"), "source", {
        "has_link": t.contains("http") | t.contains("www"), "has_digit": t.rlike("[0-9]"), "has_marks": t.contains("!!"), "long_text": F.col("n_chars") > 1000})


_SUITE = ", m AS (SELECT suite || '/' || name AS key, avg(CASE WHEN failed THEN 1.0 ELSE 0 END) AS fail_rate, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS pass_rate, count(*) AS runs, avg(cost) AS cost FROM suites GROUP BY 1)"
LIMITS = {"max_fail_rate": 0.34, "min_pass_rate": 0.33, "runs": 100, "max_cost": 255000.0, "min_absent": 1.0}


def _metrics(spark, sf):
    s = VIEWS["suites"](spark, sf)
    return s.groupBy(F.concat_ws("/", "suite", "name").alias("key")).agg(
        F.avg(F.col("failed").cast("double")).alias("fail_rate"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.count("*").alias("runs"), F.avg("cost").alias("cost"))


_GATE = _SUITE + """, c AS (SELECT key, 'max_fail_rate' AS "check", 0.34 AS expected, fail_rate AS actual, fail_rate <= 0.34 + 1e-12 AS passed FROM m UNION ALL SELECT key, 'min_pass_rate', 0.33, pass_rate, pass_rate >= 0.33 - 1e-12 FROM m
UNION ALL SELECT key, 'runs', 100.0, runs, runs >= 100 FROM m UNION ALL SELECT key, 'max_cost', 255000.0, cost, cost <= 255000.0 FROM m UNION ALL SELECT key, 'min_absent', 1.0, 0, false FROM m)"""


@query(_GATE + ' SELECT key, "check", CAST(round(expected, 6) AS DOUBLE) AS expected, round(CAST(actual AS DOUBLE), 4) AS actual, passed FROM c', "suites")
def threshold_gate(spark, sf):
    return V.gate(_metrics(spark, sf), LIMITS, "key").withColumn("expected", rounded("expected")).withColumn("actual", F.round("actual", 4))


@query(_GATE + " SELECT key, count(*) FILTER (NOT passed) AS failed_checks, bool_and(passed) AS passed FROM c WHERE \"check\" <> 'min_absent' GROUP BY 1", "suites")
def quality_gate(spark, sf):
    g = V.gate(_metrics(spark, sf), {k: v for k, v in LIMITS.items() if k != "min_absent"}, "key")
    return g.groupBy("key").agg(count_if(~F.col("passed")).alias("failed_checks"), F.bool_and("passed").alias("passed"))


@query("SELECT p_brand AS grp, count(*) AS n FROM part GROUP BY 1 HAVING count(*) < (SELECT count(*) / 25 FROM part)")
def group_floor(spark, sf):
    part = table(spark, sf, "part")
    from ..functions import attach

    g = part.groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("n"))
    return attach(g, part.agg((F.count("*") / 25).alias("floor")), []).where("n < floor").select("grp", "n")


@query("""WITH a AS (SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' AND (l_linestatus = 'F' OR l_quantity > 45)) SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT id FROM a)""")
def missing_evidence(spark, sf):
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("success"))
    a = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_returnflag") == "A").alias("success"), F.when(F.col("l_linestatus") == "F", "success").otherwise("other").alias("failure_type"),
        F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("passed"), F.lit(1).alias("failed"))
    return V.missing_evidence(cases, a, "id").select("id", "priority")


@query(""", t AS (SELECT case_id, list_sort(list_filter([CASE WHEN item % 2 <> 0 THEN 'graph' END, CASE WHEN item % 3 <> 0 THEN 'sbfl' END, CASE WHEN NOT relevant THEN 'static' END], lambda x: x IS NOT NULL)) AS missing FROM ranked WHERE rank = 1)
SELECT case_id, array_to_string(missing, ',') AS missing FROM t WHERE len(missing) > 0""", "ranked")
def required_signals(spark, sf):
    r = VIEWS["ranked"](spark, sf)
    entries = F.array(F.when(F.col("item") % 2 == 0, F.struct(F.lit("graph"), F.lit(1.0))), F.when(F.col("item") % 3 == 0, F.struct(F.lit("sbfl"), F.lit(1.0))), F.when(F.col("relevant"), F.struct(F.lit("static"), F.lit(1.0))))
    r = r.withColumn("signals", F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())))
    return V.missing_signals(r, "case_id", "signals", ["sbfl", "graph", "static"]).withColumn("missing", F.array_join("missing", ","))


@query("""WITH e AS (SELECT o_orderkey AS id, 'status' AS field, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END END AS expected, o_orderstatus AS actual FROM orders
UNION ALL SELECT o_orderkey, 'owner', CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey % 10 AS VARCHAR) END, CAST(o_custkey % 12 AS VARCHAR) FROM orders) SELECT id, field, expected, actual, expected = actual AS passed FROM e WHERE expected IS NOT NULL""")
def expectation_check(spark, sf):
    k = F.col("o_orderkey")
    return V.expectations(table(spark, sf, "orders").withColumn("id", k), "id", [
        ("status", F.when(k % 3 > 0, F.when(k % 2 == 0, "F").otherwise("O")), F.col("o_orderstatus")), ("owner", F.when(k % 5 == 0, F.col("o_custkey") % 10), F.col("o_custkey") % 12)])


@query("""WITH c AS (SELECT c_custkey AS id, unnest([ROW('balance', CASE WHEN c_custkey % 2 = 0 THEN c_acctbal >= 1000 END), ROW('segment', CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment = 'BUILDING' END), ROW('name', starts_with(c_name, 'Customer#0000000')),
ROW('home', CASE WHEN c_nationkey > 5 THEN c_nationkey < 15 END), ROW('word', contains(c_mktsegment, 'H'))]) AS x FROM customer) SELECT id, x[1] AS name, x[2] AS passed FROM c WHERE x[2] IS NOT NULL""")
def acceptance_checks(spark, sf):
    k = F.col("c_custkey")
    return V.acceptance(table(spark, sf, "customer").withColumn("id", k), "id", [
        ("balance", "minimum", F.when(k % 2 == 0, F.lit(1000)), F.col("c_acctbal")), ("segment", "equals", F.when(k % 3 == 0, F.lit("BUILDING")), F.col("c_mktsegment")),
        ("name", "prefix", F.lit("Customer#0000000"), F.col("c_name")), ("home", "boolean", F.when(F.col("c_nationkey") > 5, F.lit(True)), F.col("c_nationkey") < 15), ("word", "contains", F.lit("H"), F.col("c_mktsegment"))])


@query("""WITH c AS (SELECT s_suppkey AS id, [s_acctbal > 0, s_nationkey > 3, s_suppkey % 4 > 0, s_acctbal > 2000, s_nationkey % 2 = 0] AS ok FROM supplier)
SELECT id, round(len(list_filter(ok, lambda x: x)) / 5, 6) AS score, CASE WHEN NOT ok[1] THEN 'balance' WHEN NOT ok[2] THEN 'nation' WHEN NOT ok[3] THEN 'number' WHEN NOT ok[4] THEN 'reserve' WHEN NOT ok[5] THEN 'parity' ELSE '' END AS blocker,
CASE WHEN NOT ok[1] OR NOT ok[2] THEN 'fail' WHEN list_contains(ok, false) THEN 'warn' ELSE 'pass' END AS status FROM c""")
def doctor_checks(spark, sf):
    b, n, k = F.col("s_acctbal"), F.col("s_nationkey"), F.col("s_suppkey")
    d = V.doctor(table(spark, sf, "supplier").withColumn("id", k), "id", [("balance", True, b > 0), ("nation", True, n > 3), ("number", False, k % 4 > 0), ("reserve", False, b > 2000), ("parity", False, n % 2 == 0)])
    return d.withColumn("score", rounded("score"))
