"""Coverage and spectrum queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import coverage as C
from ..tables import VIEWS, table
from .base import query

_FUNCTIONS = """functions AS (SELECT p_brand AS file, p_partkey AS function, (p_partkey % 97) * 10 AS start_line,
  (p_partkey % 97) * 10 + p_size AS end_line, p_size = 1 AS is_test FROM part),
hits AS (SELECT l_orderkey AS test, 'Brand#' || (l_suppkey % 25 + 1) AS file,
  CAST(l_quantity AS BIGINT) * 20 + l_linenumber AS line FROM lineitem)"""


def _functions(spark, sf):
    start = (F.col("p_partkey") % 97) * 10
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("file"), F.col("p_partkey").alias("function"), start.alias("start_line"),
        (start + F.col("p_size")).alias("end_line"), (F.col("p_size") == 1).alias("is_test"))


def _hits(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("test"), F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25 + 1).alias("file"),
        (F.col("l_quantity").cast("long") * 20 + F.col("l_linenumber")).alias("line"))


@query(f"""WITH {_FUNCTIONS} SELECT f.function, count(DISTINCT h.test) AS tests FROM hits h JOIN functions f
ON h.file = f.file AND h.line > f.start_line AND h.line <= f.end_line WHERE NOT f.is_test GROUP BY f.function""")
def cov_range_join(spark, sf):
    return C.covering_tests(_hits(spark, sf), _functions(spark, sf))


@query(f"""WITH {_FUNCTIONS}, places AS (SELECT DISTINCT file, line FROM hits) SELECT p.file, p.line, f.function FROM places p JOIN functions f
ON p.file = f.file AND p.line > f.start_line AND p.line <= f.end_line
QUALIFY row_number() OVER (PARTITION BY p.file, p.line ORDER BY f.start_line DESC, f.function DESC) = 1""")
def cov_innermost(spark, sf):
    return C.innermost_function(_hits(spark, sf), _functions(spark, sf))


_EXEC = "executable AS (SELECT DISTINCT component AS function, element AS line FROM cov WHERE branch LIKE 'A%')"


def _line_hits(spark, sf):
    return VIEWS["cov"](spark, sf).select(F.col("run_id").alias("test"), F.col("component").alias("function"), F.col("element").alias("line"))


def _executable(spark, sf):
    return VIEWS["cov"](spark, sf).where("branch like 'A%'").select(F.col("component").alias("function"), F.col("element").alias("line"))


@query(f", {_EXEC} SELECT c.run_id AS test, c.component AS function, count(DISTINCT c.element) AS n_lines FROM cov c JOIN executable e "
       "ON c.component = e.function AND c.element = e.line GROUP BY 1, 2", "cov")
def cov_lines(spark, sf):
    return C.covered_lines(_line_hits(spark, sf), _executable(spark, sf)).groupBy("test", "function").agg(F.count("*").alias("n_lines"))


@query(f""", {_EXEC}, n AS (SELECT function, count(*) AS executable FROM executable GROUP BY 1)
SELECT c.run_id AS test, c.component AS function, count(DISTINCT c.element) AS covered, n.executable,
round(count(DISTINCT c.element) / n.executable, 6) AS ratio FROM cov c JOIN executable e ON c.component = e.function AND c.element = e.line
JOIN n ON n.function = c.component GROUP BY c.run_id, c.component, n.executable""", "cov")
def cov_ratio(spark, sf):
    return C.coverage_ratio(_line_hits(spark, sf), _executable(spark, sf)).withColumn("ratio", rounded("ratio"))


@query("SELECT l_suppkey AS file, l_partkey AS line, count(*) AS hits FROM lineitem WHERE l_partkey > 0 GROUP BY 1, 2")
def line_counts(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("line"))
    return C.line_counts(e, "file", "line")


@query("""SELECT h.test, h.loop, CASE WHEN coalesce(max(m.n), 0) = 0 THEN 'zero' WHEN max(m.n) = 1 THEN 'single' ELSE 'multi' END AS state
FROM (SELECT DISTINCT l_orderkey AS test, l_suppkey % 10 AS loop FROM lineitem) h
LEFT JOIN (SELECT l_orderkey AS test, l_suppkey % 10 AS loop, l_partkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE p_size > 25 GROUP BY 1, 2, 3) m ON h.test = m.test AND h.loop = m.loop GROUP BY h.test, h.loop""")
def loop_state(spark, sf):
    loop = (F.col("l_suppkey") % 10).alias("loop")
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("test"), loop, F.col("l_partkey").alias("line"))
    body = hits.select("loop", "line").distinct().join(
        table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("line")), "line")
    return C.loop_state(hits, body)


_COLLAPSED = """, c AS (SELECT run_id, seq, component % 8 AS value, status, lag(component % 8) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM steps),
k AS (SELECT run_id, value, status = 'F' AS flagged, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS pos FROM c WHERE before IS NULL OR before <> value)"""


def _collapsed(spark, sf, keep_parts=False):
    s = VIEWS["steps"](spark, sf).select("run_id", "seq", (F.col("component") % 8).alias("value"), (F.col("status") == "F").alias("flagged"))
    return C.collapse_runs(s, "run_id", "seq", "value", keep_parts)


@query(_COLLAPSED + " SELECT run_id, CAST(seq AS INTEGER) AS seq, value, CAST(pos AS INTEGER) AS at FROM k", "steps")
def seq_collapse(spark, sf):
    return _collapsed(spark, sf).select("run_id", "seq", "value", "at")


_NGRAMS = _COLLAPSED + """, w AS (SELECT run_id, value AS a, lead(value, 1) OVER p AS b, lead(value, 2) OVER p AS c,
  flagged AS fa, lead(flagged, 1) OVER p AS fb, lead(flagged, 2) OVER p AS fc FROM k WINDOW p AS (PARTITION BY run_id ORDER BY pos)),
g AS (SELECT run_id, [a, b] AS win, fa OR fb AS flag FROM w WHERE b IS NOT NULL UNION ALL
  SELECT run_id, [a, b, c], fa OR fb OR fc FROM w WHERE c IS NOT NULL),
f AS (SELECT run_id, unnest(list_distinct(win)) AS member, array_to_string(win, ' -> ') AS path, flag FROM g WHERE len(list_distinct(win)) > 1)"""


@query(_NGRAMS + " SELECT member, 'path:' || path AS fragment, count(DISTINCT run_id) AS runs FROM f GROUP BY 1, 2", "steps")
def seq_ngrams(spark, sf):
    f = C.ngram_fragments(_collapsed(spark, sf, True), "run_id", "at", "value", "path:")
    return f.groupBy("member", "fragment").agg(F.count("*").alias("runs"))


@query(_NGRAMS + " SELECT member, 'async:' || path AS fragment, count(DISTINCT run_id) AS runs FROM f WHERE flag GROUP BY 1, 2", "steps")
def seq_ngrams_flag(spark, sf):
    f = C.ngram_fragments(_collapsed(spark, sf, True), "run_id", "at", "value", "async:", flag="flagged")
    return f.groupBy("member", "fragment").agg(F.count("*").alias("runs"))


@query(_COLLAPSED + """, s AS (SELECT run_id AS run, list(value ORDER BY pos) AS path FROM k GROUP BY 1),
e AS (SELECT s.*, o_orderpriority AS exception FROM s JOIN orders ON run = o_orderkey WHERE o_orderstatus = 'F')
SELECT DISTINCT run, path[-1] AS member, 'exception:' || exception || '@' || path[-1] AS fragment FROM e
UNION SELECT run, unnest(list_distinct(path)), 'exception-path:' || array_to_string(path, ' -> ') FROM e WHERE len(path) > 1""", "steps")
def exception_paths(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("exception"))
    s = VIEWS["steps"](spark, sf).select("run_id", "seq", (F.col("component") % 8).alias("value")).join(o.select("run_id"), "run_id", "left_semi")
    stacks = s.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("stack"))
    return C.exception_paths(stacks.join(o, "run_id").withColumnRenamed("run_id", "run"))


_SPECTRUM = """, t AS (SELECT CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS total_failed FROM runs),
s AS (SELECT c.{key}, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS ef, CAST(sum(CASE WHEN failed THEN 0 ELSE 1 END) AS BIGINT) AS ep
  FROM (SELECT DISTINCT run_id, {key} FROM cov) c JOIN runs USING (run_id) GROUP BY {key}),
o AS (SELECT *, coalesce(ef / nullif(sqrt(total_failed * (ef + ep)), 0), 0) AS score FROM s, t)"""
_ONE = _SPECTRUM.format(key="component")


def _spectrum(spark, sf, *key):
    return C.spectrum(VIEWS["cov"](spark, sf), VIEWS["runs"](spark, sf), [], list(key))


@query(_ONE + " SELECT component, ef, ep, total_failed FROM o", "runs", "cov")
def spectrum_counts(spark, sf):
    return _spectrum(spark, sf, "component")


@query(_ONE + " SELECT component, ef, ep, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, component) AS rank FROM o ORDER BY rank LIMIT 10",
       "runs", "cov")
def ochiai(spark, sf):
    """The ten most suspicious components of all cases together."""
    from ..operators.scoring import top_k

    scored = _spectrum(spark, sf, "component").withColumn("score", rounded(C.ochiai()))
    return top_k(scored, "score", ["component"], 10).select("component", "ef", "ep", "score", F.col("rank").cast("long"))


def _element_sql(element: str) -> str:
    return f""", t AS (SELECT case_id, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS tf FROM runs GROUP BY 1),
s AS (SELECT case_id, component, {element}, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS ef, count(*) AS n
  FROM (SELECT DISTINCT run_id, component, {element} FROM cov) c JOIN runs USING (run_id) GROUP BY ALL)
SELECT case_id, component, round(max(coalesce(ef / nullif(sqrt(tf * n), 0), 0)), 6) AS score, count(*) AS elements
FROM s JOIN t USING (case_id) GROUP BY case_id, component"""


def _by_element(spark, sf, element):
    s = C.ochiai_by_element(VIEWS["cov"](spark, sf), VIEWS["runs"](spark, sf), ["case_id"], "component", element)
    return s.withColumn("score", rounded("score"))


@query(_element_sql("element"), "runs", "cov")
def ochiai_line(spark, sf):
    return _by_element(spark, sf, "element")


@query(_element_sql("branch"), "runs", "cov")
def ochiai_branch(spark, sf):
    return _by_element(spark, sf, "branch")


@query(_NGRAMS + """, d AS (SELECT DISTINCT run_id, member, path FROM f), t AS (SELECT case_id, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS tf FROM runs GROUP BY 1),
s AS (SELECT case_id, member AS component, path, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS ef, count(*) AS n FROM d JOIN runs USING (run_id) GROUP BY ALL)
SELECT case_id, component, round(max(coalesce(ef / nullif(sqrt(tf * n), 0), 0)), 6) AS score, count(*) AS elements
FROM s JOIN t USING (case_id) GROUP BY case_id, component""", "runs", "steps")
def ochiai_path(spark, sf):
    f = C.ngram_fragments(_collapsed(spark, sf, True), "run_id", "at", "value", "path:").withColumnRenamed("member", "component")
    s = C.ochiai_by_element(f, VIEWS["runs"](spark, sf), ["case_id"], "component", "fragment")
    return s.withColumn("score", rounded("score"))


@query(""", h AS (SELECT component, count(DISTINCT element) AS n_all FROM cov GROUP BY 1),
e AS (SELECT run_id, component, count(DISTINCT element) AS n FROM cov WHERE run_id IN (SELECT run_id FROM runs WHERE failed) GROUP BY 1, 2),
b AS (SELECT component, max(n) AS n FROM e GROUP BY 1)
SELECT h.component, CASE WHEN b.n IS NULL THEN 0 ELSE 1 END AS covered, round(coalesce(b.n / n_all, 0), 6) AS max_ratio FROM h LEFT JOIN b USING (component)""",
       "runs", "cov")
def failing_cov(spark, sf):
    c = VIEWS["cov"](spark, sf)
    return C.failing_coverage(c, VIEWS["runs"](spark, sf), c, "component", "element").withColumn("max_ratio", rounded("max_ratio"))


@query(""", m AS (SELECT DISTINCT case_id, run_id, component FROM cov JOIN runs USING (run_id) WHERE case_id NOT LIKE '1%'),
truth AS (SELECT o_orderpriority AS case_id, min(l_suppkey) AS component FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
f AS (SELECT * FROM m UNION ALL SELECT r.case_id, run_id, component FROM runs r JOIN truth t ON r.case_id = t.case_id
  WHERE failed AND r.case_id NOT IN (SELECT case_id FROM m))
SELECT case_id, component, count(*) AS runs FROM f GROUP BY 1, 2""", "runs", "cov")
def cov_fallback(spark, sf):
    runs, cov = VIEWS["runs"](spark, sf), VIEWS["cov"](spark, sf)
    truth = cov.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("case_id")), "run_id")
    truth = truth.groupBy("case_id").agg(F.min("component").alias("component"))
    known = cov.join(runs.where("case_id not like '1%'").select("run_id"), "run_id", "left_semi")
    return C.with_fallback(known, runs, truth).groupBy("case_id", "component").agg(F.count("*").alias("runs"))
