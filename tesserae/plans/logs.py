"""Log queries over the runs' output lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import logs as L
from ..operators.similarity import keep_first as first_of
from ..sources.storage import stored
from ..tables import VIEWS, table
from .base import query

_NODE = r"[^\s:]+\.py(?:::[^\s\[]+)+(?:\[[^\]]*\])?"
_TESTS = rf""", n AS (SELECT run_id, line_no, CASE WHEN regexp_matches(text, '^FAILED {_NODE}') THEN regexp_extract(text, '^FAILED ({_NODE})', 1)
  WHEN regexp_matches(text, '^{_NODE} FAILED') THEN regexp_extract(text, '^({_NODE}) FAILED', 1)
  WHEN regexp_matches(text, '^FAIL: ') THEN regexp_replace(text, '^FAIL: (\w+) \((\w+)\.(\w+)\.(\w+)\.\w+\)$', '\2/\3.py::\4::\1') END AS nodeid FROM logs),
t AS (SELECT run_id, line_no, nodeid, split_part(nodeid, '::', 1) AS path, regexp_replace(split_part(nodeid, '::', -1), '\[.*$', '') AS test FROM n WHERE nodeid IS NOT NULL)"""


@query(_TESTS + " SELECT run_id, CAST(line_no AS INTEGER) AS line_no, nodeid, path, test FROM t", "logs")
def log_failing_tests(spark, sf):
    return L.failing_tests(VIEWS["logs"](spark, sf))


_FRAMES = r""", f AS (SELECT run_id, line_no, CASE WHEN text LIKE 'File "%' THEN regexp_extract(text, '"([^"]+)"', 1) ELSE split_part(text, ':', 1) END AS path,
  CAST(CASE WHEN text LIKE 'File "%' THEN regexp_extract(text, 'line (\d+)', 1) ELSE split_part(text, ':', 2) END AS INTEGER) AS line, regexp_extract(text, 'in (\w+)$', 1) AS function,
  CASE WHEN text LIKE 'File "%' THEN 'python_traceback' ELSE 'pytest' END AS format FROM logs WHERE text LIKE 'File "%' OR text LIKE 'src/%')"""


@query(_FRAMES + " SELECT run_id, CAST(line_no AS INTEGER) AS line_no, path, line, function, format FROM f", "logs")
def log_frames(spark, sf):
    return L.frames(VIEWS["logs"](spark, sf))


@query(_FRAMES + " SELECT run_id, CAST(min(line_no) AS INTEGER) AS line_no, path, line, function FROM f GROUP BY run_id, path, line, function", "logs")
def keep_first(spark, sf):
    return first_of(L.frames(VIEWS["logs"](spark, sf)), ["path", "line", "function"], ["line_no"], ["run_id"]).select("run_id", "line_no", "path", "line", "function")


_CLASS = """CASE WHEN success THEN 'success' WHEN timeout THEN 'timeout' WHEN contains(t, 'blocked by safety gate') THEN 'safety_gate_blocked' WHEN contains(t, 'patch target does not exist') THEN 'patch_apply_error'
WHEN contains(t, 'syntaxerror') THEN 'syntax_error' WHEN contains(t, 'modulenotfounderror') THEN 'import_error' WHEN contains(t, 'attributeerror') THEN 'attribute_error' WHEN contains(t, 'typeerror') THEN 'type_error'
WHEN contains(t, 'assertionerror') OR failed > 0 THEN 'test_failure' WHEN contains(t, 'traceback') OR returncode NOT IN (0, -1) THEN 'runtime_error' WHEN returncode = -1 THEN 'execution_error' ELSE 'unknown_failure' END"""


@query(f" SELECT run_id, {_CLASS} AS failure_class FROM (SELECT *, lower(output) AS t FROM outcomes)", "outcomes")
def failure_class(spark, sf):
    return VIEWS["outcomes"](spark, sf).select("run_id", L.failure_class().alias("failure_class"))


_DIAG = """, d AS (SELECT *, CASE WHEN success THEN 'none' WHEN output = 'No module named pytest' THEN 'missing_test_runner' WHEN contains(output, 'No module named') THEN 'missing_dependency'
WHEN contains(output, 'fixture ') THEN 'missing_pytest_fixture' WHEN contains(output, 'SyntaxError:') THEN 'syntax_error' WHEN output = 'import file mismatch' THEN 'import_path_error'
WHEN contains(output, 'DJANGO') THEN 'framework_configuration_error' WHEN contains(output, 'PytestWarning') THEN 'pytest_warning_as_error' WHEN contains(output, 'ERROR collecting') THEN 'pytest_collection_error'
WHEN output = 'collected 0 items' THEN 'no_tests_collected' WHEN contains(output, 'usage:') THEN 'command_usage_error' WHEN contains(output, 'interpreter') THEN 'tox_missing_python_interpreter'
WHEN output = 'AssertionError' OR contains(output, ' failed') THEN 'test_assertion_failure' ELSE 'command_failed' END AS category FROM outcomes)"""


@query(_DIAG + """ SELECT run_id, category, CASE category WHEN 'none' THEN '' WHEN 'missing_test_runner' THEN 'missing_runner:pytest' WHEN 'missing_dependency' THEN 'missing_module:numpy'
WHEN 'missing_pytest_fixture' THEN 'missing_fixture:db' WHEN 'command_failed' THEN 'returncode:' || returncode ELSE output END AS signal FROM d""", "outcomes")
def run_diagnosis(spark, sf):
    return VIEWS["outcomes"](spark, sf).select("run_id", *L.run_diagnosis())


@query(""" SELECT run_id, CASE WHEN output LIKE '12 passed%' THEN 12 WHEN output LIKE 'Ran 9%' THEN 9 ELSE 0 END AS passed, CASE WHEN output LIKE '12 passed%' THEN 5 ELSE 0 END AS failed,
CASE WHEN output LIKE '12 passed%' THEN 1 ELSE 0 END AS skipped, CASE WHEN output LIKE '12 passed%' THEN 18 WHEN output LIKE 'Ran 9%' THEN 9 ELSE 0 END AS total FROM outcomes""", "outcomes")
def test_counts(spark, sf):
    return VIEWS["outcomes"](spark, sf).select("run_id", *L.test_counts())


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS f FROM documents)
SELECT doc_id, CASE WHEN f IS NULL THEN '' WHEN length(f) <= 120 THEN f ELSE substr(f, 1, 117) || '...' END AS line FROM l""")
def failure_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.failure_line("text").alias("line"))


_LEVEL = _DIAG + """, e AS (SELECT *, CASE WHEN run_id % 17 = 0 THEN 'none' WHEN run_id % 11 = 0 THEN 'not_executed' WHEN success THEN 'passing_tests' WHEN category = 'test_assertion_failure' THEN 'failing_tests'
WHEN category IN ('missing_dependency', 'missing_pytest_fixture', 'command_usage_error', 'pytest_warning_as_error') THEN 'environment_failure'
WHEN category IN ('pytest_collection_error', 'syntax_error', 'no_tests_collected') THEN 'collection_failure' ELSE 'unknown_failure' END AS level FROM d)"""


@query(_LEVEL + " SELECT level, count(*) AS runs FROM e GROUP BY 1", "outcomes")
def evidence_level(spark, sf):
    d = VIEWS["outcomes"](spark, sf).select("run_id", "success", *L.run_diagnosis())
    level = L.evidence_level(F.when(F.col("success"), "pass").otherwise("fail"), F.col("category"), F.col("run_id") % 17 != 0, F.col("run_id") % 11 != 0)
    return d.groupBy(level.alias("level")).agg(F.count("*").alias("runs"))


@query(_DIAG + """, x AS (SELECT *, run_id % 2 = 1 AS retry, run_id % 11 <> 0 AS executed, run_id // 10 AS grp FROM d),
r AS (SELECT *, CASE WHEN executed AND category = 'test_assertion_failure' AND retry THEN 0 WHEN executed AND category = 'test_assertion_failure' THEN 1 WHEN executed AND retry THEN 2
  WHEN executed THEN 3 WHEN NOT retry THEN 4 ELSE 5 END AS tier FROM x) SELECT grp, run_id, category FROM r QUALIFY row_number() OVER (PARTITION BY grp ORDER BY tier, run_id) = 1""", "outcomes")
def best_execution(spark, sf):
    d = VIEWS["outcomes"](spark, sf).select("run_id", *L.run_diagnosis())
    d = d.select("run_id", "category", (F.col("run_id") % 2 == 1).alias("retry"), (F.col("run_id") % 11 != 0).alias("executed"), F.floor(F.col("run_id") / 10).alias("grp"), F.col("run_id").alias("ordinal"))
    return L.best_execution(d, "grp").select("grp", "run_id", "category")


_ENT = """, ent AS (SELECT p_partkey AS entity, CASE WHEN p_partkey % 2 = 0 THEN 'tests/test_' ELSE 'src/m' END || p_partkey % 12 || '.py' AS path,
  CASE WHEN p_partkey % 2 = 0 THEN 'test_' ELSE 'fn_' END || p_size % 9 AS name, 'pkg.' || CASE WHEN p_partkey % 2 = 0 THEN 'test_' ELSE 'fn_' END || p_size % 9 AS qualified, p_size AS start_line, p_size + 8 AS end_line FROM part)"""


def _entities(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    name = F.concat(F.when(even, "test_").otherwise("fn_"), F.col("p_size") % 9)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("entity"), F.concat(F.when(even, "tests/test_").otherwise("src/m"), F.col("p_partkey") % 12, F.lit(".py")).alias("path"), name.alias("name"),
        F.concat(F.lit("pkg."), name).alias("qualified"), F.col("p_size").alias("start_line"), (F.col("p_size") + 8).alias("end_line"))


_MT = _TESTS + _ENT + r""", m AS (SELECT DISTINCT t.nodeid, entity, CASE WHEN e.qualified = t.test THEN 4 ELSE 0 END + CASE WHEN ends_with(e.qualified, '.' || t.test) THEN 3 ELSE 0 END
  + CASE WHEN e.name = t.test THEN 2 ELSE 0 END + CASE WHEN t.path = e.path OR ends_with(t.path, '/' || e.path) OR ends_with(e.path, '/' || t.path) THEN 1 ELSE 0 END AS score
  FROM t JOIN ent e ON split_part(t.path, '/', -1) = split_part(e.path, '/', -1)),
mt AS (SELECT nodeid, entity, score FROM m WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY nodeid ORDER BY score DESC, entity) = 1)"""
_MF = _FRAMES + """, fm AS (SELECT DISTINCT f.path, f.line, f.function, entity, CASE WHEN f.line BETWEEN start_line AND end_line THEN 8 ELSE 0 END + CASE WHEN e.name = f.function THEN 4 ELSE 0 END
  + CASE WHEN ends_with(e.qualified, '.' || f.function) THEN 2 ELSE 0 END + CASE WHEN f.path = e.path OR ends_with(f.path, '/' || e.path) THEN 1 ELSE 0 END AS score
  FROM f JOIN ent e ON split_part(f.path, '/', -1) = split_part(e.path, '/', -1)),
mf AS (SELECT path, line, function, entity, score FROM fm WHERE score > 1 QUALIFY row_number() OVER (PARTITION BY path, line, function ORDER BY score DESC, entity) = 1)"""


def _matched_tests(spark, sf):
    t = L.failing_tests(VIEWS["logs"](spark, sf)).withColumn("qualified", F.col("test"))
    return t, L.match_tests(t, _entities(spark, sf))


@query(_MT + " SELECT nodeid, entity, score FROM mt", "logs")
def match_tests(spark, sf):
    return _matched_tests(spark, sf)[1]


@query(_ENT + _MF + " SELECT * FROM mf", "logs")
def match_frames(spark, sf):
    return L.match_frames(L.frames(VIEWS["logs"](spark, sf)), _entities(spark, sf))


@query(_MT + _MF + """, fr AS (SELECT DISTINCT f.run_id, mf.entity FROM f JOIN mf ON f.path = mf.path AND f.line = mf.line AND f.function = mf.function), rt AS (SELECT DISTINCT run_id, nodeid FROM t),
s AS (SELECT rt.run_id, rt.nodeid AS test, mt.entity FROM rt JOIN mt USING (nodeid) UNION SELECT fr.run_id, coalesce(rt.nodeid, 'synthetic::failure'), fr.entity FROM fr LEFT JOIN rt ON fr.run_id = rt.run_id)
SELECT run_id, count(*) AS n, count(DISTINCT test) AS tests, count(DISTINCT entity) AS entities FROM s GROUP BY 1""", "logs")
def evidence_spectrum(spark, sf):
    # both are read twice below; their regular expressions run once
    t = stored(L.failing_tests(VIEWS["logs"](spark, sf)), "failing-tests")
    m = L.match_tests(t.withColumn("qualified", F.col("test")), _entities(spark, sf))
    f = stored(L.frames(VIEWS["logs"](spark, sf)), "frames")
    framed = f.join(L.match_frames(f, _entities(spark, sf)).select("path", "line", "function", "entity"), ["path", "line", "function"])
    return L.evidence_counts(t, m, framed)


@query("""WITH p AS (SELECT page_id, lower(coalesce(html, '')) AS t, replace(lower(coalesce(html, '')), ' ', '') AS flat FROM pages),
g AS (SELECT *, contains(t, 'len(') AND (contains(t, '/') OR contains(t, '%')) AS d, contains(flat, 'ifnot') OR contains(flat, '==0') OR contains(flat, '<=0') OR contains(t, 'raise valueerror') AS g FROM p)
SELECT page_id, CASE WHEN d THEN CASE WHEN g THEN 40 ELSE 150 END ELSE 0 END + CASE WHEN contains(t, '.sort(') AND contains(t, '=') THEN 60 ELSE 0 END
+ CASE WHEN contains(t, 'range(') AND (contains(t, '[i +') OR contains(t, '[index +')) THEN 70 ELSE 0 END + CASE WHEN NOT contains(t, '.get(') AND contains(t, '[') AND contains(t, 'key') THEN 30 ELSE 0 END
+ CASE WHEN contains(t, 'except exception') OR contains(t, 'except:') THEN 50 ELSE 0 END AS score FROM g""")
def pattern_score(spark, sf):
    return table(spark, sf, "pages").select("page_id", L.pattern_score("html").alias("score"))


# A rule table for lines of text: (id, pattern, type, confidence).
LINE_RULES = [
    ("hard_coded_secret", "(password|token|secret) *[=:]", "security", 0.85), ("mail_address", "[a-z0-9.]+@[a-z0-9.]+", "privacy", 0.80),
    ("repeated_marks", "[!]{2}", "style", 0.65), ("table_row", "[|].*[|]", "layout", 0.70), ("licence_notice", "[Ll]icensed? under", "licence", 0.75)]


@query(", r AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{p}', '{b}', {c})" for i, p, b, c in LINE_RULES) + """) v(rule_id, pattern, bug_type, confidence))
SELECT source, rule_id, bug_type, count(*) AS lines, count(DISTINCT doc_id) AS docs, CAST(round(max(confidence), 6) AS DOUBLE) AS confidence FROM lines JOIN r ON regexp_matches(line, pattern) GROUP BY 1, 2, 3""", "lines")
def rule_scan(spark, sf):
    f = L.scan_rules(VIEWS["lines"](spark, sf), LINE_RULES)
    return f.groupBy("source", "rule_id", "bug_type").agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("docs"), rounded(F.max("confidence")).alias("confidence"))
