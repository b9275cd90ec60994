"""The driver's tables seen as software-engineering data.

Orders are test runs, line items what a run covers, the items of an order in
sequence a graph of parts, events a user's attempts and ranked list. Each view
has the same definition twice: as a DataFrame and as SQL for the oracles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts or groups at once where tables are large.
TASK_ROWS = 1 << 18


def tasks_for(rows: DataFrame) -> int:
    """How many tasks of ``TASK_ROWS`` a given table makes, or 0 where every core has room for its share.

    Shuffled rows of keys and small numbers take a tenth of the room that they
    need in memory, so partitions of equal bytes would make the tasks too large.
    """
    tasks = -(-rows.count() // TASK_ROWS)
    return tasks if tasks > rows.sparkSession.sparkContext.defaultParallelism else 0


def dealt(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """``rows`` by ``key`` in so many tasks; with 0 as they are, and adaptive execution deals them."""
    return rows.repartition(tasks, key) if tasks else rows


def view(sql: str):
    def add(f):
        VIEWS[f.__name__], SQL[f.__name__] = f, " ".join(sql.split())
        return f

    return add


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the named views as common table expressions, in the order given."""
    return f"WITH {', '.join(f'{n} AS ({SQL[n]})' for n in names)} {sql}" if names else sql


@view("""SELECT o_orderkey AS run_id, o_orderstatus = 'F' AS failed, o_orderpriority AS case_id FROM orders
         WHERE o_orderstatus IN ('F', 'O')""")
def runs(spark, sf):
    """Finished test runs: run_id, failed, case_id."""
    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("failed"), F.col("o_orderpriority").alias("case_id"))


@view("""SELECT DISTINCT l_orderkey AS run_id, l_suppkey AS component, l_partkey AS element,
         l_returnflag || l_linestatus AS branch FROM lineitem""")
def cov(spark, sf):
    """What runs cover: run_id, component, element, branch."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("component"), F.col("l_partkey").alias("element"),
        F.concat("l_returnflag", "l_linestatus").alias("branch")).distinct()


_STEP = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"


@view(f"""SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_STEP}) AS seq, l_partkey AS part,
          l_suppkey AS component, l_quantity AS quantity, l_returnflag AS flag, l_linestatus AS status FROM lineitem""")
def steps(spark, sf):
    """A run's ordered steps: run_id, seq, part, component, quantity, flag, status."""
    w = Window.partitionBy("l_orderkey").orderBy(*_STEP.split(", "))
    l = table(spark, sf, "lineitem")
    return dealt(l, "l_orderkey", tasks_for(l)).select(
        F.col("l_orderkey").alias("run_id"), F.row_number().over(w).alias("seq"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("component"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"))


@view("""SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_size = 1 AS is_test, p_size AS complexity, p_type AS kind FROM part""")
def nodes(spark, sf):
    """Entities: id, name, file, is_test, complexity, kind."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), (F.col("p_size") == 1).alias("is_test"),
        F.col("p_size").alias("complexity"), F.col("p_type").alias("kind"))


_EDGE = f"lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_STEP})"


@view(f"""SELECT run_id, seq, src, dst, kind, awaited FROM (SELECT l_orderkey AS run_id,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY {_STEP}) AS seq, l_partkey AS src, {_EDGE} AS dst,
          CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'data_flow' ELSE 'control_flow' END AS kind,
          l_linestatus = 'F' AS awaited FROM lineitem) WHERE dst IS NOT NULL AND src <> dst""")
def edges(spark, sf):
    """Edges between the parts of an order in sequence: run_id, seq, src, dst, kind, awaited."""
    w = Window.partitionBy("l_orderkey").orderBy(*_STEP.split(", "))
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "data_flow").otherwise("control_flow")
    l = table(spark, sf, "lineitem")
    return dealt(l, "l_orderkey", tasks_for(l)).select(
        F.col("l_orderkey").alias("run_id"), F.row_number().over(w).alias("seq"), F.col("l_partkey").alias("src"),
        F.lead("l_partkey").over(w).alias("dst"), kind.alias("kind"), (F.col("l_linestatus") == "F").alias("awaited"),
    ).where("dst is not null and src <> dst")


@view("""SELECT user_id AS case_id, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank,
         event_type = 'purchase' AS relevant, value AS score, event_type AS kind, user_id % 4 AS grp FROM events""")
def ranked(spark, sf):
    """Ranked lists: case_id, item, rank, relevant, score, kind, grp."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("item"), F.row_number().over(w).alias("rank"),
        (F.col("event_type") == "purchase").alias("relevant"), F.col("value").alias("score"), F.col("event_type").alias("kind"),
        (F.col("user_id") % 4).alias("grp"))


@view("""SELECT user_id AS case_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank,
         lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_id, event_type = 'purchase' AS success,
         event_type AS failure_type, least(1.0, value / 100.0) AS score, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
         user_id % 4 AS grp, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 7 AS rule, event_id % 5 AS variant FROM events""")
def attempts(spark, sf):
    """Attempts in order: case_id, id, rank, parent_id, success, failure_type, score, k, grp, rule, variant."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("id"), F.row_number().over(w).alias("rank"),
        F.lag("event_id").over(w).alias("parent_id"), (F.col("event_type") == "purchase").alias("success"),
        F.col("event_type").alias("failure_type"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("score"), k.alias("k"),
        (F.col("user_id") % 4).alias("grp"), (k % 7).alias("rule"), (F.col("event_id") % 5).alias("variant"))


@view("""SELECT d.doc_id AS id, least(1.0, d.n_chars / 5000.0) AS confidence, l.quality = 1 AS hit, d.source AS grp, d.lang AS kind
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def conf(spark, sf):
    """Confidences and outcomes: id, confidence, hit, grp, kind."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("id"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("confidence"), (F.col("quality") == 1).alias("hit"),
        F.col("source").alias("grp"), F.col("lang").alias("kind"))


@view("""SELECT doc_id, source, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS line_no, unnest(lines) AS line
         FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)""")
def lines(spark, sf):
    """Lines of text: doc_id, source, line_no (from 1), line."""
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "line")).selectExpr("doc_id", "source", "at + 1 as line_no", "line")


@view("""SELECT CAST(year(o_orderdate) AS INTEGER) AS suite, o_orderpriority AS name, o_orderkey AS run_id, o_orderstatus = 'F' AS failed,
         o_orderstatus = 'O' AS passed, o_totalprice AS cost, o_custkey AS owner FROM orders""")
def suites(spark, sf):
    """Runs of yearly suites: suite, name, run_id, failed, passed, cost, owner."""
    return table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("suite"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("run_id"),
        (F.col("o_orderstatus") == "F").alias("failed"), (F.col("o_orderstatus") == "O").alias("passed"), F.col("o_totalprice").alias("cost"),
        F.col("o_custkey").alias("owner"))


_LOG = ["FAILED tests/test_{a}.py::test_{b} - AssertionError: got {q}", "tests/test_{a}.py::TestS::test_{b}[p-{q}] FAILED [ 50%]", "FAIL: test_{b} (pkg.mod{a}.Case.test_{b})",
        'File "/work/src/m{a}.py", line {q}, in fn_{b}', "src/m{a}.py:{q}: in fn_{b}", "E       assert {q} == {b}", "{q} passed, {b} failed, 1 skipped in 0.{a}s", "ERROR: test_x (broken)"]


def _log_sql(template: str) -> str:
    parts = template.replace("'", "''")
    for name, expr in (("{a}", "l_partkey % 12"), ("{b}", "l_suppkey % 9"), ("{q}", "CAST(l_quantity AS INTEGER)")):
        parts = parts.replace(name, f"' || {expr} || '")
    return f"'{parts}'"


@view(f"""SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_STEP}) AS line_no, CASE (l_partkey + l_linenumber) % 8
          {' '.join(f'WHEN {i} THEN {_log_sql(t)}' for i, t in enumerate(_LOG))} END AS text FROM lineitem""")
def logs(spark, sf):
    """Output lines of runs: run_id, line_no, text."""
    w = Window.partitionBy("l_orderkey").orderBy(*_STEP.split(", "))
    filled = F.get(F.array(*map(F.lit, _LOG)), ((F.col("l_partkey") + F.col("l_linenumber")) % 8).cast("int"))
    for name, expr in (("{a}", F.col("l_partkey") % 12), ("{b}", F.col("l_suppkey") % 9), ("{q}", F.col("l_quantity").cast("int"))):
        filled = F.replace(filled, F.lit(name), expr.cast("string"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.row_number().over(w).alias("line_no"), filled.alias("text"))


# Outputs that the failure classes tell apart.
OUTPUTS = ["all well", "Blocked by safety gate", "patch target does not exist", "SyntaxError: bad", "ModuleNotFoundError: No module named 'numpy'", "AttributeError: x", "TypeError: y", "AssertionError",
           "Traceback (most recent call last)", "fixture 'db' not found", "collected 0 items", "ERROR collecting tests/a.py", "error: usage: pytest", "No module named pytest", "DJANGO_SETTINGS_MODULE is not set",
           "PytestWarning: treated as error", "import file mismatch", "could not find python interpreter", "12 passed, 3 failed, 2 errors, 1 skipped in 1s", "Ran 9 tests in 0.1s", ""]


@view(f"""SELECT o_orderkey AS run_id, o_orderpriority AS case_id, [{', '.join("'" + o.replace("'", "''") + "'" for o in OUTPUTS)}][o_orderkey % {len(OUTPUTS)} + 1] AS output,
          o_orderstatus = 'O' AS success, o_custkey % 13 = 0 AS timeout, CAST(o_custkey % 3 - 1 AS INTEGER) AS returncode, CAST(o_custkey % 4 AS INTEGER) AS failed FROM orders""")
def outcomes(spark, sf):
    """Runs with their output: run_id, case_id, output, success, timeout, returncode, failed."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("case_id"), F.get(F.array(*map(F.lit, OUTPUTS)), (F.col("o_orderkey") % len(OUTPUTS)).cast("int")).alias("output"),
        (F.col("o_orderstatus") == "O").alias("success"), (F.col("o_custkey") % 13 == 0).alias("timeout"), (F.col("o_custkey") % 3 - 1).cast("int").alias("returncode"),
        (F.col("o_custkey") % 4).cast("int").alias("failed"))
