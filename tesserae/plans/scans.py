"""Scan and inventory queries. Manifests are JSON files that Spark writes from the given tables and scans again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import count_if, rounded
from ..sources import manifests as S
from ..sources.storage import new_folder, sink, written
from ..tables import VIEWS, table
from .base import query


@query("""SELECT o_orderkey AS name, count(l_orderkey) AS tests, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS failing, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS metadata
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus""")
def scan_cases(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.col("l_partkey").cast("string")).alias("all_tests"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string"))).alias("failing_tests"))
    meta = F.when(F.col("o_orderstatus") != "P", F.create_map(F.lit("status"), F.col("o_orderstatus")))
    case = F.struct(F.col("o_orderkey").alias("name"), F.col("all_tests").alias("tests"), "failing_tests", meta.alias("metadata"))
    manifests = table(spark, sf, "orders").join(l, "o_orderkey", "left").select(F.array(case).alias("cases"))
    case = "name long, tests array<string>, failing_tests array<string>, metadata map<string,string>"
    return S.read_cases(spark, written(manifests, "cases"), case, multi_line=False).select("name", F.size("tests").cast("long").alias("tests"), F.size("failing_tests").cast("long").alias("failing"), F.size("metadata").alias("metadata"))


@query("""SELECT c_custkey AS suite, n AS "at", CASE WHEN n % 2 = 0 THEN 'seg_' || c_mktsegment ELSE 'run_' || (n + 1) END AS name, CASE WHEN n = 1 THEN 'own' ELSE c_mktsegment END AS level, CAST(c_nationkey AS VARCHAR) AS region
FROM customer, (SELECT unnest([0, 1, 2]) AS n)""")
def scan_runs_defaults(spark, sf):
    c = table(spark, sf, "customer")
    named = F.create_map(F.lit("name"), F.concat(F.lit("seg_"), "c_mktsegment"))
    runs = F.array(named, F.create_map(F.lit("level"), F.lit("own")), named)
    s = c.select(F.col("c_custkey").alias("suite"), F.create_map(F.lit("level"), "c_mktsegment", F.lit("region"), F.col("c_nationkey").cast("string")).alias("defaults"), runs.alias("runs"))
    suites = S.read_manifests(spark, written(s, "suites"), "suite long, defaults map<string,string>, runs array<map<string,string>>", multi_line=False)
    r = S.runs_with_defaults(suites.where("manifest_reason = ''"))
    return r.select("suite", "at", "name", F.col("settings")["level"].alias("level"), F.col("settings")["region"].alias("region"))


_INV = """f AS (SELECT p_brand AS repo, 'src/' || replace(p_name, ' ', '/') || p_size || CASE WHEN p_partkey % 5 = 0 THEN '.txt' ELSE '.py' END AS path, CASE WHEN p_partkey % 9 = 0 THEN 'tree' ELSE 'blob' END AS kind, CAST(p_size AS BIGINT) AS size, 'tree' AS origin FROM part
UNION ALL SELECT 's' || s_nationkey, 'tests/test_' || s_suppkey || '.py', 'blob', s_suppkey, 'items' FROM supplier
UNION ALL SELECT 'c' || c_nationkey, CASE c_custkey % 4 WHEN 0 THEN '/abs/x.py' WHEN 1 THEN 'vendor/y.py' WHEN 2 THEN 'a/../b.py' ELSE 'pkg/__init__.py' END, NULL, NULL, 'files' FROM customer
UNION ALL SELECT CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END, unnest(['docs/conf.py', 'lib/' || n_name || '.py']), NULL, NULL, 'repositories' FROM nation)"""


def inventory(spark, sf):
    ext = F.when(F.col("p_partkey") % 5 == 0, ".txt").otherwise(".py")
    path = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), "p_size", ext)
    entry = F.struct(path.alias("path"), F.when(F.col("p_partkey") % 9 == 0, "tree").otherwise("blob").alias("type"), F.col("p_size").cast("long").alias("size"))
    trees = table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.array(entry).alias("tree"))
    items = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_nationkey").alias("repo"), F.concat(F.lit("tests/test_"), "s_suppkey", F.lit(".py")).alias("path"), F.col("s_suppkey").alias("size"))
    odd = F.get(F.array(*map(F.lit, ("/abs/x.py", "vendor/y.py", "a/../b.py", "pkg/__init__.py"))), (F.col("c_custkey") % 4).cast("int"))
    files = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("repo"), odd.alias("path"))
    repos = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("repo"), F.array(F.lit("docs/conf.py"), F.concat(F.lit("lib/"), "n_name", F.lit(".py"))).alias("paths"))
    shapes = {
        "tree": (trees, "repo string, tree array<struct<path: string, type: string, size: long>>"), "items": (items, "repo string, path string, size long"),
        "files": (files, "repo string, path string"), "repositories": (repos, "repo string, paths array<string>")}
    read = [S.read_manifests(spark, written(rows, name), schema, multi_line=False).where("manifest_reason = ''") for name, (rows, schema) in shapes.items()]
    return S.flatten_inventory(*read)


@query(f"WITH {_INV} SELECT origin, repo, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS size FROM f GROUP BY 1, 2")
def inventory_flatten(spark, sf):
    return inventory(spark, sf).groupBy("origin", "repo").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


_REASON = """r AS (SELECT *, CASE WHEN path IS NULL OR path = '' OR starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') THEN 'missing_or_unsafe_source_path' WHEN coalesce(kind, 'blob') <> 'blob' THEN 'not_blob'
WHEN NOT ends_with(path, '.py') THEN 'not_included' WHEN regexp_matches(path, '(^|/)(vendor|build)/') THEN 'excluded' WHEN coalesce(repo, '') = '' THEN 'missing_owner_repo_ref' ELSE '' END AS reason FROM f)"""


@query(f"WITH {_INV}, {_REASON} SELECT origin, reason, count(*) AS files FROM r GROUP BY 1, 2")
def filter_reasons(spark, sf):
    return S.with_reasons(inventory(spark, sf)).groupBy("origin", "reason").agg(F.count("*").alias("files"))


@query("""WITH t AS (SELECT p_brand AS repo, p_partkey AS id, 'src/' || replace(p_name, ' ', '_') || '.py' AS target FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY repo, target ORDER BY id) AS n FROM t)
SELECT repo, id, CASE WHEN n = 1 THEN target ELSE replace(target, '.py', '_' || n || '.py') END AS unique_target FROM n""")
def dedupe_names(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("id"), F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py")).alias("target"))
    return S.collision_free(t, "repo", "target", ["id"]).select("repo", "id", "unique_target")


@query(" SELECT case_id, CAST(rank AS INTEGER) AS rank, id, success FROM attempts", "attempts")
def unnest_attempts(spark, sf):
    a = VIEWS["attempts"](spark, sf)
    nested = a.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "success"))), lambda x: F.struct(x["id"].alias("id"), x["success"].alias("success"))).alias("results"))
    return S.unnest_attempts(nested, "results", "case_id")


@query(f"""WITH {_INV}, {_REASON}, s AS (SELECT repo, count(*) AS files, CAST(sum(CASE WHEN reason = '' THEN 1 ELSE 0 END) AS BIGINT) AS imported, CAST(sum(CASE WHEN regexp_matches(path, '(^|/)tests?/|(^|/)test_') THEN 1 ELSE 0 END) AS BIGINT) AS tests,
  CAST(sum(CASE WHEN regexp_matches(path, '(^|/)__init__[.]py$') THEN 1 ELSE 0 END) AS BIGINT) AS packages FROM r GROUP BY 1),
d AS (SELECT repo, split_part(path, '/', 1) AS folder, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT repo, folder, n FROM d QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, folder) <= 10)
SELECT s.*, string_agg(folder || ':' || n, ',' ORDER BY n DESC, folder) AS folders, round(imported / greatest(1, files), 6) AS source_ratio FROM s JOIN t USING (repo) GROUP BY ALL""")
def repo_profile(spark, sf):
    p = S.repo_profile(S.with_reasons(inventory(spark, sf)).withColumn("path", F.regexp_replace("path", "^/", "/")))
    return p.select("repo", "files", "imported", "tests", "packages", F.array_join("folders", ",").alias("folders"), rounded("source_ratio").alias("source_ratio"))


@query("""WITH p AS (SELECT DISTINCT s_nationkey AS repo, CASE s_suppkey % 4 WHEN 0 THEN 'tests' WHEN 1 THEN 'core' WHEN 2 THEN 'core' ELSE 'lib' || s_suppkey % 2 END AS root, s_suppkey % 7 = 0 AS src_layout FROM supplier),
g AS (SELECT repo, list(DISTINCT root) FILTER (src_layout) AS s, list(DISTINCT root) FILTER (NOT src_layout AND root <> 'tests') AS r FROM p GROUP BY 1)
SELECT repo, CASE WHEN len(s) = 1 THEN 'src/' || s[1] WHEN len(r) = 1 THEN r[1] ELSE '' END AS prefix FROM g""")
def prefix_pick(spark, sf):
    k = F.col("s_suppkey")
    root = F.when(k % 4 == 0, "tests").when((k % 4 == 1) | (k % 4 == 2), "core").otherwise(F.concat(F.lit("lib"), k % 2))
    return S.prefix_pick(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("repo"), root.alias("root"), (k % 7 == 0).alias("src_layout")).distinct())


@query(" SELECT suite, name, count(*) AS runs, count(*) FILTER (failed) AS failed FROM suites GROUP BY 1, 2", "suites")
def result_sink(spark, sf):
    """Failures by suite and name, written as Parquet and as JSON in a folder a suite, and read back from the JSON."""
    result = VIEWS["suites"](spark, sf).groupBy("suite", "name").agg(F.count("*").alias("runs"), count_if("failed").alias("failed"))
    folder = new_folder(spark, "result")
    sink(result, f"{folder}/parquet")
    kept = spark.read.parquet(f"{folder}/parquet")
    sink(kept, f"{folder}/json", "json", ["suite"])
    return spark.read.schema("name string, runs long, failed long, suite int").json(f"{folder}/json").select("suite", "name", "runs", "failed")
