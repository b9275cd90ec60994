"""Graph queries over the parts that follow each other in orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import count_if, rounded
from ..operators import graph as G
from ..tables import VIEWS, table, tasks_for
from .base import query


def edges(spark, sf):
    return VIEWS["edges"](spark, sf)


def nodes(spark, sf):
    return VIEWS["nodes"](spark, sf)


_PATH = "'pkg' || (id % 3) || '/mod' || (id % 5) || '/f' || (id % 11) || '.py'"


def with_path(n):
    return n.withColumn("path", F.concat(F.lit("pkg"), F.col("id") % 3, F.lit("/mod"), F.col("id") % 5, F.lit("/f"), F.col("id") % 11, F.lit(".py")))


def _dist(a: str, b: str) -> str:
    """Of the three-part paths above."""
    return f"CASE WHEN {a} % 3 <> {b} % 3 THEN 4 WHEN {a} % 5 <> {b} % 5 THEN 2 ELSE 0 END"


def full_edges(spark, sf):
    e = G.with_ends(edges(spark, sf), with_path(nodes(spark, sf)), "file", "path", tasks=tasks_for(table(spark, sf, "lineitem")))
    return e.withColumn("distance", G.path_distance(F.col("src_path"), F.col("dst_path"))).withColumn("relative", F.col("seq") % 2 == 0)


FULL = f", x AS (SELECT e.*, a.file AS src_file, b.file AS dst_file, {_dist('src', 'dst')} AS distance, seq % 2 = 0 AS relative FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id)"


@query("""WITH ent AS (SELECT p_partkey AS id, p_brand AS file, p_name AS name, p_name || '@' || p_size AS qualified FROM part),
refs AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, 'Brand#' || (l_suppkey % 25 + 1) AS file, CASE WHEN l_suppkey % 2 = 0 THEN p_name ELSE p_name || '@' || p_size END AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey),
u1 AS (SELECT file, name, min(id) AS t FROM ent GROUP BY 1, 2 HAVING count(*) = 1), u2 AS (SELECT qualified AS name, min(id) AS t FROM ent GROUP BY 1 HAVING count(*) = 1),
u3 AS (SELECT name, min(id) AS t FROM ent GROUP BY 1 HAVING count(*) = 1)
SELECT CASE WHEN u1.t IS NOT NULL THEN 'same_file' WHEN u2.t IS NOT NULL THEN 'qualified' WHEN u3.t IS NOT NULL THEN 'simple_name' ELSE 'unresolved' END AS how,
count(*) AS refs, CAST(coalesce(sum(coalesce(u1.t, u2.t, u3.t)), 0) AS BIGINT) AS targets
FROM refs r LEFT JOIN u1 ON r.file = u1.file AND r.name = u1.name LEFT JOIN u2 ON r.name = u2.name LEFT JOIN u3 ON r.name = u3.name GROUP BY 1""")
def resolve_refs(spark, sf):
    part = table(spark, sf, "part")
    ent = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.concat("p_name", F.lit("@"), "p_size").alias("qualified"))
    names = ent.select(F.col("id").alias("l_partkey"), "name", "qualified")
    refs = table(spark, sf, "lineitem").join(names, "l_partkey").select(
        F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25 + 1).alias("file"), F.when(F.col("l_suppkey") % 2 == 0, F.col("name")).otherwise(F.col("qualified")).alias("name"))
    return G.resolve(refs, ent).groupBy("how").agg(F.count("*").alias("refs"), F.coalesce(F.sum("target"), F.lit(0)).cast("long").alias("targets"))


@query(" SELECT kind, count(*) AS n FROM (SELECT kind FROM edges UNION ALL SELECT 'awaits' FROM edges WHERE kind = 'calls' AND awaited) GROUP BY 1", "edges")
def edges_async(spark, sf):
    return G.async_edges(edges(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f" SELECT src, dst, 'module_depends_on' AS kind, {_dist('src', 'dst')} AS distance FROM edges WHERE kind = 'calls' AND (src % 3 <> dst % 3 OR src % 5 <> dst % 5 OR src % 11 <> dst % 11)", "edges")
def edges_cross_file(spark, sf):
    return G.cross_file_edges(edges(spark, sf), with_path(nodes(spark, sf)))


@query(" SELECT e.dst AS src, e.src AS dst, 'tested_by' AS kind FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE e.kind = 'calls' AND a.is_test AND NOT b.is_test", "nodes", "edges")
def edges_tests(spark, sf):
    return G.test_edges(edges(spark, sf), nodes(spark, sf))


@query("""SELECT 'contains_class' AS kind, count(*) AS n, count(DISTINCT p_brand) AS sources FROM (SELECT DISTINCT p_brand, p_type FROM part)
UNION ALL SELECT 'contains_function', count(*), count(DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand || p_type ELSE p_brand END) FROM part
UNION ALL SELECT 'imports', count(*), count(DISTINCT p_brand) FROM (SELECT DISTINCT p_brand, p_name FROM part)""")
def edges_contain(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "file")
    cls = F.concat("file", "p_type")
    e = G.containment(
        p.select("file").distinct(), p.select("file", cls.alias("id")).distinct(),
        p.select("file", F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 2 == 0, cls).alias("class")), p.select("file", F.col("p_name").alias("module")).distinct())
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


@query("""WITH c AS (SELECT l_orderkey AS call, l_partkey AS target, 'a' || l_suppkey % 10 AS a0, 'b' || l_linenumber AS a1 FROM lineitem),
f AS (SELECT p_partkey AS target, p_size % 2 = 0 AS method FROM part), j AS (SELECT c.* FROM c JOIN f USING (target))
SELECT kind, src, dst, count(*) AS n FROM (SELECT 'argument_flows_to_parameter' AS kind, a0 AS src, 'x' AS dst FROM j UNION ALL SELECT 'argument_flows_to_parameter', a1, 'y' FROM j
UNION ALL SELECT 'return_flows_to_var', 'return:' || target, 'r' FROM c) GROUP BY ALL""")
def edges_args(spark, sf):
    calls = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("call"), F.col("l_partkey").alias("target"),
        F.array(F.array(F.concat(F.lit("a"), F.col("l_suppkey") % 10)), F.array(F.concat(F.lit("b"), F.col("l_linenumber")))).alias("args"), F.array(F.lit("r")).alias("assigned"))
    params = F.when(F.col("p_size") % 2 == 0, F.array(*map(F.lit, ("self", "x", "y")))).otherwise(F.array(*map(F.lit, ("x", "y"))))
    functions = table(spark, sf, "part").select(F.col("p_partkey").alias("target"), params.alias("params"))
    return G.argument_edges(calls, functions).groupBy("kind", "src", "dst").agg(F.count("*").alias("n"))


DEGREE = ", d AS (SELECT id, count(*) AS degree, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1)"


@query(DEGREE + " SELECT * FROM d", "edges")
def degree(spark, sf):
    return G.degree(edges(spark, sf))


@query(DEGREE + " SELECT id, file, round(degree / max(degree) OVER (PARTITION BY file), 6) AS normalised FROM d JOIN nodes USING (id)", "edges", "nodes")
def normalise_max(spark, sf):
    d = G.degree(edges(spark, sf)).join(nodes(spark, sf), "id")
    return G.normalised(d, "degree", ["file"]).select("id", "file", rounded("normalised").alias("normalised"))


@query(" SELECT id, count(*) FILTER (kind = 'data_flow') AS data, count(*) FILTER (kind = 'control_flow') AS control FROM (SELECT src AS id, kind FROM edges UNION ALL SELECT dst, kind FROM edges) WHERE kind <> 'calls' GROUP BY 1", "edges")
def flow_degree(spark, sf):
    e = edges(spark, sf)
    d = G.flow_degree(e, ["data_flow"]).withColumnRenamed("flow", "data")
    c = G.flow_degree(e, ["control_flow"]).withColumnRenamed("flow", "control")
    return d.join(c, "id", "full").select("id", F.coalesce("data", F.lit(0)).alias("data"), F.coalesce("control", F.lit(0)).alias("control"))


def tests(spark, sf):
    """Test parts in a failed order."""
    failed = VIEWS["runs"](spark, sf).where("failed").select("run_id")
    used = VIEWS["cov"](spark, sf).join(failed, "run_id", "left_semi").select(F.col("element").alias("id")).distinct()
    return used.join(nodes(spark, sf).where("is_test").select("id"), "id", "left_semi")


_TESTS = ", t AS (SELECT DISTINCT element AS id FROM cov WHERE run_id IN (SELECT run_id FROM runs WHERE failed) AND element IN (SELECT id FROM nodes WHERE is_test))"
_ARCS = ", arcs AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls')"


def levels(start: str, arcs: str, depth: int, keys: str = "source", extra: str = "") -> str:
    """SQL of a walk, a table a step: l0 is ``start`` ({keys}, id, distance), ``reached`` all steps."""
    lead = f"{keys}, " if keys else ""
    own = f"f.{keys}, " if keys else ""
    same = f"s.{keys} = f.{keys} AND " if keys else ""
    out = [f"l0 AS MATERIALIZED (SELECT DISTINCT {lead}id, 0 AS distance FROM ({start})), s0 AS MATERIALIZED (SELECT * FROM l0)"]
    for d in range(1, depth + 1):
        out.append(f"l{d} AS MATERIALIZED (SELECT DISTINCT {own}x.dst AS id, {d} AS distance FROM l{d - 1} f JOIN {arcs} x ON f.id = x.src WHERE NOT EXISTS (SELECT 1 FROM s{d - 1} s WHERE {same}s.id = x.dst))")
        out.append(f"s{d} AS MATERIALIZED (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM l{d})")
    return ", " + ", ".join(out) + f", reached AS (SELECT * FROM s{depth})"


@query(_ARCS + levels("SELECT id AS source, id FROM nodes WHERE is_test", "arcs", 8) + " SELECT source, distance, count(*) AS reached FROM reached GROUP BY 1, 2", "edges", "nodes")
def bfs_distance(spark, sf):
    """From every test part along calls, to depth 8."""
    sources = nodes(spark, sf).where("is_test").select(F.col("id").alias("source"))
    return G.reach_counts(edges(spark, sf).where("kind = 'calls'"), sources)


def _path_levels(depth: int) -> str:
    """As levels, with the smallest of the shortest paths to each node."""
    out = ["p0 AS MATERIALIZED (SELECT DISTINCT source, source AS id, [source] AS path FROM pairs), q0 AS MATERIALIZED (SELECT * FROM p0)"]
    for d in range(1, depth + 1):
        out.append(f"""p{d} AS MATERIALIZED (SELECT f.source, x.dst AS id, min(list_append(f.path, x.dst)) AS path FROM p{d - 1} f JOIN both_ x ON f.id = x.src
          WHERE NOT EXISTS (SELECT 1 FROM q{d - 1} s WHERE s.source = f.source AND s.id = x.dst) GROUP BY 1, 2), q{d} AS MATERIALIZED (SELECT * FROM q{d - 1} UNION ALL SELECT * FROM p{d})""")
    return ", " + ", ".join(out)


@query(""", ends AS (SELECT run_id, arg_max(part, seq) AS target FROM steps WHERE run_id IN (SELECT run_id FROM runs WHERE failed) GROUP BY 1),
pairs AS MATERIALIZED (SELECT DISTINCT part AS source, target FROM steps JOIN ends USING (run_id) WHERE part IN (SELECT id FROM nodes WHERE is_test) AND part <> target), both_ AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges)"""
       + _path_levels(8) + " SELECT p.source, p.target, array_to_string(q.path, '>') AS path FROM pairs p JOIN q8 q ON p.source = q.source AND p.target = q.id", "runs", "steps", "edges", "nodes")
def bfs_path(spark, sf):
    """Shortest paths from test parts to the parts with which the failed orders end that they are in."""
    w = VIEWS["steps"](spark, sf).join(VIEWS["runs"](spark, sf).where("failed").select("run_id"), "run_id", "left_semi")
    last = w.groupBy("run_id").agg(F.max_by("part", "seq").alias("target"))
    starts = w.join(nodes(spark, sf).where("is_test").select(F.col("id").alias("part")), "part", "left_semi").select("run_id", F.col("part").alias("source"))
    pairs = starts.join(last, "run_id").where("source <> target").select("source", "target").distinct()
    return G.bfs_paths(edges(spark, sf), pairs, 8).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


_ALL_ARCS = ", arcs AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges)"
_NEAR = _TESTS + _ALL_ARCS + levels("SELECT id FROM t", "arcs", 8, "")


@query(_NEAR + " SELECT id, round(1.0 / (1 + distance), 6) AS proximity FROM reached", "runs", "cov", "edges", "nodes")
def proximity(spark, sf):
    """Of every part to the failing test parts."""
    return G.proximity(edges(spark, sf), tests(spark, sf)).select("id", rounded("proximity").alias("proximity"))


@query(_NEAR + """, c AS (SELECT DISTINCT element AS id FROM cov WHERE run_id IN (SELECT run_id FROM runs WHERE failed) AND run_id IN (SELECT run_id FROM cov WHERE element IN (SELECT id FROM t)))
SELECT coalesce(r.id, c.id) AS id, CASE WHEN c.id IS NOT NULL THEN 1.0 ELSE round(1.0 / (1 + distance), 6) END AS evidence FROM reached r FULL JOIN c ON r.id = c.id""", "runs", "cov", "edges", "nodes")
def dyn_evidence(spark, sf):
    """1 for parts in a failed order that has a test part, else the proximity."""
    near = G.proximity(edges(spark, sf), tests(spark, sf))
    cov = VIEWS["cov"](spark, sf)
    runs = cov.join(tests(spark, sf).withColumnRenamed("id", "element"), "element", "left_semi").select("run_id").distinct()
    failed = runs.join(VIEWS["runs"](spark, sf).where("failed").select("run_id"), "run_id", "left_semi")
    covered = cov.join(failed, "run_id", "left_semi").select(F.col("element").alias("id"))
    return G.dynamic_evidence(near, covered).select("id", rounded("evidence").alias("evidence"))


@query(""", c AS (SELECT src, dst, bool_or(awaited) AS aw FROM edges WHERE kind = 'calls' AND src IN (SELECT id FROM nodes WHERE NOT is_test) GROUP BY 1, 2),
h1 AS (SELECT dst AS target, src AS id, aw AS waits FROM c), 
h2 AS (SELECT target, c.src AS id, bool_or(waits OR aw) AS waits FROM h1 JOIN c ON h1.id = c.dst WHERE c.src <> target GROUP BY 1, 2),
n2 AS MATERIALIZED (SELECT * FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 s WHERE s.target = h2.target AND s.id = h2.id)),
h3 AS (SELECT target, c.src AS id, bool_or(waits OR aw) AS waits FROM n2 JOIN c ON n2.id = c.dst WHERE c.src <> target GROUP BY 1, 2),
n3 AS (SELECT * FROM h3 WHERE NOT EXISTS (SELECT 1 FROM h1 s WHERE s.target = h3.target AND s.id = h3.id) AND NOT EXISTS (SELECT 1 FROM n2 s WHERE s.target = h3.target AND s.id = h3.id)),
w AS (SELECT *, 1.0 AS f FROM h1 UNION ALL SELECT *, 0.5 FROM n2 UNION ALL SELECT *, 0.25 FROM n3)
SELECT target AS id, CAST(round(sum(f * (1 + CASE WHEN a.file <> b.file THEN 0.5 ELSE 0 END + CASE WHEN waits THEN 0.15 ELSE 0 END)), 6) AS DOUBLE) AS impact
FROM w JOIN nodes a ON w.id = a.id JOIN nodes b ON w.target = b.id GROUP BY target""", "edges", "nodes")
def caller_impact(spark, sf):
    return G.caller_impact(edges(spark, sf), nodes(spark, sf)).select("id", rounded("impact").alias("impact"))


def _rank_levels(rounds: int) -> str:
    out = ["r0 AS MATERIALIZED (SELECT id, outs, 1.0 / nn AS rank FROM base)"]
    for i in range(1, rounds + 1):
        out.append(f"""r{i} AS MATERIALIZED (SELECT b.id, b.outs, 0.15 / nn + 0.85 * (coalesce(got, 0) + mass / nn) AS rank FROM base b
          LEFT JOIN (SELECT dst AS id, sum(rank / outs) AS got FROM arcs JOIN r{i - 1} p ON arcs.src = p.id GROUP BY 1) g ON b.id = g.id, (SELECT coalesce(sum(rank), 0) AS mass FROM r{i - 1} WHERE outs IS NULL))""")
    return ", " + ", ".join(out)


@query(""", arcs AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
base AS MATERIALIZED (SELECT n.id, o.outs, count(*) OVER ()::DOUBLE AS nn FROM (SELECT DISTINCT id FROM nodes) n LEFT JOIN (SELECT src AS id, count(*) AS outs FROM arcs GROUP BY 1) o USING (id))"""
       + _rank_levels(30) + " SELECT id, round(rank, 9) AS rank FROM r30", "edges", "nodes")
def pagerank(spark, sf):
    return G.pagerank(edges(spark, sf), nodes(spark, sf)).select("id", F.round("rank", 9).alias("rank"))


@query(FULL + """ SELECT id, CAST(round(sum(s), 6) AS DOUBLE) AS score FROM (SELECT dst AS id, 1.5 + least(0.1 * distance, 0.4) + CASE WHEN relative THEN 0.15 ELSE 0 END AS s FROM x WHERE kind = 'calls'
UNION ALL SELECT src, 0.5 FROM x WHERE kind = 'calls') GROUP BY 1""", "edges", "nodes")
def module_score(spark, sf):
    return G.module_score(full_edges(spark, sf).where("kind = 'calls'")).select("id", rounded("score").alias("score"))


@query(FULL + """ SELECT id, CAST(round(sum(s), 6) AS DOUBLE) AS score FROM (SELECT dst AS id, 1.0 + CASE WHEN src_file <> dst_file THEN 0.5 ELSE 0 END AS s FROM x WHERE awaited
UNION ALL SELECT src, 0.25 FROM x WHERE awaited) GROUP BY 1""", "edges", "nodes")
def async_score(spark, sf):
    return G.async_score(full_edges(spark, sf).where("awaited")).select("id", rounded("score").alias("score"))


@query(""", b AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT DISTINCT dst, src FROM edges), t AS (SELECT id AS target FROM nodes WHERE is_test),
s1 AS (SELECT target, target AS id FROM t UNION SELECT target, b FROM t JOIN b ON target = a), s AS MATERIALIZED (SELECT * FROM s1 UNION SELECT s1.target, b.b FROM s1 JOIN b ON s1.id = b.a),
i AS (SELECT s.target, e.kind FROM edges e JOIN s ON e.src = s.id JOIN s s2 ON e.dst = s2.id AND s2.target = s.target),
e AS (SELECT target, count(*) AS edges, count(*) FILTER (kind = 'calls') AS calls, count(*) FILTER (kind = 'data_flow') AS data_flow, count(*) FILTER (kind = 'control_flow') AS control_flow FROM i GROUP BY 1)
SELECT n.target, n.nodes, coalesce(edges, 0) AS edges, coalesce(calls, 0) AS calls, coalesce(data_flow, 0) AS data_flow, coalesce(control_flow, 0) AS control_flow
FROM (SELECT target, count(*) AS nodes FROM s GROUP BY 1) n LEFT JOIN e USING (target)""", "edges", "nodes")
def slice_khop(spark, sf):
    """Depth 2 around every test part."""
    return G.slice_summary(edges(spark, sf), nodes(spark, sf).where("is_test").select(F.col("id").alias("target")))


def _listed(condition: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT other) FILTER ({condition})), ','), '')"


@query(f""", t AS (SELECT id AS target FROM nodes WHERE is_test), u AS (SELECT target, src AS other, kind, 'in' AS way FROM edges JOIN t ON dst = target UNION ALL SELECT target, dst, kind, 'out' FROM edges JOIN t ON src = target)
SELECT target, {_listed("way = 'in' AND kind = 'calls'")} AS callers, {_listed("way = 'out' AND kind = 'calls'")} AS callees, {_listed("kind = 'data_flow'")} AS data FROM u GROUP BY 1""", "edges", "nodes")
def slice_lists(spark, sf):
    lists = G.neighbour_lists(edges(spark, sf), nodes(spark, sf).where("is_test").select(F.col("id").alias("target")))
    return lists.select("target", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("callers", "callees", "data")])


_GROUND = """, s AS (SELECT e.src AS id, bool_or(b.is_test) AS tested, count(DISTINCT e.dst) >= 2 AS chain, count(*) FILTER (e.kind = 'data_flow') AS data,
count(*) FILTER (e.kind = 'control_flow') AS control, count(*) FILTER (e.awaited) AS cfg, bool_or(a.file <> b.file) AS boundary FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id GROUP BY 1),
g AS (SELECT *, 0.35 * CASE WHEN tested THEN 1 ELSE 0 END + 0.20 * CASE WHEN chain THEN 1 ELSE 0 END + 0.20 * least(1.0, data / 3.0)
+ 0.15 * greatest(least(1.0, control / 1.0), least(1.0, cfg / 2.0)) + 0.10 * CASE WHEN boundary THEN 1 ELSE 0 END AS support FROM s)"""


@query(_GROUND + """ SELECT id, round(support, 6) AS support, round(support, 9) >= 0.5 AS grounded, concat_ws(',', CASE WHEN tested THEN 'failed_test_support' END, CASE WHEN chain THEN 'call_chain_supported' END,
CASE WHEN data > 0 THEN 'data_flow_supported' END, CASE WHEN control > 0 OR cfg > 0 THEN 'control_or_cfg_supported' END, CASE WHEN boundary THEN 'cross_boundary_supported' END) AS reasons,
CAST(tested AS INTEGER) + CAST(chain AS INTEGER) + CASE WHEN data > 0 THEN 1 ELSE 0 END + CASE WHEN control > 0 OR cfg > 0 THEN 1 ELSE 0 END + CAST(boundary AS INTEGER) AS dimensions FROM g""", "edges", "nodes")
def slice_grounding(spark, sf):
    e = G.with_ends(edges(spark, sf), nodes(spark, sf), "file", "is_test")
    s = e.groupBy(F.col("src").alias("id")).agg(
        F.bool_or("dst_is_test").alias("tested"), (F.countDistinct("dst") >= 2).alias("chain"), count_if(F.col("kind") == "data_flow").alias("data"),
        count_if(F.col("kind") == "control_flow").alias("control"), count_if("awaited").alias("cfg"), F.bool_or(F.col("src_file") != F.col("dst_file")).alias("boundary"))
    s = s.withColumn("support", G.grounding()).withColumn("reasons", G.grounding_reasons())
    return s.select("id", rounded("support").alias("support"), (F.round("support", 9) >= 0.5).alias("grounded"), F.array_join("reasons", ",").alias("reasons"), F.size("reasons").alias("dimensions"))


@query(""" SELECT e.dst AS id, count(DISTINCT e.src) AS callers, count(DISTINCT CASE WHEN a.file <> b.file THEN e.src END) AS cross_file
FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE e.kind = 'calls' AND NOT a.is_test GROUP BY 1""", "edges", "nodes")
def callers(spark, sf):
    return G.callers(edges(spark, sf), nodes(spark, sf))


@query(""", e AS MATERIALIZED (SELECT * FROM edges WHERE kind IN ('data_flow', 'control_flow')), a AS MATERIALIZED (SELECT DISTINCT src, dst FROM e), c AS (SELECT id AS source FROM nodes WHERE is_test)"""
       + levels("SELECT source, source AS id FROM c", "a", 16) + """, t AS (SELECT source, dst AS id, kind FROM c JOIN e ON source = src UNION ALL SELECT source, src, kind FROM c JOIN e ON source = dst),
n AS (SELECT source, count(*) AS n FROM (SELECT source, id FROM reached UNION SELECT source, id FROM t) WHERE id <> source GROUP BY 1), k AS (SELECT source, count(*) AS k FROM t WHERE kind = 'control_flow' GROUP BY 1)
SELECT source, coalesce(n, 0) + coalesce(k, 0) AS fanout FROM c LEFT JOIN n USING (source) LEFT JOIN k USING (source)""", "edges", "nodes")
def dep_fanout(spark, sf):
    """Of every test part, along data and control edges as far as they go."""
    return G.dependency_fanout(edges(spark, sf), nodes(spark, sf).where("is_test").select(F.col("id").alias("source")))


@query(FULL + """, st AS (SELECT run_id, arg_min(part, seq) AS f, arg_max(part, seq) AS l FROM steps WHERE run_id IN (SELECT run_id FROM runs WHERE failed) GROUP BY 1),
p AS MATERIALIZED (SELECT DISTINCT least(f, l) AS a, greatest(f, l) AS b FROM st WHERE f <> l), y AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, kind, distance FROM x),
g AS (SELECT p.a, p.b, count(*) FILTER (kind = 'calls') AS calls, count(*) FILTER (kind = 'data_flow') AS data_flow, count(*) FILTER (kind = 'control_flow') AS control_flow,
  CAST(coalesce(sum(distance), 0) AS BIGINT) AS distance, coalesce(max(distance), 0) AS max_distance FROM p LEFT JOIN y ON p.a = y.a AND p.b = y.b GROUP BY 1, 2),
arcs AS MATERIALIZED (SELECT DISTINCT src, dst FROM x WHERE kind = 'calls'), m AS (SELECT DISTINCT unnest([a, b]) AS source FROM p)""" + levels("SELECT source, source AS id FROM m", "arcs", 4) + """,
w AS (SELECT p.a, p.b, min(distance) AS hops FROM p JOIN reached r ON (r.source = p.a AND r.id = p.b) OR (r.source = p.b AND r.id = p.a) GROUP BY 1, 2)
SELECT g.*, hops, hops IS NOT NULL AS connected, CAST(round(least(0.20, 0.08 * least(calls, 1) + 0.06 * least(data_flow, 1) + 0.04 * least(control_flow, 1) + CASE WHEN hops IS NULL THEN 0 ELSE 0.04 END), 6) AS DOUBLE) AS bonus
FROM g LEFT JOIN w ON g.a = w.a AND g.b = w.b""", "runs", "steps", "edges", "nodes")
def bundle_graph(spark, sf):
    """The first and the last part of each failed order as a pair."""
    w = VIEWS["steps"](spark, sf).join(VIEWS["runs"](spark, sf).where("failed").select("run_id"), "run_id", "left_semi")
    ends = w.groupBy("run_id").agg(F.min_by("part", "seq").alias("f"), F.max_by("part", "seq").alias("l")).where("f <> l")
    pairs = ends.select(F.least("f", "l").alias("a"), F.greatest("f", "l").alias("b")).distinct()
    return G.pair_links(pairs, full_edges(spark, sf)).withColumn("bonus", rounded("bonus"))


@query(FULL + """, m AS (SELECT src, dst, max(CASE WHEN src_file <> dst_file THEN 1 ELSE 0 END) AS c, max(CASE WHEN relative THEN 1 ELSE 0 END) AS rel, max(distance) AS distance,
  list_sort(list(DISTINCT kind)) AS kinds FROM x GROUP BY 1, 2),
u AS (SELECT id, way, other, c, rel, distance, kinds, unnest(kinds) AS kind FROM (SELECT src AS id, 'out' AS way, dst AS other, * FROM m UNION ALL SELECT dst, 'in', src, * FROM m))
SELECT id, way, kind, other, c AS cross, rel AS relative, distance, array_to_string(kinds, ',') AS kinds,
  CAST(row_number() OVER (PARTITION BY id, way, kind ORDER BY c DESC, rel DESC, distance DESC, len(kinds) DESC, other) AS INTEGER) AS rank FROM u QUALIFY rank <= 4""", "edges", "nodes")
def neighbours_top(spark, sf):
    return G.top_neighbours(full_edges(spark, sf), tasks=tasks_for(table(spark, sf, "lineitem"))).withColumn("kinds", F.array_join("kinds", ","))


@query(""", x AS (SELECT a.file AS s, b.file AS d FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE a.file <> b.file),
l AS (SELECT file, sum(v) AS links FROM (SELECT s AS file, 1.0 AS v FROM x UNION ALL SELECT d, 2.0 FROM x) GROUP BY 1)
SELECT n.file, CAST(round(0.5 * count(*) + 0.25 * max(complexity) + coalesce(max(links), 0), 6) AS DOUBLE) AS score FROM nodes n LEFT JOIN l ON n.file = l.file GROUP BY n.file""", "edges", "nodes")
def node_rank(spark, sf):
    return G.node_rank(nodes(spark, sf), edges(spark, sf)).withColumn("score", rounded("score"))


@query(""", e AS (SELECT file, count(*) FILTER (e.kind = 'calls') AS calls, count(*) FILTER (e.kind = 'data_flow') AS data_flow, count(*) FILTER (e.kind = 'control_flow') AS control_flow
  FROM edges e JOIN nodes n ON e.src = n.id GROUP BY 1)
SELECT n.file, count(*) AS nodes, count(*) FILTER (is_test) AS tests, coalesce(max(calls), 0) AS calls, coalesce(max(data_flow), 0) AS data_flow, coalesce(max(control_flow), 0) AS control_flow
FROM nodes n LEFT JOIN e ON n.file = e.file GROUP BY n.file""", "edges", "nodes")
def graph_summary(spark, sf):
    return G.graph_summary(nodes(spark, sf), edges(spark, sf))


@query(FULL + """ SELECT src AS id, count(*) FILTER (src_file = dst_file) AS local, count(*) FILTER (src_file <> dst_file) AS crossing,
array_to_string(list_slice(list_sort(list(DISTINCT dst)), 1, 3), ',') AS examples FROM x WHERE kind = 'data_flow' GROUP BY 1""", "edges", "nodes")
def flow_evidence(spark, sf):
    return G.flow_evidence(full_edges(spark, sf)).withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))
