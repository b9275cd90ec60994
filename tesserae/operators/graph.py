"""Graph tables: edges (src, dst, kind, awaited) and nodes (id, file, is_test).

Walks are loops over DataFrames. Each step joins a frontier with the edges,
drops what was seen and is stored below the session's checkpoint folder, so
that lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attach, count_if, share
from ..sources.storage import made, release_since, stored
from . import taskwalks
from .walks import bits_by_source, both_ends, ends, fanout_counts, reach_bits, reach_counts, shortest_paths, with_bits


def resolve(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """References with ``target`` and ``how``: the first strategy with a unique match wins.

    ``refs``: id, file, name; ``entities``: id, file, name, qualified. Strategies:
    the same file, the qualified name, the simple name everywhere; ``unresolved`` otherwise.
    """
    def unique(*keys: str) -> DataFrame:
        return entities.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("id").alias("_t")).where("_n = 1").drop("_n")

    r = refs.join(unique("file", "name").withColumnRenamed("_t", "t1"), ["file", "name"], "left")
    r = r.join(unique("qualified").select(F.col("qualified").alias("name"), F.col("_t").alias("t2")), "name", "left")
    r = r.join(unique("name").withColumnRenamed("_t", "t3"), "name", "left")
    how = F.when(F.col("t1").isNotNull(), "same_file").when(F.col("t2").isNotNull(), "qualified").when(F.col("t3").isNotNull(), "simple_name").otherwise("unresolved")
    return r.select(*refs.columns, F.coalesce("t1", "t2", "t3").alias("target"), how.alias("how"))


def async_edges(edges: DataFrame) -> DataFrame:
    """Edges and, for awaited calls, an ``awaits`` edge beside each."""
    return edges.unionByName(edges.where("kind = 'calls' and awaited").withColumn("kind", F.lit("awaits")))


def path_distance(a: Column, b: Column) -> Column:
    """Steps up from a's folder and down to b's."""
    x, y = (F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1) for p in (a, b))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                         lambda acc, s: F.struct((acc["n"] + (acc["on"] & s).cast("int")).alias("n"), (acc["on"] & s).alias("on")))["n"]
    return F.size(x) + F.size(y) - 2 * common


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str, tasks: int = 0) -> DataFrame:
    """Edges with the named columns of both ends as src_* and dst_*; dealt to so many ``tasks``, if not 0."""
    a = nodes.select(F.col("id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in columns])
    b = nodes.select(F.col("id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in columns])
    by = lambda rows, key: rows.repartition(tasks, key) if tasks else rows
    return by(by(edges, "src").join(by(a, "src"), "src"), "dst").join(by(b, "dst"), "dst")


def cross_file_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls between files, as module_depends_on with the distance of the folders (column path of nodes)."""
    e = with_ends(edges.where("kind = 'calls'"), nodes, "path").where("src_path <> dst_path")
    return e.select("src", "dst", F.lit("module_depends_on").alias("kind"), path_distance(F.col("src_path"), F.col("dst_path")).alias("distance"))


def test_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """tested_by edges: from what a test calls to the test; calls between tests give none."""
    e = with_ends(edges.where("kind = 'calls'"), nodes, "is_test").where("src_is_test and not dst_is_test")
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("tested_by").alias("kind"))


def containment(files: DataFrame, classes: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, kind): file to class, class to function or else file to function, file to import. Ids are text.

    files: file; classes: id, file; functions: id, file, class (null: none); imports: file, module.
    """
    known = files.select("file")
    c = classes.join(known, "file", "left_semi").select(F.col("file").alias("src"), F.col("id").alias("dst"), F.lit("contains_class").alias("kind"))
    f = functions.join(known, "file", "left_semi").select(F.coalesce("class", "file").alias("src"), F.col("id").alias("dst"), F.lit("contains_function").alias("kind"))
    i = imports.join(known, "file", "left_semi").select(F.col("file").alias("src"), F.col("module").alias("dst"), F.lit("imports").alias("kind"))
    return c.unionByName(f).unionByName(i)


def argument_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Flows from the i-th argument's names to the i-th parameter, and from the return to assigned names.

    calls: call, target, args (array of arrays of names), assigned (array); functions: target, params (self and cls don't count).
    """
    params = functions.select("target", F.posexplode(F.filter("params", lambda p: ~p.isin("self", "cls"))).alias("at", "param"))
    args = calls.select("call", "target", F.posexplode("args").alias("at", "names")).select("call", "target", "at", F.explode("names").alias("name"))
    flows = args.join(params, ["target", "at"]).select("call", F.col("name").alias("src"), F.col("param").alias("dst"), F.lit("argument_flows_to_parameter").alias("kind"))
    back = calls.select("call", F.concat(F.lit("return:"), F.col("target").cast("string")).alias("src"), F.explode("assigned").alias("dst"), F.lit("return_flows_to_var").alias("kind"))
    return flows.unionByName(back)


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree, incoming, outgoing) counting edges, not neighbours; a self-loop counts once in degree."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(1).alias("d")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), (F.col("src") != F.col("dst")).cast("int").alias("d")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("d").alias("degree"), F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def normalised(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rows with ``normalised``: value by the largest of the case, 0 if that is 0."""
    most = rows.groupBy(*by).agg(F.max(value).alias("_most"))
    return attach(rows, most, by).withColumn("normalised", share(value, "_most")).drop("_most")


def flow_degree(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, flow): edges of the kinds at either end, once each."""
    return degree(edges.where(F.col("kind").isin(*kinds))).select("id", F.col("degree").alias("flow"))


def bfs(edges: DataFrame, sources: DataFrame, depth: int = 8) -> DataFrame:
    """(source, id, distance): hops from each source along edges, up to ``depth``. ``sources``: source."""
    arcs = stored(edges.select("src", "dst").distinct(), "arcs")
    seen = stored(sources.select("source", F.col("source").alias("id"), F.lit(0).alias("distance")).distinct(), "seen")
    front = seen
    for d in range(1, depth + 1):
        step = front.join(arcs, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id")).distinct()
        front = stored(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("distance", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def bfs_paths(edges: DataFrame, pairs: DataFrame, depth: int = 8) -> DataFrame:
    """(source, target, path): a shortest path of each pair that has one, the smallest one in order of ids."""
    return pairs.join(shortest_paths(edges, pairs, depth), ["source", "target"])


def nearest(edges: DataFrame, sources: DataFrame, depth: int = 8) -> DataFrame:
    """(id, distance) to the nearest of all sources (column id), along edges: one walk for all of them."""
    arcs = stored(edges.select("src", "dst").distinct(), "arcs")
    seen = stored(sources.select("id").distinct().withColumn("distance", F.lit(0)), "seen")
    front = seen
    for d in range(1, depth + 1):
        step = front.join(arcs, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = stored(step.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def proximity(edges: DataFrame, tests: DataFrame, depth: int = 8) -> DataFrame:
    """(id, proximity): the highest 1 / (1 + hops) from a failing test."""
    return nearest(edges, tests, depth).select("id", (1.0 / (1 + F.col("distance"))).alias("proximity"))


def dynamic_evidence(near: DataFrame, covered: DataFrame) -> DataFrame:
    """(id, evidence): 1 where a failing evidence test covers it, else the proximity."""
    c = covered.select("id").distinct().withColumn("_c", F.lit(1.0))
    return near.join(c, "id", "full").select("id", F.greatest(F.coalesce("_c", F.lit(0.0)), F.coalesce("proximity", F.lit(0.0))).alias("evidence"))


def caller_lists(calls: DataFrame, most: int = 256) -> DataFrame:
    """(dst, ids, marks): what calls each node in the distinct ``calls`` (src, dst, mark), in lists of about ``most``, so that none is long."""
    sizes = calls.groupBy("dst").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("src"), F.ceil(F.col("_n") / most))
    lists = calls.join(sizes, "dst").groupBy("dst", part.alias("_part")).agg(F.collect_list(F.struct("src", "mark")).alias("x"))
    # plain arrays take less room than one of structs
    return lists.select("dst", F.col("x.src").alias("ids"), F.col("x.mark").alias("marks"))


def caller_impact(edges: DataFrame, nodes: DataFrame, depth: int = 3, task_rows: int = 1 << 19) -> DataFrame:
    """(id, impact): each transitive caller adds .5**(hops - 1), half more from another file, .15 more over an awaited path.

    Tests don't call. A caller counts at its first visit; of its ways there at
    that distance one over an awaited edge counts before others. Callers move
    in lists, and become pairs with their target in the task that counts them;
    a task gets about ``task_rows`` of them, so its memory doesn't grow with the tables.
    """
    begun = made()
    files = stored(nodes.select("file").distinct().withColumn("f", F.monotonically_increasing_id()), "files")
    entities = stored(nodes.join(files, "file", "left").select("id", F.coalesce("f", F.lit(-1)).alias("f"), "is_test"), "entities")
    # mark: the number of the caller's file (-1: none), and whether the edge is awaited
    calls = with_ends(edges.where("kind = 'calls'"), entities, "is_test", "f").where("not src_is_test").groupBy("src", "dst").agg(
        (2 * F.first("src_f") + F.coalesce(F.max(F.col("awaited").cast("int")), F.lit(0))).alias("mark"))
    lists = stored(caller_lists(stored(calls, "calls")), "callers")
    # rank: 4 for a hop, 2 without an awaited edge, 1 from another file; a pair's smallest is its first visit
    seen = stored(entities.select(F.col("id").alias("target"), "f", "id", F.lit(2).alias("rank")), "seen")
    for d in range(1, depth + 1):
        front = seen.where(F.shiftright("rank", 2) == d - 1).select("target", "f", F.col("id").alias("dst"), (F.col("rank").bitwiseAND(2) == 0).alias("waits"))
        step = front.join(lists, "dst").select("target", "f", "waits", F.lit(None).cast("int").alias("was"), "ids", "marks")
        step = stored(step.unionByName(seen.select("target", "f", F.lit(False).alias("waits"), F.col("rank").alias("was"), F.array("id").alias("ids"), F.array(F.lit(0).cast("long")).alias("marks"))), "step")
        tasks = (step.agg(F.sum(F.size("ids"))).first()[0] or 0) // task_rows + 1
        pairs = step.repartition(tasks, "target").select("target", "f", "waits", "was", F.posexplode("ids").alias("at", "id"), "marks").withColumn("mark", F.get("marks", F.col("at")))
        caller_f = F.shiftright("mark", 1)
        rank = F.lit(4 * d + 2) - 2 * (F.col("waits") | (F.col("mark").bitwiseAND(1) == 1)).cast("int") + ((caller_f >= 0) & (F.col("f") >= 0) & (caller_f != F.col("f"))).cast("int")
        pairs = pairs.select("target", "f", "id", F.coalesce("was", rank).alias("rank"))
        seen = pairs.groupBy("target", "f", "id").agg(F.min("rank").alias("rank"))
        if d < depth:
            seen = stored(seen, "seen")
    # in twentieths of the last hop's weight, so that sums are exact
    hops = F.shiftright("rank", 2)
    weight = F.expr(f"shiftleft(1L, {depth} - shiftright(rank, 2))") * (20 + 10 * F.col("rank").bitwiseAND(1) + 3 * (F.col("rank").bitwiseAND(2) == 0).cast("int"))
    out = stored(seen.where(hops > 0).groupBy("target").agg((F.sum(weight) * (0.05 * 0.5 ** (depth - 1))).alias("impact")).withColumnRenamed("target", "id"), "impact")
    release_since(begun, made()[-1])
    return out


def _given(arcs: pd.DataFrame, ranks: pd.DataFrame) -> pd.DataFrame:
    """(id, got): what the nodes of a block give to each node that their arcs lead to."""
    each = arcs["src"].map(pd.Series((ranks["rank"] / ranks["out"]).to_numpy(), ranks["id"]))
    return each.groupby(arcs["dst"]).sum().rename_axis("id").rename("got").reset_index()


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 30, block: int = 1 << 15) -> DataFrame:
    """(id, rank): distinct neighbours, uniform start, the mass of nodes without a way out spread over all.

    Arcs are dealt once, by blocks of about ``block`` sources that follow each
    other, and stay there for all rounds. A block adds up what it gives to a
    node, so a round moves a row for each node and block that leads to it, no
    row an arc.
    """
    begun = made()
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // block))
    places = stored(ids.repartitionByRange(parts, "id").withColumn("block", F.spark_partition_id()), "places")
    arcs = stored(edges.select("src", "dst").distinct(), "distinct-arcs")
    arcs = stored(arcs.join(places.withColumnRenamed("id", "src"), "src").join(places.select(F.col("id").alias("dst")), "dst", "left_semi"), "arcs")
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    ranks = stored(places.join(out, F.col("id") == F.col("src"), "left").select("id", "block", "out", F.lit(1.0 / n).alias("rank")), "ranks")
    fixed = [*begun, made()[-2]]
    held = arcs.repartition(parts, "block").persist()
    kind = f"id {places.schema['id'].dataType.simpleString()}, got double"
    for _ in range(rounds):
        sink = ranks.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("mass"))
        given = held.groupBy("block").cogroup(ranks.where("out is not null").groupBy("block")).applyInPandas(_given, kind).groupBy("id").agg(F.sum("got").alias("got"))
        mass = sink.head()["mass"]  # one number
        ranks = ranks.select("id", "block", "out").join(given, "id", "left").select(
            "id", "block", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + mass / n)).alias("rank"))
        ranks = stored(ranks, "ranks")
        release_since(fixed, made()[-1])
    held.unpersist()
    release_since(begun, made()[-1])
    return ranks.select("id", "rank")


def module_score(edges: DataFrame) -> DataFrame:
    """(id, score): incoming dependency 1.5 + up to .4 for distance + .15 if relative; outgoing .5."""
    came = edges.select(F.col("dst").alias("id"), (1.5 + F.least(0.1 * F.col("distance"), F.lit(0.4)) + 0.15 * F.col("relative").cast("int")).alias("s"))
    went = edges.select(F.col("src").alias("id"), F.lit(0.5).alias("s"))
    return came.unionByName(went).groupBy("id").agg(F.sum("s").alias("score"))


def async_score(edges: DataFrame) -> DataFrame:
    """(id, score): an incoming awaited call 1, half more across files; outgoing .25. ``edges`` has src_file and dst_file."""
    came = edges.select(F.col("dst").alias("id"), (1.0 + 0.5 * (F.col("src_file") != F.col("dst_file")).cast("int")).alias("s"))
    went = edges.select(F.col("src").alias("id"), F.lit(0.25).alias("s"))
    return came.unionByName(went).groupBy("id").agg(F.sum("s").alias("score"))


def slice_summary(edges: DataFrame, targets: DataFrame, depth: int = 2) -> DataFrame:
    """Per target: nodes within ``depth`` of it, taking edges both ways, edges among them, and edges by kind (calls, data_flow, control_flow).

    An edge is inside a target's slice if the target's bit is set at both of its ends.
    A block of targets is walked in a task, unless the graph has too many nodes for that.
    """
    begun = made()
    kinds = ("calls", "data_flow", "control_flow")
    sources = targets.select(F.col("target").alias("source"))
    code = F.lit(-1)
    for i, k in enumerate(kinds):
        code = F.when(F.col("kind") == k, i).otherwise(code)
    merged = stored(edges.where("src is not null and dst is not null").groupBy("src", "dst", "kind").agg(F.count("*").alias("times")), "merged")
    nodes, n = taskwalks.numbered(ends(merged, sources.select(F.col("source").alias("id"))))
    if n <= taskwalks.NODES:
        found = taskwalks.slice_counts(merged.select("src", "dst", code.cast("tinyint").alias("code"), F.col("times").cast("int").alias("times")), nodes, n, with_bits(sources), depth, kinds)
    else:
        ways = merged.select("src", "dst").unionByName(merged.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        near, placed = reach_bits(ways, sources, depth)
        inside = bits_by_source(both_ends(merged, near), placed, F.col("times"), "kind")
        e = inside.groupBy("source").agg(
            F.sum("n").alias("edges"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])
        found = bits_by_source(near, placed).withColumnRenamed("n", "nodes").join(e, "source", "left").na.fill(0, ["nodes", "edges", *kinds])
    out = stored(found.withColumnRenamed("source", "target"), "slices")
    release_since(begun, made()[-1])
    return out


def neighbour_lists(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: sorted distinct callers, callees and data neighbours."""
    t = targets.select("target")
    came = edges.join(t, F.col("dst") == F.col("target")).select("target", F.col("src").alias("other"), "kind", F.lit("in").alias("way"))
    went = edges.join(t, F.col("src") == F.col("target")).select("target", F.col("dst").alias("other"), "kind", F.lit("out").alias("way"))
    each = lambda w, k: F.array_sort(F.collect_set(F.when((F.col("way") == w) & (F.col("kind") == k), F.col("other"))))
    data = F.array_sort(F.collect_set(F.when(F.col("kind") == "data_flow", F.col("other"))))
    return came.unionByName(went).groupBy("target").agg(each("in", "calls").alias("callers"), each("out", "calls").alias("callees"), data.alias("data"))


def grounding() -> Column:
    """Slice grounding from tested, chain, data, control, cfg and boundary columns."""
    one = lambda c, most: F.least(F.lit(1.0), F.col(c) / most)
    return (0.35 * F.col("tested").cast("int") + 0.20 * F.col("chain").cast("int") + 0.20 * one("data", 3.0)
            + 0.15 * F.greatest(one("control", 1.0), one("cfg", 2.0)) + 0.10 * F.col("boundary").cast("int"))


#: What each kind of support is called.
GROUNDS = ("failed_test_support", "call_chain_supported", "data_flow_supported", "control_or_cfg_supported", "cross_boundary_supported")


def grounding_reasons() -> Column:
    """The names of the kinds of support that a slice has, from the same columns as its grounding."""
    has = (F.col("tested"), F.col("chain"), F.col("data") > 0, (F.col("control") > 0) | (F.col("cfg") > 0), F.col("boundary"))
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in zip(has, GROUNDS, strict=True)]), lambda x: x.isNotNull())


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, callers, cross_file): distinct callers that aren't tests, and those in another file."""
    e = with_ends(edges.where("kind = 'calls'"), nodes, "file", "is_test").where("not src_is_test")
    return e.groupBy(F.col("dst").alias("id")).agg(
        F.countDistinct("src").alias("callers"), F.countDistinct(F.when(F.col("src_file") != F.col("dst_file"), F.col("src"))).alias("cross_file"))


def dependency_fanout(edges: DataFrame, changed: DataFrame, key_flow: str = "control_flow", depth: int | None = None) -> DataFrame:
    """(source, fanout): what a change of each source touches.

    Nodes that data or key flow (``key_flow``: that kind of edge) reaches from
    it, and its direct neighbours either way, without itself; and its key-flow
    edges. The walk ends where nothing new is reached, or at ``depth``.
    """
    e = edges.where(F.col("kind").isin("data_flow", key_flow))
    s = changed.select("source").distinct()
    ends = e.select("src", "dst", "kind")
    touched = s.join(ends, F.col("source") == F.col("src")).select("source", F.col("dst").alias("id"), "kind").unionByName(
        s.join(ends, F.col("source") == F.col("dst")).select("source", F.col("src").alias("id"), "kind"))
    keys = touched.where(F.col("kind") == key_flow).groupBy("source").agg(F.count("*").alias("k"))
    if depth is None:
        counts = fanout_counts(e, s, touched.select("source", "id"))
    else:
        nodes = bfs(e, s, depth).select("source", "id").unionByName(touched.select("source", "id")).distinct().where("id <> source")
        counts = nodes.groupBy("source").agg(F.count("*").alias("n"))
    return s.join(counts, "source", "left").join(keys, "source", "left").select("source", (F.coalesce("n", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("fanout"))


def pair_links(pairs: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """Pairs (a, b) with counts of direct edges by kind either way, hops, connected, and a bonus of .20 at most.

    ``hops`` is the length of the shortest way along calls from a to b or from
    b to a, up to the given number (null beyond). Half of it is walked from
    either end, so nodes meet in the middle and the far half is never built; in
    the task that has the pair, unless the graph has too many nodes for that.
    """
    either = edges.where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), "kind", "distance")
    p = pairs.select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    got = p.join(either, ["x", "y"], "left").groupBy("a", "b").agg(
        *[count_if(F.col("kind") == k).alias(k) for k in ("calls", "data_flow", "control_flow")], F.coalesce(F.sum("distance"), F.lit(0)).alias("distance"),
        F.coalesce(F.max("distance"), F.lit(0)).alias("max_distance"))
    begun = made()
    arcs = stored(edges.where("kind = 'calls' and src is not null and dst is not null").select("src", "dst").distinct(), "arcs")
    apart = stored(pairs.select("a", "b").distinct(), "pairs")
    nodes, n = taskwalks.numbered(ends(arcs, apart.select(F.explode(F.array("a", "b")).alias("id"))))
    if n <= taskwalks.NODES:
        same = apart.where("a = b").withColumn("hops", F.lit(0))
        ways = same.unionByName(taskwalks.hops_between(arcs, nodes, n, apart.where("a <> b"), hops))
        ways = stored(ways, "ways")
        release_since(begun, made()[-1])
    else:
        sources = stored(apart.select(F.explode(F.array("a", "b")).alias("source")).distinct(), "ends")
        forward = stored(bfs(arcs, sources, hops - hops // 2), "forward")
        back = stored(bfs(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sources, hops // 2), "back")
        both = apart.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))).alias("w")).select("a", "b", "w.*")
        out = both.join(forward.select(F.col("source").alias("s"), "id", F.col("distance").alias("d1")), "s")
        ways = out.join(back.select(F.col("source").alias("t"), "id", F.col("distance").alias("d2")), ["t", "id"]).groupBy("a", "b").agg(F.min(F.col("d1") + F.col("d2")).alias("hops"))
    got = got.join(ways, ["a", "b"], "left")
    bonus = F.least(F.lit(0.20), 0.08 * F.least("calls", F.lit(1)) + 0.06 * F.least("data_flow", F.lit(1)) + 0.04 * F.least("control_flow", F.lit(1))
                    + 0.04 * F.col("hops").isNotNull().cast("int"))
    return got.withColumn("connected", F.col("hops").isNotNull()).withColumn("bonus", bonus)


def top_neighbours(edges: DataFrame, k: int = 4, tasks: int = 0) -> DataFrame:
    """(id, way, kind, other, ...): the k first neighbours of each node, way (in or out) and kind of edge.

    Other files first, then relative imports, distance, number of edge kinds
    between the two, id. ``edges`` has src_file, dst_file, relative and
    distance; parallel edges are one neighbour with what they have together.
    Ranked in so many ``tasks``, if not 0.
    """
    merged = edges.groupBy("src", "dst").agg(
        F.max((F.col("src_file") != F.col("dst_file")).cast("int")).alias("cross"), F.max(F.col("relative").cast("int")).alias("relative"),
        F.max("distance").alias("distance"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    ways = F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("way"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("way"), F.col("src").alias("other")))
    rows = merged.select("cross", "relative", "distance", "kinds", F.explode(ways).alias("w")).select("w.*", "cross", "relative", "distance", "kinds", F.explode("kinds").alias("kind"))
    rows = rows.repartition(2 * tasks, "id", "way", "kind") if tasks else rows
    w = Window.partitionBy("id", "way", "kind").orderBy(F.desc("cross"), F.desc("relative"), F.desc("distance"), F.desc(F.size("kinds")), "other")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def node_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, score): 2 * in + out + .5 * functions + .25 * greatest complexity, edges between files only."""
    e = with_ends(edges, nodes, "file").where("src_file <> dst_file")
    went = e.select(F.col("src_file").alias("file"), F.lit(1.0).alias("s"))
    came = e.select(F.col("dst_file").alias("file"), F.lit(2.0).alias("s"))
    sums = went.unionByName(came).groupBy("file").agg(F.sum("s").alias("links"))
    own = nodes.groupBy("file").agg((0.5 * F.count("*") + 0.25 * F.max("complexity")).alias("own"))
    return own.join(sums, "file", "left").select("file", (F.col("own") + F.coalesce("links", F.lit(0.0))).alias("score"))


def graph_summary(nodes: DataFrame, edges: DataFrame, by: str = "file") -> DataFrame:
    """Per file: nodes, tests, and outgoing edges by kind."""
    n = nodes.groupBy(by).agg(F.count("*").alias("nodes"), count_if("is_test").alias("tests"))
    e = edges.join(nodes.select(F.col("id").alias("src"), by), "src").groupBy(by).agg(
        *[count_if(F.col("kind") == k).alias(k) for k in ("calls", "data_flow", "control_flow")])
    return n.join(e, by, "left").na.fill(0)


def flow_evidence(edges: DataFrame, examples: int = 3) -> DataFrame:
    """(id, local, crossing, examples): data edges of a node within and across files, and its first few targets."""
    e = edges.where("kind = 'data_flow'")
    cross = F.col("src_file") != F.col("dst_file")
    few = Window.partitionBy("src").orderBy("dst")
    first = e.select("src", "dst").distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= examples).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("examples"))
    return e.groupBy("src").agg(count_if(~cross).alias("local"), count_if(cross).alias("crossing")).join(first, "src").withColumnRenamed("src", "id")

