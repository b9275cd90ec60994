"""Scores and fusions. Column functions where a row is enough; weights are parameters."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clamp, count_if, share, tokens
from ..sources.storage import stored

# Weights with and without coverage.
COVERAGE_WEIGHTS = {"sbfl": 0.30, "graph": 0.25, "static": 0.15, "semantic": 0.10, "llm": 0.15, "risk": -0.05}
STATIC_WEIGHTS = {"sbfl": 0.0, "graph": 0.20, "static": 0.60, "semantic": 0.10, "llm": 0.10, "risk": 0.0}

# Weights of the graph signals.
GRAPH_WEIGHTS = {
    "traceback": 0.16, "test_cov": 0.16, "line": 0.08, "statement": 0.08, "branch": 0.06, "path": 0.06, "data": 0.07, "control": 0.07,
    "proximity": 0.14, "centrality": 0.07, "pagerank": 0.07, "impact": 0.06, "module": 0.04, "async": 0.04, "dynamic": 0.08, "static": 0.12,
    "risk": -0.10}

# Confidence priors of rules, and how readily a rule's bug shows in a test.
RULE_PRIORS = {
    "possible_index_overrun": 0.05, "dict_missing_key_guard": 0.04, "inplace_api_return_value": 0.04, "stringified_numeric_value": 0.04,
    "missing_len_zero_guard": 0.04, "identity_comparison_literal": 0.03, "iterator_double_consumption": 0.03, "inverted_empty_guard": 0.03,
    "enumerate_start_zero_counter": 0.03, "always_true_len_check": 0.02, "mutable_default_arg": 0.02, "broad_exception_pass": 0.01}
TRIGGER_PRIORS = {
    "possible_index_overrun": 0.95, "missing_len_zero_guard": 0.92, "dict_missing_key_guard": 0.90, "inplace_api_return_value": 0.86,
    "stringified_numeric_value": 0.84, "iterator_double_consumption": 0.82, "always_true_len_check": 0.81, "mutable_default_arg": 0.80,
    "broad_exception_pass": 0.78, "identity_comparison_literal": 0.76, "enumerate_start_zero_counter": 0.74, "inverted_empty_guard": 0.72}


def weighted(weights: dict[str, float]) -> Column:
    """Sum of weight times column, nulls as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))


def fuse(weights: dict[str, float]) -> Column:
    """Weighted sum, kept in 0 to 1 after the sum."""
    return clamp(weighted(weights))


def fuse_by_coverage(has_coverage: Column) -> Column:
    return F.when(has_coverage, fuse(COVERAGE_WEIGHTS)).otherwise(fuse(STATIC_WEIGHTS))


def toggled(rows: DataFrame, off: dict[str, list[str]], weights: dict[str, float]) -> DataFrame:
    """Rows once for each variant of ``off``, scored with those signals at 0."""
    scored = [F.struct(F.lit(v).alias("variant"), fuse({c: w for c, w in weights.items() if c not in gone}).alias("score")) for v, gone in off.items()]
    return rows.withColumn("_v", F.explode(F.array(*scored))).select(*rows.columns, "_v.*")


def noisy_or(confidence: str = "confidence") -> Column:
    """Aggregate: 1 less the product of 1 - confidence; 0 for no rows."""
    return F.coalesce(1 - F.product(1 - F.col(confidence)), F.lit(0.0))


def static_rank(static: Column, degree: Column, most: Column) -> Column:
    return F.least(F.lit(1.0), 0.8 * static + 0.2 * share(degree, most))


def set_cosine(left: Column, right: Column) -> Column:
    """Shared members by the root of the sizes' product, of two arrays without repeats."""
    return share(F.size(F.array_intersect(left, right)), F.sqrt(F.size(left).cast("double") * F.size(right)))


def with_external(rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Rows with ``external``: a stored score kept in 0 to 1, 0 where there is none."""
    s = scores.groupBy(key).agg(F.max("score").alias("_score"))
    return rows.join(s, key, "left").withColumn("external", clamp(F.coalesce("_score", F.lit(0.0)))).drop("_score")


def rank_within(rows: DataFrame, by: list[str], score: str, ties: list[str], k: int | None = None) -> DataFrame:
    """Rank from 1 in each case, best score first, ties by the given columns; up to k."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties)))
    return out.where(F.col("rank") <= k) if k else out


def top_k(rows: DataFrame, score: str, ties: list[str], k: int) -> DataFrame:
    """The k best of all rows with their rank. Only k rows of each task meet."""
    best = rows.orderBy(F.desc(score), *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *ties)))  # k rows


def diff_size(diff: str | Column) -> Column:
    """Added and removed lines, without the file headers."""
    lines = F.split(F.col(diff) if isinstance(diff, str) else diff, "\n")
    kept = F.filter(lines, lambda x: (x.startswith("+") & ~x.startswith("+++")) | (x.startswith("-") & ~x.startswith("---")))
    return F.coalesce(F.size(kept), F.lit(0)).cast("long")


def diff_files(diff: str | Column) -> Column:
    """Distinct paths in the file headers of a diff."""
    lines = F.split(F.col(diff) if isinstance(diff, str) else diff, "\n")
    heads = F.filter(lines, lambda x: x.startswith("--- a/") | x.startswith("+++ b/"))
    return F.size(F.array_distinct(F.transform(heads, lambda x: F.substring(x, 7, 1 << 30)))).cast("long")


def part_of(x: str, most: float) -> Column:
    """A count as a share of what counts as much, 1 at most."""
    return F.least(F.lit(1.0), F.col(x) / most)


def change_risk() -> Column:
    """From size, callers, cross_file, files, fanout, control and signature flags."""
    return F.least(F.lit(1.0), 0.40 * part_of("size", 20.0) + 0.35 * part_of("callers", 5.0) + 0.15 * part_of("cross_file", 3.0)
                   + 0.10 * part_of("files", 2.0) + 0.12 * part_of("fanout", 4.0) + 0.08 * F.col("control").cast("int") + 0.05 * F.col("signature").cast("int"))


def risk_bucket(risk: str = "risk") -> Column:
    return F.when(F.col(risk) >= 0.60, "high").when(F.col(risk) >= 0.30, "medium").otherwise("low")


def prior_score(localisation: str, rule_confidence: str, variant: str, risk: str, size: str) -> Column:
    return clamp(0.55 * F.col(localisation) + 0.20 * F.col(rule_confidence) + 0.20 / (1 + F.col(variant)) - 0.03 * F.col(risk) - 0.02 * part_of(size, 50.0))


# Weights of an attempt's score.
ATTEMPT_WEIGHTS = {"pass_ratio": 0.60, "localisation": 0.20, "static_ok": 0.10, "prior": 0.0, "feedback": 0.08, "diff": -0.06, "risk": -0.03, "warning": -0.01, "success": 0.12}
BUNDLE_WEIGHTS = {"pass_ratio": 0.62, "localisation": 0.22, "static_ok": 0.10, "bonus": 0.10, "risk": -0.04, "diff": -0.02, "success": 0.14}


def lookup(key: str | Column, table: dict[str, float], default: float) -> Column:
    """A small fixed table as a literal map."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[F.col(key) if isinstance(key, str) else key], F.lit(default))


def rule_calibration(confidence: Column, rule: Column, evidence: Column, variant: Column, size: Column) -> Column:
    """Confidence plus the rule's prior and evidence (up to .08), less variant and size penalties; .99 at most."""
    return clamp(
        clamp(confidence, 0.0, 0.99) + lookup(rule, RULE_PRIORS, 0.0) + F.least(F.lit(0.08), evidence)
        - F.least(F.lit(0.18), F.greatest(F.lit(0), variant) * 0.08) - F.least(F.lit(0.08), size / 100.0), 0.0, 0.99)


RUNTIME = ("type_error", "attribute_error", "runtime_error")
HARD = ("patch_apply_error", "syntax_error", "import_error", "safety_gate_blocked")


def feedback_score(kind: str, ratio: str, target_hit: str) -> Column:
    k, r = F.col(kind), F.col(ratio)
    base = (
        F.when(k == "success", 1.0).when(k == "test_failure", 0.55 + 0.25 * r).when(k.isin(*RUNTIME), 0.35 + 0.15 * r)
        .when(k.isin(*HARD), 0.10).when(k == "timeout", 0.05).when(k == "execution_error", 0.12).otherwise(0.20))
    return clamp(base + F.when(F.col(target_hit), 0.05).otherwise(0.0))


def failure_stage(kind: str) -> Column:
    k = F.col(kind)
    return (
        F.when(k == "success", "success").when(k == "patch_apply_error", "patch_application")
        .when(k.isin("syntax_error", "import_error", "safety_gate_blocked"), "static_validation").when(k == "timeout", "performance")
        .when(k.isin(*RUNTIME), "runtime_execution").when(k == "test_failure", "test_assertion").when(k == "execution_error", "sandbox_execution")
        .otherwise("unknown"))


def recoverability(kind: str, ratio: str, target_hit: str) -> Column:
    k, some = F.col(kind), (F.col(ratio) > 0) | F.col(target_hit)
    return (
        F.when(k == "success", "complete").when(k == "test_failure", F.when(some, "high").otherwise("medium"))
        .when(k.isin(*RUNTIME), F.when(some, "medium").otherwise("low")).when(k.isin(*HARD, "timeout", "execution_error"), "low").otherwise("unknown"))


def evidence_score(ratio: str, risk: str, valid: str, feedback: str) -> Column:
    return 0.50 * F.col(ratio) + 0.20 * (1 - F.col(risk)) + 0.15 * F.col(valid).cast("int") + 0.15 * F.col(feedback)


def capped_judgment(judge: Column, evidence: Column, kind: str, ratio: str) -> Column:
    """A blend of judge and evidence, capped by what the run showed and floored on success."""
    k = F.col(kind)
    cap = F.when(k == "success", 1.0).when(k == "timeout", 0.35).when(k.isin(*HARD), 0.40).when(F.col(ratio) > 0, 0.75).otherwise(0.65)
    floor = F.when(k == "success", 0.55).otherwise(0.0)
    return F.greatest(floor, F.least(cap, 0.65 * judge + 0.35 * evidence))


def judge_agreement(judge: Column, evidence: Column, tolerance: float = 0.20) -> Column:
    d = judge - evidence
    return F.when(F.abs(d) <= tolerance, "aligned").when(d > 0, "judge_more_optimistic").otherwise("judge_more_conservative")


def judge_blend(base: Column, calibrated: Column, raw: Column, weight: float = 0.25) -> Column:
    """Base and judge, the calibrated judgment if there is one; the base alone without any."""
    return F.coalesce((1 - weight) * base + weight * F.coalesce(calibrated, raw), base)


def trigger_score(confidence: Column, rule: Column, kind: Column, specific: Column, assertion: Column) -> Column:
    weight = F.when(kind == "function", 1.0).when(kind == "returned_nested_function", 0.90).otherwise(0.92)
    return F.least(F.lit(1.0), 0.55 * clamp(confidence) + 0.25 * lookup(rule, TRIGGER_PRIORS, 0.50) + 0.10 * weight
                   + 0.10 * F.when(specific, 1.0).otherwise(0.70) + F.when(assertion, 0.02).otherwise(0.0))


# File names and folders of each role, and what a role weighs.
ROLE_WEIGHTS = {"application": 1.0, "support": 0.75, "project_automation": 0.65, "test_automation": 0.55, "test": 0.35, "unknown": 0.80}


def source_role(path: str) -> Column:
    p = F.lower(F.trim(F.replace(F.col(path), F.lit("\\"), F.lit("/"))))
    p = F.regexp_replace(p, "^/+|/+$", "")
    name, parts = F.element_at(F.split(p, "/"), -1), F.split(p, "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(p == "", "unknown").when(name.startswith("test_") | name.endswith("_test.py") | has("tests", "test"), "test")
        .when(name.isin("noxfile.py", "toxfile.py", "conftest.py"), "test_automation")
        .when(name.isin("setup.py", "manage.py", "fabfile.py", "tasks.py"), "project_automation")
        .when(has("scripts", "tools", "examples", "docs", "doc"), "support").otherwise("application"))


def role_ranking(rows: DataFrame, by: str, path: str, name: str) -> DataFrame:
    """Rows with role, static_rule, graph_share, role_score, final and their rank in the case.

    findings, rules, types and graph are columns. Equal scores go by the static
    score, the graph's, the role's, the path and the name, then by the id.
    """
    raw = F.col("findings") + 0.5 * F.col("rules") + 0.25 * F.col("types")
    most = rows.groupBy(by).agg(F.max(raw).alias("_s"), F.max("graph").alias("_g"))
    r = rows.join(most, by).withColumn("role", source_role(path)).withColumn("static_rule", share(raw, "_s")).withColumn("graph_share", share("graph", "_g"))
    r = r.withColumn("role_score", lookup("role", ROLE_WEIGHTS, 0.80))
    final = 0.55 * F.col("static_rule") + 0.30 * F.col("graph_share") + 0.15 * F.col("role_score")
    best = [F.desc(F.round(c, 9)) for c in ("final", "static_rule", "graph_share", "role_score")]
    w = Window.partitionBy(by).orderBy(*best, path, name, "id")
    return r.drop("_s", "_g").withColumn("final", final).withColumn("rank", F.row_number().over(w))


def role_audit(ranked: DataFrame, by: str, roles: tuple[str, ...] = tuple(ROLE_WEIGHTS)) -> DataFrame:
    """Per case: rows, rows of each role, role of the first-ranked row, whether any row, and whether the first, is application code."""
    application = F.col("role") == "application"
    return ranked.groupBy(by).agg(
        F.count("*").alias("n"), *[count_if(F.col("role") == r).alias(r) for r in roles], F.min_by("role", "rank").alias("top_role"),
        F.bool_or(application).alias("any_application"), F.min_by(application, "rank").alias("top_application"))


# Words of a path that hint at code worth repairing.
PATH_HINTS = {
    "cipher": 16, "crypt": 16, "decrypt": 16, "encrypt": 16, "parser": 14, "validator": 14, "normalizer": 14, "index": 12, "iterator": 12,
    "counter": 12, "lookup": 12, "dict": 12, "mapping": 12, "cache": 12, "window": 12, "token": 10, "score": 10, "format": 10, "sort": 10,
    "search": 10, "average": 5, "mean": 5, "median": 5, "mode": 5}


def path_priority(path: str, hints: dict[str, int] = PATH_HINTS) -> Column:
    p = F.lower(F.col(path))
    hinted = sum((F.when(p.contains(w), n).otherwise(0) for w, n in hints.items()), F.lit(0))
    name = F.element_at(F.split(p, "/"), -1)
    test = name.startswith("test_") | name.endswith("_test.py") | F.arrays_overlap(F.split(p, "/"), F.array(F.lit("tests"), F.lit("test")))
    return F.when(test, 0).otherwise(20) + hinted - F.when(name == "__init__.py", 10).otherwise(0)


def target_priority(rows: DataFrame, signals: DataFrame, key: str, every: bool = False) -> DataFrame:
    """(key, signal, priority) of candidates against wanted signals.

    ``rows``: key, rules (array), kind, failures (array), name, grp. ``signals``:
    signal, rules, kinds, focus, grp: few rows, held beside every candidate;
    nothing is shuffled. A candidate is scored with the signals it shares rules
    with, or with ``every`` one. Rule overlap gives 10 and 1 a rule, none takes 5
    where a signal wants rules; a wanted kind gives 3, up to 3 comes from failure
    types, 2 from the signal in the name, and the wanted group 50 or -5.
    """
    s = F.broadcast(signals.select("signal", F.col("rules").alias("want_rules"), "kinds", F.col("grp").alias("want_grp")))
    shared = F.size(F.array_intersect(F.filter("rules", lambda r: r.isNotNull()), "want_rules"))
    full = rows.crossJoin(s).withColumn("shared", shared)
    full = full if every else full.where("shared > 0")
    score = (
        F.when(F.col("shared") > 0, 10 + F.col("shared")).when(F.size("want_rules") > 0, -5).otherwise(0)
        + F.when(F.array_contains("kinds", F.col("kind")), 3).otherwise(0)
        + F.least(F.lit(3.0), 0.5 * F.greatest(F.size("failures"), F.lit(0))) + F.when(F.col("name").contains(F.col("signal")), 2).otherwise(0)
        + F.when(F.col("want_grp").isNull(), 0).when(F.col("want_grp") == F.col("grp"), 50).otherwise(-5))
    return full.select(key, "signal", score.cast("double").alias("priority"))


def interest_score() -> Column:
    """4 for an inversion, shares of nodes, candidates and chain, and one for each of four flags."""
    flag = lambda c: F.col(c).cast("int")
    return (4 * flag("inversion") + F.least(F.lit(3.0), F.col("nodes") / 2.0) + F.least(F.lit(2.0), F.col("candidates") / 2.0)
            + F.least(F.lit(2.0), F.col("chain").cast("double")) + flag("reflection") + flag("multi") + flag("diverse") + flag("cross_file"))


def hypotheses(functions: DataFrame, findings: DataFrame, candidates: DataFrame, width: int = 4) -> DataFrame:
    """Best hypotheses of each case: (case_id, function, origin, score, rank).

    With a finding .55 localisation + .30 confidence + .10 static + .05 semantic;
    without, .70 localisation + .15 graph + .15 semantic. Then noisy-or with the
    graph (x .75 without a chain) and with candidates (.18 + .04 each up to
    three + .08 of the least risk).
    """
    best = findings.groupBy("case_id", "function").agg(F.max("confidence").alias("confidence"))
    some = candidates.groupBy("case_id", "function").agg(F.count("*").alias("n"), F.min("risk").alias("least"))
    f = functions.join(best, ["case_id", "function"], "left").join(some, ["case_id", "function"], "left")
    static = 0.55 * F.col("localisation") + 0.30 * F.col("confidence") + 0.10 * F.col("static") + 0.05 * F.col("semantic")
    bare = 0.70 * F.col("localisation") + 0.15 * F.col("graph") + 0.15 * F.col("semantic")
    base = clamp(F.coalesce(static, bare))
    graph = 0.35 * F.col("graph") * F.when(F.col("chain") > 0, 1.0).otherwise(0.75)
    boost = F.when(F.col("n").isNotNull(), 0.18 + 0.04 * F.least("n", F.lit(3)) + 0.08 * (1 - F.col("least"))).otherwise(0.0)
    score = 1 - (1 - base) * (1 - graph) * (1 - boost)
    rows = f.select("case_id", "function", F.when(F.col("confidence").isNotNull(), "finding").otherwise("localisation").alias("origin"), score.alias("score"))
    return rank_within(rows, ["case_id"], "score", ["function"], width)


# What bundles of changes are worth.
RULE_BONUS, RISK_COST, SIZE_COST, LINK_CAP = 0.08, 0.08, 0.02, 0.20
LINK_BONUS = {"calls": 0.08, "data_flow": 0.06, "control_flow": 0.04, "connected": 0.04}


def bundles(members: DataFrame, links: DataFrame, k: int = 8, most: int = 3, variants: int = 2) -> DataFrame:
    """The ``k`` best bundles of two up to ``most`` functions of each case, a variant each.

    ``members``: case_id, function, variant, localisation, rule, risk, size;
    ``links``: a, b (functions, a < b), calls, data_flow, control_flow,
    connected. Rows: case_id, rank, members (array of function and variant, in
    order of functions), rules, risk, bonus, priority; equal priorities go by members.

    Each function gives its best ``variants``. A member without a link stays
    only if it may stand in one of the k best: where enough functions with
    the same rule are better by more than sizes can make up for, it can't. What
    is left of a case is enumerated best first under upper bounds: of bundles
    without a link by their members' worth, of those with one from the linked
    pairs on; so the product of all members is never made.
    """
    own = F.col("localisation") + 0.10 * (1 - F.least(F.lit(1.0), F.col("risk"))) - 0.03 * F.col("variant") - 0.02 * F.least(F.lit(1.0), F.col("size") / 20.0)
    few = rank_within(members.withColumn("_own", own), ["case_id", "function"], "_own", ["variant"], variants).drop("rank", "_own")
    functions = few.select("case_id", "function").distinct()
    here = functions.select("case_id", F.col("function").alias("a")).join(links, "a").join(functions.select("case_id", F.col("function").alias("b")), ["case_id", "b"])
    here = stored(here, "links")
    linked = here.select("case_id", F.explode(F.array("a", "b")).alias("function")).distinct().withColumn("_linked", F.lit(True))
    worth = F.col("localisation") - RISK_COST * F.col("risk")
    ranked = few.withColumn("_worth", worth).join(linked, ["case_id", "function"], "left").withColumn(
        "_nth", F.row_number().over(Window.partitionBy("case_id", "rule").orderBy(F.desc("_worth"), "function", "variant")))
    enough = variants * (k + most - 1)
    least = ranked.where(F.col("_nth") == enough).select("case_id", "rule", F.col("_worth").alias("_least"))
    kept = ranked.join(least, ["case_id", "rule"], "left").where(
        F.col("_linked") | F.col("_least").isNull() | (F.col("_worth") >= F.col("_least") - most * SIZE_COST - 1e-9))
    kinds = {f.name: f.dataType.simpleString() for f in few.schema.fields}
    schema = (f"case_id {kinds['case_id']}, rank int, members array<struct<function: {kinds['function']}, variant: {kinds['variant']}>>, "
              "rules int, risk double, bonus double, priority double")

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        rows = _best_bundles(one, two, k, most)
        return pd.DataFrame([(one["case_id"].iloc[0], n, *r) for n, r in enumerate(rows, 1)], columns=["case_id", "rank", "members", "rules", "risk", "bonus", "priority"])

    columns = ["case_id", "function", "variant", "rule", "risk", "size", "_worth"]
    return kept.select(*columns).groupBy("case_id").cogroup(here.groupBy("case_id")).applyInPandas(best, schema)


def _best_bundles(members: pd.DataFrame, links: pd.DataFrame, k: int, most: int) -> list[tuple]:
    """(members, rules, risk, bonus, priority) of the k best bundles of one case, best first."""
    m = members.sort_values(["_worth", "function", "variant"], ascending=[False, True, True]).to_dict("records")
    pair = {(r["a"], r["b"]): r for r in links.to_dict("records")}
    found: dict[tuple, tuple] = {}
    heap: list[float] = []  # the k best priorities so far

    def add(chosen: tuple[int, ...]) -> None:
        names = sorted((m[i]["function"], m[i]["variant"]) for i in chosen)
        key = tuple(names)
        if key in found or len({f for f, _ in names}) < len(names):
            return
        rules = len({m[i]["rule"] for i in chosen})
        risk = sum(m[i]["risk"] for i in chosen) / len(chosen)
        ties = [pair[f, g] for n, (f, _) in enumerate(names) for g, _ in names[n + 1:] if (f, g) in pair]
        pairs = len(names) * (len(names) - 1) / 2
        bonus = sum(LINK_BONUS[c] for c in ("calls", "data_flow", "control_flow") if any(t[c] for t in ties))
        bonus = min(LINK_CAP, bonus + LINK_BONUS["connected"] * sum(bool(t["connected"]) for t in ties) / pairs)
        worth = sum(m[i]["_worth"] for i in chosen) / len(chosen)
        priority = worth + RULE_BONUS * rules + bonus - SIZE_COST * min(1.0, sum(m[i]["size"] for i in chosen) / 40.0)
        found[key] = (round(-priority, 9), names, rules, risk, bonus, priority)
        heapq.heappush(heap, priority)
        if len(heap) > k:
            heapq.heappop(heap)

    def closed(worth: float, size: int, bonus: float) -> bool:
        """Whether bundles of such a mean worth can't be among the k best."""
        return len(heap) == k and worth + RULE_BONUS * size + bonus < heap[0] - 1e-9

    at: dict = {}
    for i, x in enumerate(m):
        at.setdefault(x["function"], []).append(i)
    # with a link: from each linked pair on, the third and further ones by worth
    for f, g in pair:
        for i in at.get(f, ()):
            for j in at.get(g, ()):
                add((i, j))
    for size in range(3, most + 1):
        for f, g in pair:
            for i in at.get(f, ()):
                for j in at.get(g, ()):
                    base = m[i]["_worth"] + m[j]["_worth"]
                    for rest in _by_worth(m, size - 2, lambda w, b=base, s=size: closed((b + w) / s, s, LINK_CAP)):
                        add((i, j, *rest))
    # without one: all by worth, as far as the rules alone may lift them
    for size in range(2, most + 1):
        for chosen in _by_worth(m, size, lambda w, s=size: closed(w / s, s, 0.0)):
            add(chosen)
    return [(names, rules, risk, bonus, priority) for _, names, rules, risk, bonus, priority in sorted(found.values(), key=lambda x: x[:2])[:k]]


def _by_worth(m: list[dict], size: int, closed: Callable[[float], bool]) -> Iterator[tuple[int, ...]]:
    """Combinations of places in the sorted ``m``, largest sum of worths first, until ``closed`` for their sum."""
    if len(m) < size:
        return
    total = lambda c: sum(m[i]["_worth"] for i in c)
    first = tuple(range(size))
    heap, seen = [(-total(first), first)], {first}
    while heap:
        worth, c = heapq.heappop(heap)
        if closed(-worth):
            return
        yield c
        for n in range(size):
            nxt = c[n] + 1
            if nxt < (c[n + 1] if n + 1 < size else len(m)):
                new = (*c[:n], nxt, *c[n + 1:])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (-total(new), new))


def token_overlap(entities: DataFrame, context: DataFrame, by: str, key: str) -> DataFrame:
    """Entities with ``semantic``: set cosine of their text's tokens and their case's context tokens.

    Tokens meet as rows, so neither a case's context nor its entities are
    gathered in one place. ``key`` tells the entities apart.
    """
    c = context.select(by, F.explode(tokens("text")).alias("_t")).distinct()
    n = c.groupBy(by).agg(F.count("*").alias("_nc"))
    e = entities.withColumn("_e", tokens("text"))
    shared = e.select(key, by, F.explode("_e").alias("_t")).join(c, [by, "_t"], "left_semi").groupBy(key).agg(F.count("*").alias("_both"))
    both = e.withColumn("_ne", F.size("_e")).drop("_e").join(shared, key, "left").join(n, by, "left")
    return both.withColumn("semantic", share(F.coalesce("_both", F.lit(0)), F.sqrt(F.col("_ne").cast("double") * F.col("_nc")))).drop("_both", "_ne", "_nc")
