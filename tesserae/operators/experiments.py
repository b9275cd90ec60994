"""Experiment analysis: ablations, weight grids, frontiers, generalisation, budgets."""

from __future__ import annotations

import json
from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import attach, clamp, count_if, mean_or_zero, share
from ..sources.storage import stored
from .dominance import ROWS_A_RANGE, below, close
from .metrics import per_list, within
from .profiles import LIST_ROWS, MOST, SUMS, profile_sums


def ablation_impact(variants: DataFrame, weights: dict[str, float], inverted: tuple[str, ...], baseline: str, slack: float = 0.05) -> DataFrame:
    """(variant, impact, direction, dominant): weighted metric deltas against the baseline variant.

    ``inverted`` metrics are better when smaller. The dominant metric has the largest contribution (ties: larger name).
    """
    base = variants.where(F.col("variant") == baseline).select(*[F.col(m).alias(f"_{m}") for m in weights]).limit(1)
    rows = attach(variants.where(F.col("variant") != baseline), base, [])
    delta = lambda m: (F.col(f"_{m}") - F.col(m)) if m in inverted else (F.col(m) - F.col(f"_{m}"))
    parts = F.array(*[F.struct(F.coalesce(delta(m) * w, F.lit(0.0)).alias("c"), F.lit(m).alias("name")) for m, w in weights.items()])
    rows = rows.withColumn("_p", parts)
    impact = F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + p["c"])
    top = F.array_max(F.transform("_p", lambda p: F.struct(F.round(F.abs(p["c"]), 9).alias("size"), p["name"].alias("name"))))
    rows = rows.withColumn("impact", impact)
    direction = F.when(F.col("impact") <= -slack, "regression").when(F.col("impact") >= slack, "improvement").otherwise("neutral")
    return rows.select("variant", "impact", direction.alias("direction"), top["name"].alias("dominant"))


def strategies(attempts: DataFrame) -> DataFrame:
    """(strategy, case_id, evaluated, successes, rate, first_success_rank, failures_before) for ways to search the same attempts.

    full; top1_only; depth0_only; reflection_only (depth > 0); prior_order (by score); first_per_rule.
    """
    w = lambda *order: F.row_number().over(Window.partitionBy("case_id").orderBy(*order))
    a = attempts.select("case_id", "id", "rank", "success", "depth", "rule", "score")
    a = a.withColumn("by_score", w(F.desc("score"), "rank")).withColumn("rule_nth", F.row_number().over(Window.partitionBy("case_id", "rule").orderBy("rank")))
    branch = lambda n, keep, order: F.when(keep, F.struct(F.lit(n).alias("strategy"), order.alias("o")))
    yes = F.lit(True)
    named = F.array(branch("full", yes, F.col("rank")), branch("top1_only", F.col("rank") == 1, F.col("rank")), branch("depth0_only", F.col("depth") == 0, F.col("rank")),
                    branch("reflection_only", F.col("depth") > 0, F.col("rank")), branch("prior_order", yes, F.col("by_score")), branch("first_per_rule", F.col("rule_nth") == 1, F.col("rank")))
    rows = a.withColumn("s", F.explode(F.filter(named, lambda x: x.isNotNull()))).select("case_id", "id", "success", "s.*")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("strategy", "case_id").orderBy("o", "id")))
    g = rows.groupBy("strategy", "case_id").agg(F.count("*").alias("evaluated"), count_if("success").alias("successes"), F.min(F.when(F.col("success"), F.col("place"))).alias("first_success_rank"))
    return g.withColumn("rate", share("successes", "evaluated")).withColumn("failures_before", F.coalesce(F.col("first_success_rank") - 1, F.col("evaluated")).cast("long"))


def strategy_delta(rows: DataFrame, baseline: str = "full") -> DataFrame:
    """Strategies with ``change`` of the first success rank against the baseline: same, improvement or regression."""
    base = rows.where(F.col("strategy") == baseline).select("case_id", F.col("first_success_rank").alias("_b"))
    r, b = F.coalesce("first_success_rank", F.lit(1 << 30)), F.coalesce("_b", F.lit(1 << 30))
    return rows.join(base, "case_id", "left").withColumn("change", F.when(r == b, "same").when(r < b, "improvement").otherwise("regression")).drop("_b")


# The grid's values for each weight.
GRID = {"sbfl": (0.20, 0.30, 0.40), "graph": (0.15, 0.25, 0.35), "static": (0.10, 0.15, 0.20), "semantic": (0.05, 0.10), "llm": (0.10, 0.15), "risk": (0.0, 0.05, 0.10)}


#: The repair grid's weights, and the judge's weights tried beside the default.
REPAIR_GRID = {"feedback": (0.0, 0.04, 0.08, 0.12, 0.16), "diff": (0.03, 0.06, 0.10), "risk": (0.0, 0.03, 0.06)}
JUDGE_WEIGHTS = (0.04, 0.08, 0.12)


def grid_profiles(grid: dict[str, tuple[float, ...]] = GRID, default: dict[str, float] | None = None) -> list[dict]:
    """Every combination as {profile, weights}; the default profile takes the place of the equal one."""
    out = []
    for i, values in enumerate(product(*grid.values())):
        w = dict(zip(grid, values, strict=True))
        out.append({"profile": "default" if w == default else f"grid_{i:03d}", **w})
    return out


def weight_grid(spark: SparkSession, grid: dict[str, tuple[float, ...]] = GRID, default: dict[str, float] | None = None) -> DataFrame:
    """(profile, weights...) of grid_profiles."""
    rows = [tuple(p.values()) for p in grid_profiles(grid, default)]
    return spark.createDataFrame(rows, ", ".join(["profile string", *[f"{k} double" for k in grid]]))


def shuffle_tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def profile_rows(profiles: list[dict]) -> Column:
    """The profiles as one constant array of structs, to be exploded beside each row.

    From JSON, so that a grid is one small expression and planning doesn't grow with it.
    """
    kind = {str: "string", int: "int", float: "double"}
    fields = ", ".join(f"{k}: {kind[type(v)]}" for k, v in profiles[0].items())
    return F.from_json(F.lit(json.dumps(profiles)), f"array<struct<{fields}>>")


#: Rows of one case, all profiles counted, that a task sorts.
ROWS_A_TASK = 1 << 22


def beside_profiles(lists: DataFrame, profiles: list[dict], rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``lists`` with a profile in ``p``, a row for each, dealt by case and group, and by ``block``.

    Rows are dealt before they are multiplied, so what is shuffled doesn't grow
    with the profiles. A case that would be more than ``rows_a_task`` rows is
    dealt several times, each time for a block of profiles; windows and sums
    that have ``block`` among their keys find their rows in place. The number of
    tasks is given, as adaptive execution would size them by what there is
    before the rows are multiplied.
    """
    blocks = F.least(F.lit(len(profiles)), F.ceil(F.col("_n") * len(profiles) / rows_a_task)).cast("int")
    sizes = lists.groupBy(F.col("case_id").alias("_case"), F.col("grp").alias("_grp")).agg(F.count("*").alias("_n"))
    long = stored(sizes.where(F.col("_n") * len(profiles) > rows_a_task).select("_case", "_grp", blocks.alias("_blocks")), "long_cases")
    found = lists.join(long, F.col("case_id").eqNullSafe(F.col("_case")) & F.col("grp").eqNullSafe(F.col("_grp")), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = found.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).repartition(shuffle_tasks(lists), "case_id", "grp", "block")
    own = F.filter(profile_rows(profiles), lambda p, i: i % F.col("_blocks") == F.col("block"))
    return dealt.withColumn("p", F.explode(own)).drop("_case", "_grp", "_blocks")


def rerank(lists: DataFrame, profiles: list[dict], signals: list[str], repeats: bool = True) -> DataFrame:
    """(block, profile, case_id, item, relevant, rank): each list under each profile (by number), by score and then the old rank.

    Where no case repeats an item (``repeats`` false), hits so far come from the same sort.

    Profiles are a bounded grid (hundreds): they are a constant of the plan.
    """
    own = lists.select("case_id", "grp", "item", "relevant", F.col("rank").alias("old"), *signals)
    numbered = [{"profile": i, **{s: p[s] for s in signals}} for i, p in enumerate(profiles)]
    score = sum(((-1 if s == "risk" else 1) * F.col(f"p.{s}") * F.col(s) for s in signals), F.lit(0.0))
    rows = beside_profiles(own, numbered).select("block", "case_id", "grp", "item", "relevant", "old", "p.profile", F.round(score, 9).alias("s"))
    w = Window.partitionBy("block", "profile", "case_id", "grp").orderBy(F.desc("s"), "old")
    out = rows.withColumn("rank", F.row_number().over(w))
    if not repeats:
        out = out.withColumn("hits", F.sum(F.col("relevant").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.drop("s", "old")


VALIDATION = {"map": 0.25, "mrr": 0.25, "ndcg": 0.20, "top1": 0.15, "top3": 0.10}


def profile_metrics(lists: DataFrame, profiles: list[dict], signals: list[str], *by: str, list_rows: int = LIST_ROWS) -> DataFrame:
    """Means of the ranking metrics and the validation score of each profile, by its name: those of ``rerank``.

    Lists are taken whole, a list at a time, and only sums leave a task. Those of
    more than ``list_rows`` items, that repeat an item or have a null or very large signal
    are reranked by windows instead.
    """
    own = lists.select("case_id", "grp", "item", "relevant", "rank", *signals)
    fits = reduce(and_, [F.coalesce(F.abs(F.col(s)) <= MOST, F.lit(False)) for s in signals], F.col("relevant").isNotNull() & F.col("rank").isNotNull())
    sizes = own.groupBy("case_id", "grp", "item").agg(F.count("*").alias("n"), F.min(fits).alias("fits")).groupBy("case_id", "grp").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.min("fits").alias("fits"))
    apart = stored(sizes.where((F.col("n") > list_rows) | (F.col("most") > 1) | ~F.col("fits")).select(F.col("case_id").alias("_case"), F.col("grp").alias("_grp")), "lists_apart")
    same = F.col("case_id").eqNullSafe(F.col("_case")) & F.col("grp").eqNullSafe(F.col("_grp"))
    none = apart.isEmpty()
    weights = [[-p[s] if s == "risk" else p[s] for s in signals] for p in profiles]
    whole = own if none else own.join(apart, same, "left_anti")
    sums = profile_sums(whole.withColumnRenamed("rank", "old"), weights, signals, list(by), shuffle_tasks(lists))
    if not none:
        each = per_list(rerank(own.join(apart, same, "left_semi"), profiles, signals), ["block", "profile", "case_id", "grp"])
        sums = sums.unionByName(each.select(
            "profile", *by, F.lit(1).cast("long").alias("cases"), within(1).alias("top1"), within(3).alias("top3"), F.col("reciprocal").alias("mrr"), F.col("ap").alias("map"), "ndcg", "exam"))
    m = sums.groupBy("profile", *by).agg(F.sum("cases").alias("cases"), *[F.sum(c).alias(c) for c in SUMS]).withColumns({c: share(c, "cases") for c in SUMS})
    names = F.split(F.lit(",".join(p["profile"] for p in profiles)), ",")
    return m.withColumn("profile", F.get(names, F.col("profile"))).withColumn(
        "validation", sum((F.col(c) * w for c, w in VALIDATION.items()), 0.05 * (1 - F.col("exam"))))


def pareto(rows: DataFrame, key: str, most: list[str], least: list[str], slack: float = 1e-9, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(key, dominates, dominated_by, optimal) among the rows.

    One row dominates another if it is no worse in any field and better in one;
    differences of up to ``slack`` are none. Rows with equal fields are counted
    together first. Who is no worse comes from dominance counts by divide and
    conquer, less those that are no better either, which are close in every
    field. A row with a field that is null or no number is not compared.
    """
    fields = [*most, *least]
    points = stored(rows.groupBy(*fields).agg(F.count("*").alias("n")).withColumn("q", F.monotonically_increasing_id()), "points")
    number = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in fields])
    signed = points.where(number).select("q", "n", *[(F.col(c).cast("double") * (1.0 if c in most else -1.0)).alias(c) for c in fields])
    turned = signed.select("q", "n", *[(-F.col(c)).alias(c) for c in fields])
    asked = lambda p: p.select("q", *[(F.col(c) + slack).alias(c) for c in fields])
    up = below(signed, asked(signed), fields, rows_a_range).withColumnRenamed("n", "up")
    down = below(turned, asked(turned), fields, rows_a_range).withColumnRenamed("n", "down")
    near = close(signed, fields, slack).withColumnRenamed("n", "near")
    less = lambda c: F.coalesce(F.col(c) - F.col("near"), F.lit(0)).cast("long")
    counts = points.join(up, "q", "left").join(down, "q", "left").join(near, "q", "left").select(
        *fields, less("up").alias("dominates"), less("down").alias("dominated_by"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in fields]
    return rows.alias("r").join(counts.alias("c"), reduce(and_, same)).select(
        F.col(f"r.{key}").alias(key), "dominates", "dominated_by", (F.col("dominated_by") == 0).alias("optimal"))


def holdout_robustness(groups: DataFrame) -> DataFrame:
    """(profile, validation, gap_top1, gap_map, robust) from each profile's metrics by group (cases, top1, map, validation).

    A group's holdout is the totals less the group, so nothing is computed again.
    """
    w = Window.partitionBy("profile")
    total = lambda c: F.sum(F.col(c) * F.col("cases")).over(w)
    rest = F.sum("cases").over(w) - F.col("cases")
    gap = lambda c: F.abs(share(total(c) - F.col(c) * F.col("cases"), rest) - F.col(c))
    g = groups.withColumns({"g1": gap("top1"), "g2": gap("map"), "v": share(total("validation"), F.sum("cases").over(w))})
    r = g.groupBy("profile").agg(F.max("v").alias("validation"), F.max("g1").alias("gap_top1"), F.max("g2").alias("gap_map"))
    return r.withColumn("robust", F.greatest(F.lit(0.0), F.col("validation") - 0.10 * F.col("gap_top1") - 0.10 * F.col("gap_map")))


def repair_metrics(ranked: DataFrame) -> DataFrame:
    """(profile, cases, top1, mrr, mean_rank, margin, score) of attempts (profile, case_id, rank, success, score)."""
    ok = F.col("success")
    keys = [k for k in ("block", "profile", "case_id") if k in ranked.columns]
    c = ranked.groupBy(*keys).agg(F.min(F.when(ok, F.col("rank"))).alias("first"), F.max(F.when(ok, F.col("score"))).alias("good"), F.max(F.when(~ok, F.col("score"))).alias("bad"))
    margin = F.when(F.col("good").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("good") - F.coalesce("bad", F.lit(0.0))))
    m = c.groupBy("profile").agg(
        F.count("*").alias("cases"), mean_or_zero(F.coalesce(F.col("first") == 1, F.lit(False)).cast("int")).alias("top1"), mean_or_zero(share(F.lit(1), "first")).alias("mrr"),
        F.avg("first").alias("mean_rank"), mean_or_zero(margin).alias("margin"))
    return m.withColumn("score", 0.55 * F.col("top1") + 0.35 * F.col("mrr") + 0.10 * F.least(F.lit(1.0), F.col("margin")))


def judge_gain(profiles: DataFrame, by: list[str]) -> DataFrame:
    """Best profile without and with a judge (column judged), the gain and its status; ties go to the larger name."""
    best = lambda c: F.max(F.when(c, F.struct(F.round("score", 9).alias("score"), "profile")))
    r = profiles.groupBy(*by).agg(best(~F.col("judged")).alias("a"), best(F.col("judged")).alias("b"))
    gain = F.col("b.score") - F.col("a.score")
    status = F.when(gain.isNull(), "not_evaluated").when(gain > 1e-9, "improved").otherwise("no_gain")
    return r.select(*by, F.col("a.profile").alias("plain"), F.col("b.profile").alias("judged"), gain.alias("gain"), status.alias("status"))


def generalisation(cases: DataFrame, group: str) -> DataFrame:
    """One row a group: its metrics, those of all other cases and the gaps; ``cases``: group, top1, ap, success, efficiency."""
    g = cases.groupBy(group).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("top1", "ap", "success", "efficiency")])
    total = g.agg(F.sum("n").alias("n_all"), *[F.sum(c).alias(f"all_{c}") for c in ("top1", "ap", "success", "efficiency")])
    t = attach(g, total, [])
    mean = lambda c: share(c, "n")
    others = lambda c: share(F.col(f"all_{c}") - F.col(c), F.col("n_all") - F.col("n"))
    score = 0.35 * mean("top1") + 0.30 * mean("ap") + 0.25 * mean("success") + 0.10 * F.least(F.lit(1.0), mean("efficiency"))
    return t.select(group, "n", mean("top1").alias("top1"), others("top1").alias("train_top1"), (others("top1") - mean("top1")).alias("gap_top1"),
                    (others("ap") - mean("ap")).alias("gap_map"), score.alias("score"))


def generalisation_summary(groups: DataFrame, group: str) -> DataFrame:
    """One row: entropy balance, imbalance, largest gap, worst group, stability, risk."""
    total = groups.agg(F.sum("n").alias("n_all"))
    p = F.col("n") / F.col("n_all")
    s = attach(groups, total, []).agg(
        (-F.sum(p * F.log2(p))).alias("entropy"), (F.max("n") / F.min("n")).alias("imbalance"), F.max("gap_top1").alias("max_gap"),
        F.min(F.struct(F.round("score", 9).alias("score"), (-F.col("n")).alias("n"), F.col(group).alias("g"))).alias("w"), F.max("score").alias("best"))
    spread = F.col("best") - F.col("w.score")
    gap = F.greatest(F.lit(0.0), "max_gap")
    return s.select("entropy", "imbalance", gap.alias("max_gap"), F.col("w.g").alias("worst"), F.col("w.score").alias("worst_score"), clamp(1 - spread).alias("stability"),
                    F.when(gap >= 0.35, "high").when(gap >= 0.15, "medium").otherwise("low").alias("risk"))


# Difficulty labels and their weights.
DIFFICULTY = {
    "multi_ground_truth": ("truth > 1", 2), "cross_function_trace": ("chain >= 2", 1), "cross_function_data_flow": ("flows > 0", 1), "cross_file_patch": ("cross_file > 0", 1),
    "patch_candidate_competition": ("candidates > 1", 1), "wide_beam_search": ("evaluated > 3", 1), "failed_before_success": ("failures > 0", 1),
    "reflection_depth": ("depth > 0 or rounds > 1", 1), "multi_patch_bundle": ("bundle > 1", 2), "high_patch_risk": ("risk >= 0.30", 1)}


def difficulty(cases: DataFrame) -> DataFrame:
    """Cases with labels, score and bucket (4 hard, 2 medium, else easy)."""
    labels = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, (rule, _) in DIFFICULTY.items()]))
    score = sum((F.when(F.expr(rule), w).otherwise(0) for rule, w in DIFFICULTY.values()), F.lit(0))
    c = cases.withColumn("score", score).withColumn("labels", F.when(F.size(labels) == 0, F.array(F.lit("single_function_direct"))).otherwise(labels))
    return c.withColumn("bucket", F.when(F.col("score") >= 4, "hard").when(F.col("score") >= 2, "medium").otherwise("easy"))


def budget_curve(cases: DataFrame, budgets: tuple[int, ...] = (1, 2, 3, 5, 8)) -> DataFrame:
    """(budget, solved, rate, marginal): cases (first_success_rank) solved within each budget."""
    n = cases.agg(F.count("*").alias("cases"), *[count_if(F.coalesce(F.col("first_success_rank") <= b, F.lit(False))).alias(f"b{b}") for b in budgets])
    steps = [F.struct(F.lit(b).alias("budget"), F.col(f"b{b}").alias("solved"), share(f"b{b}", "cases").alias("rate"), (F.col(f"b{b}") - (F.col(f"b{p}") if p else F.lit(0))).alias("marginal"))
             for p, b in zip((0, *budgets), budgets, strict=False)]
    return n.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def budget_effort(analysis: DataFrame) -> DataFrame:
    """Per case: effort (first success by evaluated, 1 without), wasted after success, pressure."""
    first = F.col("first_success_rank")
    return analysis.select("case_id", F.coalesce(share(first, "evaluated"), F.lit(1.0)).alias("effort_or_zero"),
                           F.when(first.isNull(), 1.0).otherwise(share(first, "evaluated")).alias("effort"),
                           F.coalesce(F.col("evaluated") - first, F.lit(0)).cast("long").alias("wasted"), share("failures_before", "evaluated").alias("pressure")).drop("effort_or_zero")


def competition(attempts: DataFrame, *by: str) -> DataFrame:
    """Per case: inversion, pressure, distinct rules, failures and variants."""
    first = F.min(F.when(F.col("success"), F.col("rank")))
    g = attempts.groupBy(*by).agg(F.count("*").alias("evaluated"), first.alias("first"), F.countDistinct("rule").alias("rules"),
                                  F.countDistinct(F.when(~F.col("success"), F.col("failure_type"))).alias("failures"), F.countDistinct("variant").alias("variants"))
    before = F.coalesce(F.col("first") - 1, F.col("evaluated"))
    return g.select(*by, "evaluated", F.coalesce(F.col("first") > 1, F.lit(False)).alias("inversion"), share(before, "evaluated").alias("pressure"), "rules", "failures", "variants")


def rerank_lift(rows: DataFrame, budget: int = 3) -> DataFrame:
    """Per case: its best success by (sensitive, lift, bonus, -rank); ``rows``: base_rank, rank, bonus, success.

    Sensitive: inside the budget after reranking and outside before.
    """
    lift = F.col("base_rank") - F.col("rank")
    sensitive = (F.col("base_rank") > budget) & (F.col("rank") <= budget)
    best = F.max(F.when(F.col("success"), F.struct(sensitive.cast("int").alias("sensitive"), lift.alias("lift"), "bonus", (-F.col("rank")).alias("neg"))))
    return rows.groupBy("case_id").agg(best.alias("b")).select(
        "case_id", F.coalesce("b.sensitive", F.lit(0)).alias("sensitive"), F.col("b.lift").alias("lift"), (-F.col("b.neg")).alias("rank"))


def reflection(attempts: DataFrame) -> DataFrame:
    """(parent_failure, children, rate, mean_delta): attempts by the failure of their parent in the same case."""
    p = attempts.select("case_id", F.col("id").alias("parent_id"), F.col("failure_type").alias("parent_failure"), F.col("score").alias("parent_score"))
    c = attempts.where("parent_id is not null").join(p, ["case_id", "parent_id"], "left")
    return c.groupBy(F.coalesce("parent_failure", F.lit("unknown")).alias("parent_failure")).agg(
        F.count("*").alias("children"), mean_or_zero(F.col("success").cast("int")).alias("rate"), F.avg(F.col("score") - F.col("parent_score")).alias("mean_delta"))


def failure_clusters(rows: DataFrame, keys: list[str], examples: int = 3) -> DataFrame:
    """Clusters of rows that aren't aligned successes: count, mean scores and delta, and the first few ids."""
    r = rows.where(~(F.col("success") & (F.col("agreement") == "aligned")))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    few = r.withColumn("_n", nth).where(F.col("_n") <= examples).groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("examples"))
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("raw"), F.avg("evidence").alias("calibrated"))
    return g.withColumn("delta", F.col("calibrated") - F.col("raw")).join(few, keys)


def cluster_priority(n: str = "n", delta: str = "delta") -> Column:
    return F.when((F.col(n) >= 3) | (F.abs(delta) >= 0.35), "high").when((F.col(n) >= 2) | (F.abs(delta) >= 0.20), "medium").otherwise("low")


def cluster_focus() -> Column:
    return (F.when(F.col("agreement") == "judge_more_optimistic", "judge false-positive hardening").when(F.col("agreement") == "judge_more_conservative", "judge false-negative recovery")
            .when(F.col("failure_type") == "test_failure", "near-miss semantic repair").otherwise("execution-evidence calibration"))


# How many cases of each difficulty label and bucket are wanted, how many source groups, and how many cases of each.
LABEL_TARGETS = {"multi_ground_truth": 2, "multi_patch_bundle": 2, "wide_beam_search": 2, "failed_before_success": 2, "reflection_depth": 2, "cross_file_patch": 3,
                 "patch_candidate_competition": 8, "cross_function_trace": 8}
BUCKET_TARGETS = {"hard": 5}
MIN_GROUPS, MIN_CASES_A_GROUP = 4, 5


def target_gaps(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, signal, wanted, have, gap, priority, place) of targets that aren't reached.

    ``targets``: source, signal, wanted, ordinal; of repeated ones of a source
    and signal the last counts. ``counts``: source, signal, n; absent ones are
    0. Placed by priority, gap, source and signal, the greatest first.
    """
    last = targets.groupBy("source", "signal").agg(F.max_by("wanted", "ordinal").alias("wanted"))
    j = last.join(counts, ["source", "signal"], "left").withColumn("have", F.coalesce("n", F.lit(0))).withColumn("gap", F.col("wanted") - F.col("have")).where("gap > 0")
    rank = F.when((F.col("have") == 0) | (F.col("gap") >= 3), 3).when(F.col("gap") >= 2, 2).otherwise(1)
    j = j.withColumn("_r", rank)
    place = F.row_number().over(Window.orderBy(F.desc("_r"), F.desc("gap"), F.desc("source"), F.desc("signal")))  # a row a target
    return j.select("source", "signal", "wanted", "have", "gap", F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("_r")).alias("priority"), place.alias("place"))


def stable_ref(ref: str) -> Column:
    """Tags, full digests and version numbers are stable; branches and names like main are not."""
    r = F.trim(F.col(ref))
    return (F.when(r == "", False).when(r.startswith("refs/tags/"), True).when(r.startswith("refs/heads/"), False)
            .when(F.lower(r).isin("head", "latest", "main", "master", "develop", "development", "dev", "trunk", "stable"), False)
            .when(r.rlike("^[0-9a-fA-F]{40}$"), True).otherwise(r.rlike(r"^v?[0-9]+(\.[0-9]+){1,3}([-+][0-9A-Za-z._-]+)?$")))


def provenance(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: coverage shares, largest file share, duplicate rate, leakage score and risk level.

    ``rows``: case_id, ref, sha, licence, mutated (bool), file, signature.
    """
    total = F.count("*")
    g = rows.groupBy(*by).agg(
        total.alias("n"), mean_or_zero((F.col("ref").isNotNull() & F.col("licence").isNotNull()).cast("int")).alias("provenance"), mean_or_zero(F.col("sha").isNotNull().cast("int")).alias("digest"),
        mean_or_zero(F.coalesce(stable_ref("ref"), F.lit(False)).cast("int")).alias("stable"), mean_or_zero(F.col("licence").isNotNull().cast("int")).alias("licensed"), mean_or_zero(F.col("mutated").cast("int")).alias("mutation"))
    files = rows.groupBy(*by, "file").agg(total.alias("f")).groupBy(*by).agg(F.max("f").alias("most"))
    dups = rows.groupBy(*by, "signature").agg(total.alias("s")).groupBy(*by).agg(F.sum(F.when(F.col("s") > 1, F.col("s")).otherwise(0)).alias("dups"))
    g = g.join(files, list(by)).join(dups, list(by)).withColumn("concentration", share("most", "n")).withColumn("duplicates", share("dups", "n"))
    score = (0.20 * (1 - F.col("provenance")) + 0.20 * (1 - F.col("mutation")) + 0.15 * F.when(F.col("digest") > 0, 1 - F.col("digest")).otherwise(0.0) + 0.10 * (1 - F.col("stable"))
             + 0.25 * F.col("duplicates") + 0.10 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("concentration") - 0.50) / 0.50))
    return g.withColumn("leakage", score).drop("most", "dups").withColumn("risk", F.when(F.col("leakage") >= 0.50, "high").when(F.col("leakage") >= 0.25, "medium").otherwise("low"))


def mining_quality(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: a mean of ten bounded terms and whether the group is ready.

    ``rows``: provenance's columns, sources, hits, density, rules, types, groups.
    """
    one = lambda c, most=1.0: F.least(F.lit(1.0), F.col(c) / most)
    terms = [share("hits", "sources"), one("density"), one("rules", 3.0), one("types", 3.0), one("groups", 2.0), F.col("provenance"), F.col("stable"),
             F.when(F.col("digest") > 0, F.col("digest")).otherwise(1.0), F.col("licensed"), 1 - F.col("leakage")]
    return rows.select(*by, (sum(terms) / len(terms)).alias("quality"), ((F.col("provenance") >= 0.95) & (F.col("leakage") <= 0.30)).alias("ready"))


# Ablation variants that a signal is linked to, best first.
SIGNAL_LINKS = {
    "search_score_inversion": ("without_patch_prior", "without_diversity_reranking", "without_beam_search", "without_reflection"),
    "search_candidate_competition": ("without_beam_search", "without_candidate_deduplication", "without_diversity_reranking", "without_multi_patch_repair", "without_patch_prior"),
    "search_failure_pressure": ("without_beam_search", "without_reflection", "without_diversity_reranking", "without_patch_prior"),
    "reflection_depth": ("without_reflection", "without_beam_search"),
    "search_diversity_reranking": ("without_diversity_reranking", "without_beam_search", "without_patch_prior"),
    "candidate_deduplication_pressure": ("without_candidate_deduplication", "without_beam_search"),
    "weak_slice_grounding": ("without_data_dependency", "without_control_flow", "without_caller_impact", "without_module_dependency", "without_line_coverage", "without_path_coverage", "without_branch_coverage"),
    "weak_slice_support": ("without_data_dependency", "without_control_flow", "without_caller_impact", "without_module_dependency", "without_line_coverage", "without_path_coverage"),
    "weak_failed_test_reachability": ("without_test_signals", "without_line_coverage", "without_branch_coverage", "without_path_coverage", "without_caller_impact"),
    "weak_call_chain_coverage": ("without_caller_impact", "without_module_dependency", "without_async_call_graph", "without_pagerank"),
    "fragile_top1_margin": ("without_data_dependency", "without_control_flow", "without_test_signals", "without_semantic_similarity", "without_pagerank", "without_static_rules"),
    "cross_function_data_flow": ("without_data_dependency",), "subscript_key_flow": ("without_data_dependency",), "without_data_dependency": ("without_data_dependency",),
    "without_graph_bundle_search": ("without_graph_bundle_search",), "without_multi_patch_repair": ("without_multi_patch_repair",), "without_static_rules": ("without_static_rules",),
    "without_rule_precision_filter": ("without_rule_precision_filter",), "without_beam_search": ("without_beam_search",), "without_reflection": ("without_reflection",),
    "without_patch_prior": ("without_patch_prior",), "without_diversity_reranking": ("without_diversity_reranking",), "without_candidate_deduplication": ("without_candidate_deduplication",)}


def signal_links(rows: DataFrame, signal: str) -> DataFrame:
    """Rows with ``variant``, ``place`` (from 1) and ``priority`` for each link of their signal; unknown signals have none.

    Priority is 1 for the link of diversity reranking to its own ablation, else 0.
    """
    links = F.create_map(*[x for s, vs in SIGNAL_LINKS.items() for x in (F.lit(s), F.array(*map(F.lit, vs)))])
    out = rows.select("*", F.posexplode(F.element_at(links, F.col(signal))).alias("_at", "variant"))
    own = (F.col(signal) == "search_diversity_reranking") & (F.col("variant") == "without_diversity_reranking")
    return out.withColumn("place", F.col("_at") + 1).withColumn("priority", own.cast("int")).drop("_at")


def seed_rows(clusters: DataFrame, n: int, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """The n largest clusters as seeds: slug, expected rule and bug type by failure type (with a default)."""
    top = clusters.orderBy(F.desc("n"), "failure_type", "agreement").limit(n)
    slug = F.regexp_replace(F.lower(F.concat_ws("-", "failure_type", "agreement")), "[^a-z0-9]+", "-")
    pick = lambda i, default: F.coalesce(F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, v[i])])[F.col("failure_type")], F.lit(default))
    return top.select(F.concat(F.lit("seed-"), slug).alias("seed"), pick(0, "unknown_rule").alias("rule"), pick(1, "general").alias("bug_type"), "n")


def component_rollup(impacts: DataFrame, components: dict[str, str]) -> DataFrame:
    """(component, variants, regressions, improvements, strongest, impact) of variant impacts."""
    pairs = F.create_map(*[F.lit(x) for kv in components.items() for x in kv])
    r = impacts.withColumn("component", F.coalesce(pairs[F.col("variant")], F.lit("other")))
    top = F.max(F.struct(F.round(F.abs("impact"), 9).alias("size"), "variant"))
    return r.groupBy("component").agg(
        F.count("*").alias("variants"), count_if(F.col("direction") == "regression").alias("regressions"), count_if(F.col("direction") == "improvement").alias("improvements"), top.alias("t")).select(
        "component", "variants", "regressions", "improvements", F.col("t.variant").alias("strongest"), F.col("t.size").alias("impact"))


def breakdown(cases: DataFrame, tag: str) -> DataFrame:
    """Per tag (exploded from an array): cases, success rate, inversions, mean pressure, sorted names of the first related ones."""
    r = cases.withColumn("tag", F.explode(F.array_distinct(tag)))
    return r.groupBy("tag").agg(F.count("*").alias("cases"), mean_or_zero(F.col("success").cast("int")).alias("success_rate"), count_if("inversion").alias("inversions"), F.avg("pressure").alias("pressure"))


def worst_stratum(strata: DataFrame, *by: str) -> DataFrame:
    """The stratum of the largest ECE, ties by count and then value."""
    return strata.groupBy(*by).agg(F.max(F.struct(F.round("ece", 9).alias("ece"), "count", "value")).alias("w")).select(*by, F.col("w.value").alias("value"), F.col("w.ece").alias("ece"), F.col("w.count").alias("count"))


