"""Run reports, comparisons and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import count_if, mean_or_zero, share


def compare_runs(old: DataFrame, new: DataFrame, key: str, metrics: list[str], slack: float = 1e-9) -> DataFrame:
    """(key, change, deltas as d_*): added, missing, mixed, regressed, improved or unchanged. Larger metrics are better.

    A full outer join on the run's key, so runs of one side only stay.
    """
    a = old.select(key, F.lit(True).alias("_a"), *[F.col(m).alias(f"a_{m}") for m in metrics])
    b = new.select(key, F.lit(True).alias("_b"), *[F.col(m).alias(f"b_{m}") for m in metrics])
    d = [F.coalesce(F.col(f"b_{m}") - F.col(f"a_{m}"), F.lit(0.0)) for m in metrics]
    up, down = F.greatest(*d, F.lit(0.0)) > slack, F.least(*d, F.lit(0.0)) < -slack
    change = (F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").when(up & down, "mixed").when(down, "regressed").when(up, "improved").otherwise("unchanged"))
    return a.join(b, key, "full").select(key, change.alias("change"), *[x.alias(f"d_{m}") for x, m in zip(d, metrics, strict=True)])


def rollup(rows: DataFrame, dimensions: dict[str, Column], name: str, examples: int = 3) -> DataFrame:
    """(dimension, value, n, names): counts of each value of each dimension in one pass, with the first few run names."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("value")) for d, c in dimensions.items()]))
    long = rows.select(name, each.alias("x")).select(name, "x.*")
    counts = long.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("dimension", "value").orderBy(name))
    few = long.select("dimension", "value", name).distinct().withColumn("_n", nth).where(F.col("_n") <= examples).groupBy("dimension", "value").agg(F.array_sort(F.collect_list(name)).alias("names"))
    return counts.join(few.withColumnRenamed("value", "v").withColumnRenamed("dimension", "d"), (F.col("dimension") == F.col("d")) & F.col("value").eqNullSafe(F.col("v"))).select("dimension", "value", "n", "names")


def batch_rollup(rows: DataFrame, by: str, status: str, issue: str) -> DataFrame:
    """Per batch: runs, ready share, top issue (most often, then name)."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), mean_or_zero((F.col(status) == "ready").cast("int")).alias("ready"))
    top = rows.where(F.col(issue).isNotNull()).groupBy(by, issue).agg(F.count("*").alias("_c")).groupBy(by).agg(F.max_by(issue, F.struct("_c", issue)).alias("top_issue"))
    return g.join(top, by, "left")


def required_coverage(rows: DataFrame, tag: str, name: str, required: list[str]) -> DataFrame:
    """(tag, n, first): each required tag with how many rows have it and the first of them; absent ones stay with 0."""
    want = rows.sparkSession.createDataFrame([(t,) for t in required], f"{tag} string")
    have = rows.groupBy(tag).agg(F.count("*").alias("n"), F.min(name).alias("first"))
    return want.join(have, tag, "left").select(tag, F.coalesce("n", F.lit(0)).alias("n"), "first")


def artifact_coverage(rows: DataFrame, name: str, artifacts: str, required: list[str]) -> DataFrame:
    """(artifact, present, missing, first_gap): per required artifact, over rows with an array of those they have."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("artifact"), F.array_contains(artifacts, a).alias("has")) for a in required]))
    r = rows.select(name, each.alias("x")).select(name, "x.*")
    return r.groupBy("artifact").agg(count_if("has").alias("present"), count_if(~F.col("has")).alias("missing"), F.min(F.when(~F.col("has"), F.col(name))).alias("first_gap"))


def outcome_class() -> Column:
    """From reflections, validated, candidates, mode and status columns."""
    direct = F.col("mode").isin("llm", "hybrid") & (F.col("status") == "pass") & (F.col("candidates") > 0) & (F.col("validated") > 0)
    return F.when(F.col("reflections") > 0, "llm_reflection_success").when(F.coalesce(direct, F.lit(False)), "llm_direct_success").otherwise("llm_blocker")


# Words that tell blockers apart, in order.
BLOCKERS = {
    "safety_gate_blocker": ("safety_gate", "safety gate", "scope_not_limited"),
    "no_test_oracle_blocker": ("no_test_oracle", "no test oracle", "no_tests", "no tests", "no_test_command", "no_recommended_test_command", "no recommended test command", "validation_args_missing",
                               "no_failing_test", "no failing test", "missing failing test", "nodeid_missing", "no nodeid", "dynamic_evidence:not_usable", "dynamic evidence not usable", "oracle_missing"),
    "llm_failed_blocker": ("llm", "api_key", "missing_api_key"),
    "environment_blocker": ("environment", "dependency", "missing_dependency", "module_not_found", "modulenotfounderror", "importerror", "test_tool_missing", "setup_install_failure", "pytest_plugin",
                            "collection error", "collection_failure", "tox", "nox", "timeout")}


def blocker_category(text: Column, safety_blocked: Column, validated: Column, status: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    has = lambda kind: t.rlike("|".join(w.replace(".", r"\.") for w in BLOCKERS[kind]))
    return (F.when((safety_blocked > 0) & (validated <= 0), "safety_gate_blocker").when(has("safety_gate_blocker"), "safety_gate_blocker").when(has("no_test_oracle_blocker"), "no_test_oracle_blocker")
            .when(status.isin("blocked", "unavailable", "failed") | has("llm_failed_blocker"), "llm_failed_blocker").when(has("environment_blocker"), "environment_blocker").otherwise("generic_blocker"))


OUTCOMES = ("llm_reflection_success", "llm_direct_success", "llm_blocker")
CATEGORIES = (*BLOCKERS, "generic_blocker")


def outcome_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: counts by class, of them with complete evidence, of blockers by category, success share, sums, and means over known values.

    ``rows``: outcome, evidence (complete or not), category (of blockers),
    candidates, runtime, tokens, cost.
    """
    is_ = lambda c: F.col("outcome") == c
    known = ("runtime", "tokens", "cost")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), *[count_if(is_(c)).alias(c) for c in OUTCOMES], *[count_if(is_(c) & (F.col("evidence") == "complete")).alias(f"{c}_evidence") for c in OUTCOMES],
        *[count_if(is_("llm_blocker") & (F.col("category") == c)).alias(c) for c in CATEGORIES],
        mean_or_zero((F.col("outcome") != "llm_blocker").cast("int")).alias("success_rate"), F.sum("candidates").alias("candidates"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in known], *[F.count(c).alias(f"known_{c}") for c in known], *[F.avg(c).alias(f"mean_{c}") for c in known])


def catalogue_audit(catalogue: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, status, class_ok): declared cases by the first alias (in order) that a result has; matched, mismatch or missing.

    ``catalogue``: case_id, aliases (array), expected; ``results``: alias, actual.
    """
    keys = catalogue.select("case_id", "expected", F.posexplode("aliases").alias("at", "alias"))
    met = keys.join(results, "alias").groupBy("case_id").agg(F.min_by("actual", "at").alias("actual"))
    j = catalogue.select("case_id", "expected").join(met, "case_id", "left")
    return j.select("case_id", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("expected"), "matched").otherwise("mismatch").alias("status"))


def trace_complete(rows: DataFrame, case: str, step: str, text: str, steps: list[str]) -> DataFrame:
    """(case, complete): all the loop's steps are there and not blank."""
    ok = rows.where(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy(case).agg(F.size(F.array_intersect(F.collect_set(step), F.array(*map(F.lit, steps)))).alias("_n"))
    return rows.select(case).distinct().join(ok, case, "left").select(case, (F.coalesce("_n", F.lit(0)) == len(steps)).alias("complete"))


def rejection_audit(rows: DataFrame, group: str, reason: str, id_: str, examples: int = 3) -> DataFrame:
    """(group, reason, n, examples, dominant): counts by reason, the first few rows, and whether it is the group's most frequent one."""
    g = rows.groupBy(group, reason).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(group, reason).orderBy(id_))
    few = rows.withColumn("_n", nth).where(F.col("_n") <= examples).groupBy(group, reason).agg(F.array_sort(F.collect_list(id_)).alias("examples"))
    top = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), reason)) == 1
    return g.withColumn("dominant", top).join(few, [group, reason])


def stage_rollup(rows: DataFrame, run: str, status: str, stage: str) -> DataFrame:
    """(run, passed, warned, failed, failed_stages, has_blockers, needs_attention)."""
    s = F.col(status)
    return rows.groupBy(run).agg(
        count_if(s == "pass").alias("passed"), count_if(s == "warn").alias("warned"), count_if(s == "fail").alias("failed"),
        F.array_sort(F.collect_set(F.when(s == "fail", F.col(stage)))).alias("failed_stages"), F.bool_or(s == "fail").alias("has_blockers"), F.bool_or(s.isin("fail", "warn")).alias("needs_attention"))


def primary_layer(rows: DataFrame, run: str) -> DataFrame:
    """(run, layer): in layer order the first fail or warn with a blocker, else the first fail or warn, else the first skip, else the first.

    ``rows``: run, layer, status, blocker, place.
    """
    bad = F.col("status").isin("fail", "warn")
    tier = F.when(bad & (F.coalesce("blocker", F.lit("")) != ""), 0).when(bad, 1).when(F.col("status") == "skip", 2).otherwise(3)
    return rows.groupBy(run).agg(F.min(F.struct(tier.alias("tier"), "place", "layer"))["layer"].alias("layer"))


def readiness_score(rows: DataFrame, *by: str) -> DataFrame:
    """100 times the mean of ready 1, partial .5, missing 0."""
    s = F.col("status")
    return rows.groupBy(*by).agg((100 * F.avg(F.when(s == "ready", 1.0).when(s == "partial", 0.5).otherwise(0.0))).alias("readiness"))


def ratio_report(rows: DataFrame, by: str, ok: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), share(count_if(ok), F.count("*")).alias("rate"))
