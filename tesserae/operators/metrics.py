"""Ranking and search metrics.

Lists are rows (case_id, item, rank); ``truth`` is rows (case_id, item) and
``cases`` names all cases, so that cases with an empty list or truth count too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import count_if, mean_or_zero, share


def judged(lists: DataFrame, truth: DataFrame) -> DataFrame:
    """Lists with ``relevant``."""
    return lists.join(truth.select("case_id", "item").distinct().withColumn("relevant", F.lit(True)), ["case_id", "item"], "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(False)))


def _places(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Lists with again (a repeated item), hits and place (fresh hits and items so far)."""
    rows = lists.withColumn("again", F.row_number().over(Window.partitionBy(*keys, "item").orderBy("rank")) > 1)
    running = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh_hit = F.col("relevant") & ~F.col("again")
    return rows.withColumn("hits", F.sum(fresh_hit.cast("int")).over(running)).withColumn("place", F.sum((~F.col("again")).cast("int")).over(running))


def _sums(k: int) -> list[Column]:
    fresh_hit = F.col("relevant") & ~F.col("again")
    return [
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(F.when(fresh_hit, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(fresh_hit, F.col("place"))).alias("first_place"), F.max("place").alias("n")]


def _measures(k: int) -> list[Column]:
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda acc, i: acc + F.when(i <= F.col("n_truth"), 1 / F.log2(i + 1.0)).otherwise(0.0))
    return [F.col("first"), share(F.lit(1), "first").alias("reciprocal"), share("precisions", "n_truth").alias("ap"),
            share("dcg", ideal).alias("ndcg"), F.coalesce((F.col("first_place") - 1) / F.col("n"), F.lit(1.0)).alias("exam")]


def per_case(lists: DataFrame, sizes: DataFrame, k: int = 3) -> DataFrame:
    """One row a case: first (rank of the first relevant item), reciprocal, ap, ndcg, exam.

    ``lists`` has relevant; ``sizes``: case_id and n_truth, a row for every
    case. Positions count repeats, but a repeated item counts as a hit once in
    AP; EXAM looks at the list without repeats; nDCG counts each position.
    """
    sums = _places(lists, ["case_id"]).groupBy("case_id").agg(*_sums(k))
    return sizes.join(sums, "case_id", "left").select(*sizes.columns, *_measures(k))


def per_list(lists: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """As per_case for many lists of a case (``keys``), whose truth is what is relevant in them.

    Lists that come with ``hits`` (relevant items so far) have no repeated items; then nothing is sorted again.
    """
    if "hits" in lists.columns:
        rows = lists.withColumn("again", F.lit(False)).withColumn("place", F.col("rank"))
    else:
        rows = _places(lists, keys)
    return rows.groupBy(*keys).agg(*_sums(k), count_if("relevant").alias("n_truth")).select(*keys, *_measures(k))


def within(k: int) -> Column:
    """Whether a case has a relevant item among the first k."""
    return F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")


def summary(cases: DataFrame, *by: str, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Means over cases, 0 for no case."""
    return cases.groupBy(*by).agg(
        F.count("*").alias("cases"), *[mean_or_zero(within(k)).alias(f"top{k}") for k in ks], mean_or_zero("reciprocal").alias("mrr"),
        mean_or_zero("ap").alias("map"), mean_or_zero("ndcg").alias("ndcg"), mean_or_zero("exam").alias("exam"))


def rule_overlap(expected: str, detected: str) -> list[Column]:
    """recall, precision (0 for an empty side) and extra rules of two array columns."""
    hits = F.size(F.array_intersect(expected, detected))
    extra = F.array_sort(F.array_except(detected, expected))
    return [share(hits, F.size(F.array_distinct(expected))).alias("recall"), share(hits, F.size(F.array_distinct(detected))).alias("precision"), extra.alias("extra")]


def search_analysis(attempts: DataFrame, *by: str) -> DataFrame:
    """Per case: evaluated, successful, first success rank and depth, failures before it, margin, efficiency.

    ``attempts``: rank, success, score, depth. margin is the first success's
    score less the best failed one's; efficiency 1 / (1 + failures + depth), 0 without success.
    """
    ok = F.col("success")
    first = F.min(F.when(ok, F.struct("rank", "depth", "score")))
    rows = attempts.groupBy(*by).agg(
        F.count("*").alias("evaluated"), count_if(ok).alias("successful"), F.max("depth").alias("max_depth"), first.alias("first"),
        F.max(F.when(~ok, F.col("score"))).alias("best_failed"))
    before = F.coalesce(F.col("first.rank") - 1, F.col("evaluated")).cast("long")
    return rows.select(
        *by, "evaluated", "successful", "max_depth", F.col("first.rank").alias("first_success_rank"), F.col("first.depth").alias("first_success_depth"),
        before.alias("failures_before"), (F.col("first.score") - F.coalesce("best_failed", F.lit(0.0))).alias("margin"),
        F.when(F.col("first").isNull(), 0.0).otherwise(1.0 / (1 + before + F.col("first.depth"))).alias("efficiency"))


def search_rates(analysis: DataFrame, *by: str) -> DataFrame:
    """Rates over cases of search_analysis; the mean first rank is over cases with one (null for none)."""
    rank = F.col("first_success_rank")
    return analysis.groupBy(*by).agg(
        F.count("*").alias("cases"), mean_or_zero((F.col("successful") > 0).cast("int")).alias("search_success"),
        mean_or_zero(F.coalesce(rank == 1, F.lit(False)).cast("int")).alias("top1_success"), mean_or_zero(share(F.lit(1), rank)).alias("search_mrr"),
        F.avg(rank.cast("double")).alias("mean_first_rank"),
        share(count_if((F.col("max_depth") > 1) & (F.col("successful") > 0)), count_if(F.col("max_depth") > 1)).alias("reflection_success"))


def failure_taxonomy(attempts: DataFrame, cases: DataFrame) -> DataFrame:
    """(failure_type, n): attempts by type, blank ones by success, and cases without a candidate or an evaluation.

    ``cases``: case_id, candidates, evaluated.
    """
    kind = F.when(F.trim(F.coalesce("failure_type", F.lit(""))) != "", F.col("failure_type")).otherwise(
        F.when(F.col("success"), "success").otherwise("unknown_failure"))
    none = F.when(F.coalesce("candidates", F.lit(0)) == 0, "no_candidate").when(F.coalesce("evaluated", F.lit(0)) == 0, "not_evaluated")
    return attempts.select(kind.alias("failure_type")).unionByName(
        cases.select(none.alias("failure_type")).where("failure_type is not null")).groupBy("failure_type").agg(F.count("*").alias("n"))


def success_at(k: int) -> Column:
    """Share of known first-success ranks up to k; over no known rank 0."""
    return mean_or_zero((F.col("first_success_rank") <= k).cast("int")).alias(f"success_at_{k}")


def bundle_risk(members: DataFrame, by: str) -> DataFrame:
    """Bundle totals and extremes of the members' size, callers and risk."""
    return members.groupBy(by).agg(
        F.count("*").alias("members"), F.sum("size").alias("size"), F.sum("callers").alias("callers"), F.max("risk").alias("max_risk"), F.avg("risk").alias("mean_risk"))
