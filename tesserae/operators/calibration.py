"""Calibration, uncertainty and attribution.

Rows have a confidence (0 to 1) and a hit. Bins are min(n - 1, int(confidence * n)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attach, clamp, count_if, share

BINS = 10


def bin_of(confidence: str = "confidence", bins: int = BINS) -> Column:
    return F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins)).cast("int")


def reliability(rows: DataFrame, *by: str, bins: int = BINS) -> DataFrame:
    """Per bin with rows: count, mean confidence, accuracy, gap."""
    hit = F.col("hit").cast("double")
    return rows.groupBy(*by, bin_of(bins=bins).alias("bin")).agg(
        F.count("*").alias("count"), F.avg("confidence").alias("mean_confidence"), F.avg(hit).alias("accuracy")).withColumn(
        "gap", F.abs(F.col("mean_confidence") - F.col("accuracy")))


def calibration(rows: DataFrame, *by: str, bins: int = BINS) -> DataFrame:
    """ECE, MCE, Brier and mean absolute error, in one pass over rows and one over bins."""
    hit = F.col("hit").cast("double")
    parts = rows.groupBy(*by, bin_of(bins=bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum(hit).alias("h"),
        F.sum(F.pow(F.col("confidence") - hit, 2)).alias("square"), F.sum(F.abs(F.col("confidence") - hit)).alias("absolute"))
    return parts.groupBy(*by).agg(
        F.sum("n").alias("count"), share(F.sum(F.abs(F.col("c") - F.col("h"))), F.sum("n")).alias("ece"),
        F.max(F.abs(F.col("c") - F.col("h")) / F.col("n")).alias("mce"), share(F.sum("square"), F.sum("n")).alias("brier"),
        share(F.sum("absolute"), F.sum("n")).alias("mae"))


def agreement() -> Column:
    """A hit with confidence under one half is underconfident, a miss from one half on overconfident."""
    c, hit = F.col("confidence"), F.col("hit")
    return F.when(hit & (c < 0.5), "underconfident").when(~hit & (c >= 0.5), "overconfident").otherwise("aligned")


def smoothed(positives: Column, count: Column, prior: Column, strength: float = 10.0) -> Column:
    return (positives + strength * prior) / (count + strength)


def leave_one_out(rows: DataFrame, strength: float = 10.0, bins: int = BINS) -> DataFrame:
    """Rows with ``calibrated``: the bin's rate without the row itself, drawn to the overall accuracy (kept within .05 and .95)."""
    hit = F.col("hit").cast("double")
    r = rows.withColumn("bin", bin_of(bins=bins))
    per_bin = r.groupBy("bin").agg(F.count("*").alias("_n"), F.sum(hit).alias("_pos"))
    prior = r.agg(clamp(F.coalesce(F.avg(hit), F.lit(0.0)), 0.05, 0.95).alias("_p0"))
    return attach(r.join(F.broadcast(per_bin), "bin"), prior, []).withColumn(
        "calibrated", smoothed(F.col("_pos") - hit, F.col("_n") - 1, F.col("_p0"), strength)).drop("_n", "_pos", "_p0")


def group_holdout(rows: DataFrame, group: str, strength: float = 10.0, bins: int = BINS) -> DataFrame:
    """Per group: ECE and Brier after calibration by bins of all other groups.

    The others' bins are the totals less the group's own, so nothing is fitted
    again. A single group gives no rows.
    """
    hit = F.col("hit").cast("double")
    own = rows.groupBy(group, bin_of(bins=bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(hit).alias("pos"))
    bin_all = own.groupBy("bin").agg(F.sum("n").alias("n_bin"), F.sum("pos").alias("pos_bin"))
    group_all = own.groupBy(group).agg(F.sum("n").alias("n_group"), F.sum("pos").alias("pos_group"))
    total = own.agg(F.sum("n").alias("n_all"), F.sum("pos").alias("pos_all"), F.countDistinct(group).alias("groups"))
    t = attach(own.join(bin_all, "bin").join(group_all, group), total, []).where("groups > 1")
    prior = clamp(share(F.col("pos_all") - F.col("pos_group"), F.col("n_all") - F.col("n_group")), 0.05, 0.95)
    t = t.withColumn("p", smoothed(F.col("pos_bin") - F.col("pos"), F.col("n_bin") - F.col("n"), prior, strength))
    square = F.col("pos") * F.pow(1 - F.col("p"), 2) + (F.col("n") - F.col("pos")) * F.pow(F.col("p"), 2)
    return t.groupBy(group).agg(
        F.sum("n").alias("count"), (F.sum(F.abs(F.col("n") * F.col("p") - F.col("pos"))) / F.sum("n")).alias("ece"),
        (F.sum(square) / F.sum("n")).alias("brier"))


def strata(rows: DataFrame, dimensions: list[str], bins: int = BINS) -> DataFrame:
    """Calibration by each value of each dimension: (dimension, value, ...)."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    return calibration(rows.select("confidence", "hit", each.alias("s")).select("confidence", "hit", "s.*"), "dimension", "value", bins=bins)


def within_tolerance(predicted: str, evidence: Column, tolerance: float = 0.25) -> Column:
    """aligned within the tolerance, else optimistic or conservative."""
    delta = F.col(predicted) - evidence
    return F.when(F.abs(delta) <= tolerance, "aligned").when(delta > 0, "optimistic").otherwise("conservative")


# Verdicts that stand for accepting and for rejecting.
ACCEPT, REJECT = ("prefer", "accept", "pass"), ("reject", "fail")


def verdict_outcomes(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of verdict against outcome; other verdicts, null ones too, are unknown."""
    verdict = F.lower(F.trim(F.coalesce("verdict", F.lit("unknown"))))
    yes, no, ok = verdict.isin(*ACCEPT), verdict.isin(*REJECT), F.col("success")
    return rows.groupBy(*by).agg(
        count_if(yes & ok).alias("accept_success"), count_if(yes & ~ok).alias("accept_failure"), count_if(no & ok).alias("reject_success"),
        count_if(no & ~ok).alias("reject_failure"), count_if(~yes & ~no).alias("unknown_verdict"),
        count_if((yes & ok) | (no & ~ok)).alias("aligned"), count_if((yes & ~ok) | (no & ok)).alias("mismatch"))


def bootstrap(rows: DataFrame, metrics: list[str], by: list[str], samples: int = 1000, level: float = 0.95, seed: int = 17) -> DataFrame:
    """(by, metric, mean, low, high): percentile intervals of the mean over resamples.

    Each row gets, for each resample, a Poisson(1) weight drawn from a number
    that the row's id, the resample and the seed give (squared twice modulo a
    prime, which any engine can do alike); sums are combined map-side, so a task
    sends one row for each group, metric and resample. Rows: an ``id`` and the
    metrics. A single row gives its own value as both ends.
    """
    prime = F.lit((1 << 31) - 1).cast("long")
    mixed = F.pmod(F.col("id") * 48271 + F.col("b").cast("long") * 69621 + seed, prime)
    mixed = F.pmod(mixed * mixed + F.col("b"), prime)
    draw = F.pmod(mixed * mixed + F.col("id"), prime) / prime.cast("double")
    # Poisson(1): its distribution function at 0, 1, 2, ...
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    weight = sum((draw >= p).cast("int") for p in steps)
    drawn = rows.select(*by, "id", *metrics, F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("b")).withColumn("w", weight)
    sums = drawn.groupBy(*by, "b").agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(m)).alias(m) for m in metrics]).where("n > 0")
    each = sums.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) / F.col("n")).alias("x")) for m in metrics])).alias("s")).select(*by, "s.*")
    ends = each.groupBy(*by, "metric").agg(
        F.percentile("x", F.lit((1 - level) / 2)).alias("low"), F.percentile("x", F.lit((1 + level) / 2)).alias("high"))
    real = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("s")).select(
        *by, "s.*").groupBy(*by, "metric").agg(F.avg("x").alias("mean"))
    return real.join(ends, [*by, "metric"])


def contributions(rows: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """(keys, component, contribution): weight times signal; nulls count as 0."""
    parts = [F.struct(F.lit(c).alias("component"), (F.coalesce(F.col(c), F.lit(0.0)) * w).alias("contribution")) for c, w in weights.items()]
    return rows.select(*keys, F.explode(F.array(*parts)).alias("p")).select(*keys, "p.*")


def margins(rows: DataFrame, case: str, limit: float = 0.02) -> DataFrame:
    """(case, top1, runner_up, margin, fragile) of ranked rows (rank, score)."""
    r = rows.groupBy(case).agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("runner_up"))
    margin = F.col("top1") - F.coalesce("runner_up", F.lit(0.0))
    return r.withColumn("margin", margin).withColumn("fragile", F.col("margin") <= limit)


def counterfactual_flips(rows: DataFrame, case: str, weights: dict[str, float]) -> DataFrame:
    """(case, component, flips): whether taking the component's share out of every
    score (kept in 0 to 1) puts another row strictly above the first-ranked one."""
    parts = [F.struct(F.lit(c).alias("component"), clamp(F.col("score") - w * F.coalesce(F.col(c), F.lit(0.0))).alias("left")) for c, w in weights.items()]
    each = rows.select(case, "rank", F.explode(F.array(*parts)).alias("p")).select(case, "rank", "p.*")
    return each.groupBy(case, "component").agg(
        F.max(F.when(F.col("rank") == 1, F.col("left"))).alias("top"), F.max(F.when(F.col("rank") > 1, F.col("left"))).alias("other")).select(
        case, "component", F.coalesce(F.col("other") > F.col("top"), F.lit(False)).alias("flips"))


def primary_component(parts: DataFrame, case: str, risk: str = "risk") -> DataFrame:
    """(case, component): the largest positive one except risk (ties: the larger name), else the largest in absolute value."""
    good = F.max(F.when((F.col("component") != risk) & (F.col("contribution") > 0), F.struct("contribution", "component")))
    some = F.max(F.struct(F.abs(F.col("contribution")).alias("size"), "component"))
    return parts.groupBy(case).agg(F.coalesce(good["component"], some["component"]).alias("component"))


def entropy(counts: DataFrame, count: str = "n") -> DataFrame:
    """Normalised entropy of the counts, 0 for fewer than two values; one row."""
    total = counts.agg(F.sum(count).alias("_all"), F.count("*").alias("_k"))
    p = F.col(count) / F.col("_all")
    return attach(counts, total, []).agg(
        F.max("_k").alias("values"), F.coalesce(F.try_divide(-F.sum(p * F.log2(p)), F.log2(F.max("_k").cast("double"))), F.lit(0.0)).alias("entropy"))


