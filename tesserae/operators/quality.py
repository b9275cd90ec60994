"""Validation and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import count_if, number


def violations(rows: DataFrame, key: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, severity, message) of each rule (severity, message, condition that is wrong) that a row breaks; null conditions hold."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for s, m, bad in rules])
    return rows.select(*key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select(*key, "v.*")


def repeats(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Second and later rows of a name, in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(order))).where("_n > 1").drop("_n")


def dangling(rows: DataFrame, key: str, wanted: str, known: str) -> DataFrame:
    """(key, value): elements of the array ``wanted`` that the row's array ``known`` lacks; rows without known ones pass."""
    return rows.where(F.size(known) > 0).select(key, F.explode(F.array_except(wanted, known)).alias("value"))


def safe_path(path: str) -> Column:
    """Non-empty, not absolute, without a .. segment."""
    p = F.coalesce(path, F.lit(""))
    return (p != "") & ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..")


def is_digest(x: str) -> Column:
    return F.coalesce(F.col(x).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def gate(metrics: DataFrame, thresholds: dict[str, float], key: str, slack: float = 1e-12) -> DataFrame:
    """(key, check, expected, actual, passed): min_x asks for x from the limit on, max_x up to it, no prefix is min.

    Thresholds are literals; a missing metric is 0.
    """
    have = set(metrics.columns)
    checks = []
    for name, limit in thresholds.items():
        metric = name.removeprefix("min_").removeprefix("max_")
        actual = number(metric) if metric in have else F.lit(0.0)
        ok = actual <= limit + slack if name.startswith("max_") else actual >= limit - slack
        checks.append(F.struct(F.lit(name).alias("check"), F.lit(float(limit)).alias("expected"), actual.alias("actual"), ok.alias("passed")))
    return metrics.select(key, F.explode(F.array(*checks)).alias("c")).select(key, "c.*")


def small_groups(rows: DataFrame, group: str, floor: int) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < floor)


def missing_evidence(cases: DataFrame, attempts: DataFrame, case: str) -> DataFrame:
    """Successful cases without an attempt that supports it: of success type, or with passes, or without failures."""
    proof = attempts.where("success and (failure_type = 'success' or passed > 0 or failed = 0)").select(case).distinct()
    return cases.where("success").join(proof, case, "left_anti")


def missing_signals(ranked: DataFrame, case: str, signals: str, required: list[str]) -> DataFrame:
    """(case, missing): required keys that the first-ranked row's map of signals lacks."""
    gone = F.array_except(F.array(*map(F.lit, required)), F.map_keys(signals))
    return ranked.where("rank = 1").select(case, F.array_sort(gone).alias("missing")).where(F.size("missing") > 0)


def expectations(rows: DataFrame, key: str, pairs: list[tuple[str, Column, Column]]) -> DataFrame:
    """(key, field, expected, actual, passed) of each (field, expected, actual) with an expectation."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), e.cast("string").alias("expected"), a.cast("string").alias("actual")) for n, e, a in pairs])
    out = rows.select(key, F.explode(F.filter(each, lambda x: x["expected"].isNotNull())).alias("x")).select(key, "x.*")
    return out.withColumn("passed", F.col("expected").eqNullSafe(F.col("actual")))


def acceptance(rows: DataFrame, key: str, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """(key, name, passed) of typed checks (name, type, expected, actual): minimum, equals, prefix, boolean, contains. No expectation, no row."""
    def holds(kind, expected, actual):
        return {"minimum": lambda: actual.cast("double") >= expected.cast("double"), "equals": lambda: actual == expected, "prefix": lambda: actual.startswith(expected),
                "boolean": lambda: actual.cast("boolean") == expected.cast("boolean"), "contains": lambda: actual.contains(expected)}[kind]()

    each = F.array(*[F.when(e.isNotNull(), F.struct(F.lit(n).alias("name"), F.coalesce(holds(k, e, a), F.lit(False)).alias("passed"))) for n, k, e, a in checks])
    return rows.select(key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def doctor(rows: DataFrame, key: str, checks: list[tuple[str, bool, Column]]) -> DataFrame:
    """(key, score, blocker, status) of ordered checks (name, blocking, ok): share passed, the first failed one; a blocking failure fails, others warn."""
    made = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("blocking"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, b, ok in checks])
    bad = F.filter("_c", lambda c: ~c["ok"])
    status = F.when(F.exists(bad, lambda c: c["blocking"]), "fail").when(F.size(bad) > 0, "warn").otherwise("pass")
    return rows.withColumn("_c", made).select(key, ((F.size("_c") - F.size(bad)) / F.size("_c")).alias("score"), F.coalesce(F.get(bad, F.lit(0))["name"], F.lit("")).alias("blocker"), status.alias("status"))


def completeness(rows: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """Counts of each flag in each group."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
