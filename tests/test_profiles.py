"""Profiles over long cases."""

from pyspark.sql import functions as F

from tesserae.operators import experiments


def test_long_cases_are_dealt_in_blocks(spark, monkeypatch):
    """A case with a third of all rows is several tasks; blocks change no result."""
    lists = spark.range(900).selectExpr("if(id % 3 = 0, 1, cast(id as int)) as case_id", "cast(if(id % 3 = 0, null, 2) as int) as grp", "id as item", "id % 5 = 0 as relevant", "cast(id as int) as rank", "(id * 37 % 101) / 100.0 as a", "(id * 53 % 97) / 96.0 as risk")
    profiles = [{"profile": f"p{i}", "a": 0.1 * i, "risk": 0.05 * (i % 3)} for i in range(12)]
    numbered = [{"profile": i, "a": p["a"], "risk": p["risk"]} for i, p in enumerate(profiles)]
    dealt = experiments.beside_profiles(lists, numbered, rows_a_task=700)
    assert dealt.count() == 900 * 12 and dealt.where("case_id = 1 and grp is null").select("block").distinct().count() == 6
    # what the windows need is in place: a block, profile, case and group in one task
    spread = dealt.withColumn("task", F.spark_partition_id()).groupBy("case_id", "grp", "block", "p.profile").agg(F.count_distinct("task").alias("n"))
    assert spread.where("n > 1").count() == 0
    columns = ["profile", "case_id", "grp", "item", "relevant", "rank"]
    whole = experiments.rerank(lists, profiles, ["a", "risk"]).select(columns)
    real = experiments.beside_profiles
    monkeypatch.setattr(experiments, "beside_profiles", lambda rows, p: real(rows, p, 700))
    cut = experiments.rerank(lists, profiles, ["a", "risk"])
    assert cut.select(columns).exceptAll(whole).count() == 0 and cut.count() == whole.count()
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1
    assert "hashpartitioning(block" not in plan  # nothing is shuffled once it was multiplied


def test_metrics_of_whole_lists_equal_windows(spark):
    """Lists that are held whole, long ones, repeated items and null signals; ranks come from a sort of numbers."""
    lists = spark.range(1200).selectExpr(
        "cast(case when id % 4 = 0 then 1 else id % 90 end as int) as case_id", "cast(if(id % 4 = 0, null, id % 90 % 3) as int) as grp", "if(id in (41, 131), 5000, id) as item",
        "id % 90 <> 7 and id % 5 = 1 as relevant", "cast(id as int) as rank", "if(id = 77, null, (id * 37 % 101) / 100.0) as a", "(id * 53 % 97) / 96.0 as risk")
    profiles = [{"profile": f"p{i}", "a": 0.1 * (i // 3), "risk": 0.05 * (i % 3)} for i in range(12)]
    by_windows = experiments.per_list(experiments.rerank(lists, profiles, ["a", "risk"]), ["profile", "case_id", "grp"]).groupBy("profile", "grp").agg(
        F.count("*"), F.avg(experiments.within(1)), F.avg(experiments.within(3)), F.avg("reciprocal"), F.avg("ap"), F.avg("ndcg"), F.avg("exam"))
    want = {(f"p{r[0]}", r[1]): [round(float(x), 9) for x in r[2:]] for r in by_windows.collect()}
    for rows in (100, 1 << 20):
        got = experiments.profile_metrics(lists, profiles, ["a", "risk"], "grp", list_rows=rows)
        assert {(r.profile, r.grp): [round(float(r[c]), 9) for c in ("cases", "top1", "top3", "mrr", "map", "ndcg", "exam")] for r in got.collect()} == want
    assert experiments.profile_metrics(lists.limit(0), profiles, ["a", "risk"]).count() == 0


def test_items_are_not_multiplied_by_profiles(spark, small):
    """No sort or exchange of the plan sees a row for an item and profile."""
    lists = spark.range(900).selectExpr("id % 30 as case_id", "id % 3 as grp", "id as item", "id % 5 = 0 as relevant", "cast(id as int) as rank", "(id * 37 % 101) / 100.0 as a")
    plan = experiments.profile_metrics(lists, [{"profile": f"p{i}", "a": 0.1 * i} for i in range(12)], ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
