"""Selection under diversity.

Greedy choices look at what was chosen before, so they walk through one case at
a time, as grouped pandas. What a walk holds is bounded first, without changing
its result: rows that are alike in all features a choice looks at can only be
chosen best first, so of each such kind the k best are enough where k rows are
wanted. Where all rows are ranked, the walk sees the best row of each
kind, and the others take their places by a sort. Selections that need no memory of earlier choices but a
running number are windows, which spill.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import count_if, share
from ..sources.storage import stored
from .sequences import cut, numbered


def _best_of_kind(rows: DataFrame, case: str, kind: list, order: list, k: int) -> DataFrame:
    """The first k rows of each case and kind."""
    w = Window.partitionBy(case, *kind).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def _greedy(rows: DataFrame, case: str, kinds: tuple[tuple[str, float], ...], worth: str, tie: str, weight: float = 1.0,
            most: float | None = None, plain_first: bool = False) -> DataFrame:
    """Rows with ``bonus`` and ``rank``: take again and again the row of greatest worth + weight * bonus.

    The bonus adds up the weights of the kinds whose value was not taken before
    (up to ``most``); ties go to the worth, then to ``tie``, then to the id.
    With ``plain_first`` the first row is chosen without a bonus. ``id`` tells
    the rows of a case apart.

    Only the first row of each combination of values can have a bonus, and
    later ones change nothing for others. So a walk, a case at a time, looks at
    these heads alone. What a head was worth when it was taken only falls from
    one to the next, as bonuses do, so the order of all rows is that of their
    worth when taken, which for all others is their own: a sort, cut by ranges.
    """
    names = [k for k, _ in kinds]
    first = F.min(F.struct((-F.col(worth)).alias("w"), F.col(tie).alias("t"), F.col("id").alias("id")))
    heads = rows.groupBy(case, *names).agg(first.alias("h")).select(case, *names, (-F.col("h.w")).alias("worth"), F.col("h.t").alias("tie"), F.col("h.id").alias("id"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["worth", "tie", "id"], ascending=[False, True, True]).to_dict("records")
        seen: list[set] = [set() for _ in kinds]
        begun, out = not plain_first, []

        def bonus(r: dict) -> float:
            new = 0.0
            for (k, w), s in zip(kinds, seen, strict=True):
                # added one by one, as SQL does: sum() makes up for rounding, and ties turn on the last bit
                new += w if begun and r[k] not in s else 0.0
            return min(new, most) if most is not None else new

        if plain_first:
            r = ordered[0]
            out.append((r[case], r["id"], float("inf"), 0.0))
            for k, s in zip(names, seen, strict=True):
                s.add(r[k])
            begun = True
        # bonuses only fall, so what is on top and still worth as much is the best
        heap = [(-(r["worth"] + weight * bonus(r)), i) for i, r in enumerate(ordered) if i or not plain_first]
        heapq.heapify(heap)
        while heap:
            value, i = heap[0]
            r = ordered[i]
            now, got = -(r["worth"] + weight * bonus(r)), bonus(r)
            if now > value:
                heapq.heapreplace(heap, (now, i))
                continue
            heapq.heappop(heap)
            out.append((r[case], r["id"], -value, got))
            for k, s in zip(names, seen, strict=True):
                s.add(r[k])
        return pd.DataFrame(out, columns=[case, "id", "_taken", "bonus"])

    kind_of = dict(rows.dtypes)
    taken = heads.groupBy(case).applyInPandas(walk, f"{case} {kind_of[case]}, id {kind_of['id']}, _taken double, bonus double")
    order = F.struct((-F.coalesce("_taken", F.col(worth).cast("double"))).alias("v"), (-F.col(worth)).alias("w"), F.col(tie).alias("t"), F.col("id").alias("i"))
    placed = cut(rows.join(taken, [case, "id"], "left").withColumn("_order", order), case, "_order")
    return numbered(placed, case, "_order", "rank").withColumn("bonus", F.coalesce("bonus", F.lit(0.0))).select(*rows.columns, "bonus", "rank")


def diversity_rerank(rows: DataFrame, case: str = "case_id", weight: float = 0.06) -> DataFrame:
    """(case, id, prior, base_rank, bonus, rank): take again and again the best of prior + weight * bonus.

    The bonus has .35 for a new function, .35 for a new rule, .20 for a new
    variant and .10 for a new risk bucket; ties go to the prior, then the base rank.
    """
    kinds = (("function", 0.35), ("rule", 0.35), ("variant", 0.20), ("risk_bucket", 0.10))
    chosen = _greedy(rows.select(case, "id", "prior", "base_rank", *[k for k, _ in kinds]), case, kinds, "prior", "base_rank", weight)
    return chosen.select(case, "id", "prior", "base_rank", "bonus", "rank")


def gain_subset(rows: DataFrame, k: int, case: str = "case_id") -> DataFrame:
    """(case, id, gain, place): k rows, each the one of greatest gain: 100 a new rule, 30 a new type, 10 a new source; ties by id.

    ``rows``: id, rules (array), kind, source.
    """
    schema = f"{case} {dict(rows.dtypes)[case]}, id long, gain long, place int"
    rows = rows.select(case, "id", "kind", "source", F.array_sort(F.array_distinct("rules")).alias("rules"))
    few = _best_of_kind(rows, case, ["rules", "kind", "source"], ["id"], k)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, rules, kinds, sources, out = pdf.sort_values("id").to_dict("records"), set(), set(), set(), []
        while left and len(out) < k:
            gains = [100 * len(set(r["rules"]) - rules) + 30 * (r["kind"] not in kinds) + 10 * (r["source"] not in sources) for r in left]
            at = gains.index(max(gains))
            best = left.pop(at)
            out.append((best[case], best["id"], gains[at], len(out) + 1))
            rules |= set(best["rules"])
            kinds.add(best["kind"])
            sources.add(best["source"])
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return few.groupBy(case).applyInPandas(choose, schema)


def score_diverse_subset(rows: DataFrame, k: int, case: str = "case_id") -> DataFrame:
    """(case, id, score, place): k rows by score, then new group and folder, then the smaller index."""
    schema = f"{case} {dict(rows.dtypes)[case]}, id long, score double, place int"
    few = _best_of_kind(rows.select(case, "id", "score", "grp", "folder"), case, ["grp", "folder"], [F.desc("score"), "id"], k)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, groups, folders, out = pdf.sort_values("id").to_dict("records"), set(), set(), []
        while left and len(out) < k:
            worth = [(r["score"], (r["grp"] not in groups) + (r["folder"] not in folders)) for r in left]
            best = left.pop(worth.index(max(worth)))
            out.append((best[case], best["id"], best["score"], len(out) + 1))
            groups.add(best["grp"])
            folders.add(best["folder"])
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return few.groupBy(case).applyInPandas(choose, schema)


def first_per_key_fill(rows: DataFrame, by: str, key: str, score: str, tie: str, k: int) -> DataFrame:
    """k rows a case: the best of each key first, then the next best. Two windows over the case."""
    best = Window.partitionBy(by, key).orderBy(F.desc(score), tie)
    tier = F.when(F.row_number().over(best) == 1, 0).otherwise(1)
    w = Window.partitionBy(by).orderBy("tier", F.desc(score), tie)
    return rows.withColumn("tier", tier).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


#: Failures that are kept last.
HARD_FAILURES = ("patch_apply_error", "syntax_error", "import_error", "safety_gate_blocked", "timeout")


def tiered_retention(rows: DataFrame, k: int, case: str = "case_id") -> DataFrame:
    """(case, id, tier, place): successes; then unseen (function, rule, failure, bucket) that aren't hard failures; then any unseen; then the rest, to k.

    A key is unseen where no success has it and no better row of the case has
    it. By windows: what comes into a tier doesn't depend on k.
    """
    key = ["function", "rule", "failure_type", "bucket"]
    best = Window.partitionBy(case, *key).orderBy(F.col("success").cast("int").desc(), F.desc("score"), "id")
    fresh = F.row_number().over(best) == 1  # a success of the key would come first
    hard = F.coalesce(F.col("failure_type").isin(*HARD_FAILURES), F.lit(False))
    tier = F.when(F.col("success"), 0).when(fresh & ~hard, 1).when(fresh, 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy(case).orderBy("tier", F.desc("score"), "id"))
    return rows.withColumn("tier", tier).withColumn("place", place).where(F.col("place") <= k).select(case, "id", "tier", "place")


def feature_rerank(rows: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, id, bonus, rank): the first by score; then by score + 3 new rule + 2 new type + 2 new upstream + 1.5 new function + 1 new source, 8 at most."""
    kinds = (("rule", 3.0), ("kind", 2.0), ("upstream", 2.0), ("function", 1.5), ("source", 1.0))
    chosen = _greedy(rows.select(case, "id", "score", *[k for k, _ in kinds]), case, kinds, "score", "id", most=8.0, plain_first=True)
    return chosen.select(case, "id", "bonus", "rank")


def best_match(seeds: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(seed, candidate, score, status): the best candidate of each seed, ties by id; unmatched seeds stay.

    Both have tags as rows: seeds (seed, tag, value), catalogue (candidate,
    tag, value, bonus). A shared failure type gives 4, a focus 3, a pattern 2, a
    rule 1; the candidate's provenance bonus comes on top. Seeds with the same
    tags have the same answer, and of candidates with the same tags and bonus
    it is the first, so kinds of seeds meet kinds of candidates.
    """
    weight = F.when(F.col("tag") == "failure_type", 4.0).when(F.col("tag") == "focus", 3.0).when(F.col("tag") == "pattern", 2.0).otherwise(1.0)
    tags = F.array_sort(F.collect_set(F.struct("tag", "value"))).alias("tags")
    s = stored(seeds.groupBy("seed").agg(tags), "seeds")
    # the bonuses of a candidate belong to its tags
    own = F.array_sort(F.collect_set(F.struct("tag", "value", "bonus"))).alias("own")
    c = stored(catalogue.groupBy("candidate").agg(own).groupBy("own").agg(F.min("candidate").alias("candidate")), "candidates")
    kinds = stored(s.select("tags").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    asked = kinds.select("kind", F.explode("tags").alias("t")).select("kind", "t.*").withColumn("w", weight)
    offered = c.select("candidate", F.explode("own").alias("t")).select("candidate", "t.*")
    met = asked.join(offered.hint("shuffle_merge"), ["tag", "value"]).groupBy("kind", "candidate").agg((F.sum("w") + F.max("bonus")).alias("score"))
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "candidate")
    top = met.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    best = kinds.join(top, "kind", "left").select("tags", "candidate", "score")
    return s.join(best, "tags", "left").select(
        "seed", "candidate", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("candidate").isNull(), "unmatched").otherwise("realized").alias("status"))


# Failure types that a rule or a word of the bug type stands for.
RULE_FAILURES = {
    "stringified_numeric_value": ["type_error", "runtime_error"], "inplace_api_return_value": ["type_error", "attribute_error", "runtime_error"],
    "missing_len_zero_guard": ["runtime_error", "zero_division_error"], "possible_index_overrun": ["runtime_error", "index_error"],
    "dict_missing_key_guard": ["runtime_error", "key_error"], "broad_exception_pass": ["runtime_error", "execution_error"],
    "mutable_default_arg": ["state_leakage"], "always_true_len_check": ["runtime_error", "condition_error"],
    "inverted_empty_guard": ["runtime_error", "condition_error"], "enumerate_start_zero_counter": ["runtime_error", "off_by_one_error"]}
TYPE_FAILURES = {
    "type": ["type_error"], "api": ["type_error", "attribute_error"], "boundary": ["runtime_error", "index_error"],
    "zero division": ["runtime_error", "zero_division_error"], "key": ["runtime_error", "key_error"], "exception": ["runtime_error", "execution_error"]}
ALWAYS = ["patch_apply_error", "syntax_error", "test_failure"]


def infer_failures(rows: DataFrame) -> DataFrame:
    """Rows with ``failures``: sorted tags from rules (array) and bug_type."""
    words = lambda xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    parts = [F.when(F.array_contains("rules", r), words(t)).otherwise(none) for r, t in RULE_FAILURES.items()]
    parts += [F.when(F.lower("bug_type").contains(w), words(t)).otherwise(none) for w, t in TYPE_FAILURES.items()]
    return rows.withColumn("failures", F.array_sort(F.array_distinct(F.concat(words(ALWAYS), *parts))))


def distinct_batches(rows: DataFrame, size: int, wanted: list[int], case: str = "case_id") -> DataFrame:
    """(case, batch, id): walk in order of id over rows of a wanted rule, skip a function that the open batch has, keep full batches only.

    A task goes through its sorted rows and holds the open batch only, however long a case is.
    """
    schema = pa.schema([(case, pa.int64()), ("batch", pa.int32()), ("id", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, n = None, {}, 0
        for batch in batches:
            out = []
            for c, i, f in zip(*(batch.column(x).to_pylist() for x in ("case", "id", "function")), strict=True):
                if c != at:
                    at, open_, n = c, {}, 0
                open_.setdefault(f, i)
                if len(open_) == size:
                    n += 1
                    out += [(c, n, x) for x in open_.values()]
                    open_ = {}
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 3, schema, strict=True)], schema=schema)

    chosen = rows.where(F.col("rule").isin(*wanted)).select(F.col(case).cast("long").alias("case"), "id", "function")
    return chosen.repartition("case").sortWithinPartitions("case", "id").mapInArrow(walk, f"{case} long, batch int, id long")


def selection_audit(rows: DataFrame, chosen: DataFrame, key: str, *by: str) -> DataFrame:
    """Per group: selected and omitted rows and the selected share."""
    c = chosen.select(key).distinct().withColumn("_in", F.lit(True))
    r = rows.join(c, key, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    return r.groupBy(*by).agg(count_if("_in").alias("selected"), count_if(~F.col("_in")).alias("omitted")).withColumn(
        "coverage", share("selected", F.col("selected") + F.col("omitted")))
