"""Duplicates and novelty of texts and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import share
from ..sources.storage import made, release_since, stored


def normal_text(text: str | Column) -> Column:
    """Stripped, each line without trailing white space."""
    x = F.col(text) if isinstance(text, str) else text
    strip = F.regexp_replace(x, r"^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$", "")
    return F.array_join(F.transform(F.split(strip, "\n"), lambda s: F.regexp_replace(s, r"[ \t\r\f\x0b]+$", "")), "\n")


def fingerprint(text: str | Column) -> Column:
    """First 16 hex digits of the SHA-256 of the normal text."""
    return F.substring(F.sha2(normal_text(text), 256), 1, 16)


def duplicate_groups(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """(keys, canonical, duplicates): groups of equal keys with the smallest id and how many others there are."""
    return rows.groupBy(*keys).agg(F.min(id_).alias("canonical"), (F.count("*") - 1).alias("duplicates"))


def signature(fields: list[Column]) -> Column:
    """Hash of the canonical JSON of the fields (arrays should be sorted)."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys with more than one row."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def changed_lines(old: str, new: str) -> Column:
    """Non-blank lines of the new text that the old one hasn't; repeats stay."""
    before = F.split(F.coalesce(old, F.lit("")), "\n")
    return F.filter(F.split(F.coalesce(new, F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~F.array_contains(before, x))


# Fixed value: what counts as a token of code that is compared with other code.
CODE_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|==|!=|<=|>="

NOVELTY_WEIGHTS = {"source": 0.45, "edit": 0.55}
LEAST_NOVELTY = 0.08


def code_tokens(x: str | Column) -> Column:
    """Distinct names, numbers and comparison signs of a text, as they are written."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), F.lit(CODE_TOKEN), F.lit(0)))


def jaccard_novelty(rows: DataFrame, by: str, id_: str, tokens: str, accepted: str, levels: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(by, id, novelty): 1 less the highest Jaccard likeness to the case's accepted rows before it.

    1 without any accepted row before, 0 for a row without tokens.

    A pair as like as a level shares one of the rarest tokens of either row, as
    many as could be missing from the other, and neither is much longer than
    the other. So rows with a likeness of the first level or more are settled
    by few pairs, from rare tokens, with exact likenesses; those that are left
    go to the next level, and in the end to all tokens they share. Tokens are
    ordered by how many rows of the case have them.
    """
    begun = made()
    r = stored(rows.select(by, id_, F.array_distinct(tokens).alias("_t"), F.coalesce(F.col(accepted), F.lit(False)).alias("_ok")), "novelty").withColumn("_n", F.size("_t"))
    each = r.select(by, id_, "_n", "_ok", F.explode("_t").alias("_token"))
    common = each.groupBy(by, "_token").agg(F.count("*").alias("_df"))
    nth = F.row_number().over(Window.partitionBy(by, id_).orderBy("_df", "_token"))
    each = stored(each.join(common, [by, "_token"]).withColumn("_nth", nth), "tokens")
    held = made()
    left = r.where("_n > 0").select(by, id_)
    found: DataFrame | None = None
    for level in (*levels, 0.0):
        kept = F.col("_nth") <= (F.col("_n") - F.ceil(F.col("_n") * level - 1e-9) + (1 if level else 0))
        mine = each.where(kept).join(left, [by, id_], "left_semi").select(by, id_, "_n", "_token")
        theirs = each.where(kept & F.col("_ok")).select(by, F.col(id_).alias("_other"), F.col("_n").alias("_m"), "_token")
        near = (F.col("_other") < F.col(id_)) & (F.col("_m") >= level * F.col("_n") - 1e-9) & (F.col("_n") >= level * F.col("_m") - 1e-9)
        met = mine.join(theirs, [by, "_token"]).where(near)
        if level:
            pairs = met.select(by, id_, "_other", "_n", "_m").distinct()
            pairs = pairs.join(r.select(by, id_, "_t"), [by, id_]).join(r.select(by, F.col(id_).alias("_other"), F.col("_t").alias("_o")), [by, "_other"])
            pairs = pairs.withColumn("_both", F.size(F.array_intersect("_t", "_o")))
        else:
            pairs = met.groupBy(by, id_, "_other").agg(F.first("_n").alias("_n"), F.first("_m").alias("_m"), F.count("*").alias("_both"))
        best = pairs.groupBy(by, id_).agg(F.max(F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both"))).alias("_j")).where(F.col("_j") >= level - 1e-9)
        best = stored(best if found is None else best.unionByName(found), "best")
        if level:
            left = stored(left.join(best, [by, id_], "left_anti"), "left")
            release_since(begun, *held, *made()[-2:])
        found = best
    first = r.where("_ok").groupBy(by).agg(F.min(id_).alias("_first"))
    out = r.join(found, [by, id_], "left").join(first, by, "left")
    alone = F.col("_first").isNull() | (F.col("_first") >= F.col(id_))
    out = out.select(by, id_, F.when(alone, 1.0).when(F.col("_n") == 0, 0.0).otherwise(1 - F.coalesce("_j", F.lit(0.0))).alias("novelty"))
    out = stored(out, "novelties")
    release_since(begun, made()[-1])
    return out


def candidate_novelty(rows: DataFrame, by: str, id_: str, source: str, edit: str, accepted: str, least: float = LEAST_NOVELTY) -> DataFrame:
    """(by, id, source_novelty, edit_novelty, novelty, accepted, reason) of candidates.

    ``source`` and ``edit``: tokens of a candidate's text and of its changed
    lines. A candidate is accepted if it is novel enough against the accepted
    rows before it, or if there are none.
    """
    both = jaccard_novelty(rows, by, id_, source, accepted).withColumnRenamed("novelty", "source_novelty").join(
        jaccard_novelty(rows, by, id_, edit, accepted).withColumnRenamed("novelty", "edit_novelty"), [by, id_])
    first = rows.where(F.col(accepted)).groupBy(by).agg(F.min(id_).alias("_first"))
    total = F.round(NOVELTY_WEIGHTS["source"] * F.col("source_novelty") + NOVELTY_WEIGHTS["edit"] * F.col("edit_novelty"), 4)
    ok = F.col("_first").isNull() | (F.col("_first") >= F.col(id_)) | (total >= least)
    return both.join(first, by, "left").select(
        by, id_, F.round("source_novelty", 4).alias("source_novelty"), F.round("edit_novelty", 4).alias("edit_novelty"), total.alias("novelty"), ok.alias("accepted"),
        F.when(ok, "accepted").otherwise("low_novelty_against_batch").alias("reason"))


def reject_known(rows: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Rows with ``accepted`` and the reason where the key is among the failed ones."""
    f = failed.select(key).distinct().withColumn("_f", F.lit(True))
    return rows.join(f, key, "left").withColumn("accepted", F.col("_f").isNull()).withColumn(
        "reason", F.when(F.col("_f"), "matches_failed_source_fingerprint").otherwise("")).drop("_f")


def keep_first(rows: DataFrame, keys: list[str], order: list[str], by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The first row of each key in order; of those the first ``limit`` of each case ``by``."""
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*(by or []), *keys).orderBy(*order))).where("_n = 1").drop("_n")
    if limit is None:
        return one
    return one.withColumn("_n", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def duplicate_pressure(duplicates: Column, evaluated: Column) -> Column:
    return share(duplicates, duplicates + evaluated)
