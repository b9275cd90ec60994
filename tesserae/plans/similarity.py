"""Duplicate and novelty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import similarity as U
from ..tables import VIEWS, table
from .base import query

_WS = r"[ \t\r\n\f\x0b]+"
_NORMAL = rf"array_to_string(list_transform(string_split(regexp_replace(text, '^{_WS}|{_WS}$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '[ \t\r\f\x0b]+$', '')), chr(10))"
_FP = f"substr(sha256({_NORMAL}), 1, 16)"


@query(f"SELECT doc_id, {_FP} AS fingerprint FROM documents WHERE text IS NOT NULL")
def fingerprint(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", U.fingerprint("text").alias("fingerprint"))


@query(f"SELECT lang, {_FP} AS fp, min(doc_id) AS canonical, count(*) - 1 AS duplicates FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def dup_groups(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "lang", U.fingerprint("text").alias("fp"))
    return U.duplicate_groups(d, ["lang", "fp"], "doc_id")


@query("""SELECT count(*) AS signatures, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey % 50, l_suppkey % 20, l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) HAVING count(*) > 1)""")
def signature_dups(spark, sf):
    s = table(spark, sf, "lineitem").select(U.signature([
        (F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 20).alias("b"), "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q")]).alias("s"))
    return U.repeated(s, "s").agg(F.count("*").alias("signatures"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"))


@query("""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations)
SELECT conv_id, turn, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '' AND NOT list_contains(string_split(coalesce(old, ''), chr(10)), x))) AS BIGINT) AS n FROM c""")
def changed_lines(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").withColumn("old", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.size(U.changed_lines("old", "text")).cast("long").alias("n"))


def _code_sql(text: str) -> str:
    return f"list_distinct(regexp_extract_all({text}, '{U.CODE_TOKEN}'))"


_EDIT = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT list_contains(string_split(old, chr(10)), x)), chr(10))"


def _novelty_sql(t: str) -> str:
    return f"""(SELECT a.conv_id, a.turn, CASE WHEN count(b.turn) = 0 THEN 1.0 WHEN len(any_value(a.{t})) = 0 THEN 0.0
  ELSE 1 - max(coalesce(len(list_intersect(a.{t}, b.{t})) / nullif(len(a.{t}) + len(b.{t}) - len(list_intersect(a.{t}, b.{t})), 0), 0)) END AS v
  FROM r a LEFT JOIN r b ON a.conv_id = b.conv_id AND b.ok AND b.turn < a.turn GROUP BY 1, 2)"""


@query(f"""WITH o AS (SELECT conv_id, arg_min(text, turn) AS old FROM conversations WHERE text IS NOT NULL GROUP BY 1),
r AS (SELECT conv_id, turn, role <> 'user' AS ok, {_code_sql('text')} AS s, {_code_sql(_EDIT)} AS e FROM conversations JOIN o USING (conv_id) WHERE text IS NOT NULL),
f AS (SELECT conv_id, min(turn) AS first FROM r WHERE ok GROUP BY 1),
n AS (SELECT x.conv_id, x.turn, x.v AS sv, y.v AS ev, round(0.45 * x.v + 0.55 * y.v, 4) AS v, coalesce(first >= x.turn, true) AS alone
  FROM {_novelty_sql('s')} x JOIN {_novelty_sql('e')} y ON x.conv_id = y.conv_id AND x.turn = y.turn LEFT JOIN f ON x.conv_id = f.conv_id)
SELECT conv_id, turn, round(sv, 4) AS source_novelty, round(ev, 4) AS edit_novelty, v AS novelty, alone OR v >= 0.08 AS accepted,
CASE WHEN alone OR v >= 0.08 THEN 'accepted' ELSE 'low_novelty_against_batch' END AS reason FROM n""")
def jaccard_novelty(spark, sf):
    """Turns as candidates against the first turn's text as the old source; the assistant's turns count as accepted."""
    c = table(spark, sf, "conversations").where("text is not null")
    old = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("old"))
    r = c.join(old, "conv_id").select(
        "conv_id", "turn", U.code_tokens("text").alias("s"), U.code_tokens(F.array_join(U.changed_lines("old", "text"), "\n")).alias("e"), (F.col("role") != "user").alias("ok"))
    return U.candidate_novelty(r, "conv_id", "turn", "s", "e", "ok")


@query(f"""WITH d AS (SELECT doc_id, source, {_FP} AS fp FROM documents WHERE text IS NOT NULL), f AS (SELECT DISTINCT fp FROM d WHERE source = 'src1')
SELECT source, count(*) FILTER (fp NOT IN (SELECT fp FROM f)) AS accepted, count(*) FILTER (fp IN (SELECT fp FROM f)) AS rejected FROM d GROUP BY 1""")
def reject_failed(spark, sf):
    from ..functions import count_if

    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "source", U.fingerprint("text").alias("fp"))
    r = U.reject_known(d, d.where("source = 'src1'"), "fp")
    return r.groupBy("source").agg(count_if("accepted").alias("accepted"), count_if(F.col("reason") != "").alias("rejected"))


@query(""", o AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY case_id, rule, variant, failure_type ORDER BY rank) = 1)
SELECT case_id, id FROM o QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY rank) <= 10""", "attempts")
def dedupe_limit(spark, sf):
    return U.keep_first(VIEWS["attempts"](spark, sf), ["rule", "variant", "failure_type"], ["rank"], ["case_id"], 10).select("case_id", "id")


@query(""", n AS (SELECT case_id, count(*) AS a, count(DISTINCT ROW(rule, failure_type)) AS u FROM attempts GROUP BY 1)
SELECT case_id, a - u AS duplicates, u AS evaluated, round(coalesce((a - u) / nullif(a, 0), 0), 6) AS pressure FROM n""", "attempts")
def dup_pressure(spark, sf):
    n = VIEWS["attempts"](spark, sf).groupBy("case_id").agg(F.count("*").alias("a"), F.countDistinct("rule", "failure_type").alias("evaluated"))
    n = n.withColumn("duplicates", F.col("a") - F.col("evaluated"))
    return n.select("case_id", "duplicates", "evaluated", rounded(U.duplicate_pressure(F.col("duplicates"), F.col("evaluated"))).alias("pressure"))
