"""Scoring and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import STOP_WORDS, count_if, rounded, tokens
from ..operators import scoring as S
from ..tables import VIEWS, table
from .base import query
from .calibration import SIGNALS_SQL, WEIGHTS, signals

RULES = list(S.RULE_PRIORS)
_RULE_LIST = "[" + ", ".join(f"'{r}'" for r in RULES) + "]"


def rule_name(k):
    return F.get(F.array(*map(F.lit, RULES)), (F.col(k) % 12).cast("int"))


def rule_sql(k: str) -> str:
    return f"{_RULE_LIST}[{k} % 12 + 1]"


def case_sql(expr: str, values: dict[str, float], default: float) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


# ---- line items as findings and candidates

@query("SELECT l_orderkey AS case_id, round(1 - exp(sum(ln(1 - l_discount))) + 1e-9, 6) AS risk FROM lineitem GROUP BY 1")
def noisy_or(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_discount").alias("confidence"))
    return d.groupBy("case_id").agg(rounded(S.noisy_or() + 1e-9).alias("risk"))


@query(""", d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
s AS (SELECT l_partkey AS id, 1 - exp(sum(ln(1 - l_discount))) AS static FROM lineitem GROUP BY 1), m AS (SELECT max(degree) AS most FROM d)
SELECT s.id, round(least(1.0, 0.8 * static + 0.2 * coalesce(degree, 0) / most), 6) AS score FROM s LEFT JOIN d USING (id), m""", "edges")
def static_rank(spark, sf):
    from ..functions import attach
    from ..operators.graph import degree

    d = degree(VIEWS["edges"](spark, sf)).select("id", "degree")
    s = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("confidence")).groupBy("id").agg(S.noisy_or().alias("static"))
    rows = attach(s.join(d, "id", "left"), d.agg(F.max("degree").alias("most")), [])
    return rows.select("id", rounded(S.static_rank(F.col("static"), F.coalesce("degree", F.lit(0)), F.col("most"))).alias("score"))


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens_sql(text: str) -> str:
    names = f"list_transform(regexp_extract_all(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda n: lower(n))"
    return (f"list_filter(list_distinct(list_concat({names}, flatten(list_transform({names}, lambda n: string_split(n, '_'))))), "
            f"lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))")


@query(f"SELECT item_id, array_to_string(list_sort({tokens_sql('text')}), ' ') AS words FROM benchmark", name="tokens")
def tokens_of_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(tokens("text")), " ").alias("words"))


@query(f""", b AS (SELECT 1 AS one) , c AS (SELECT turn % 7 AS k, list_distinct(flatten(list({tokens_sql('text')}))) AS words FROM conversations WHERE text IS NOT NULL GROUP BY 1),
e AS (SELECT doc_id, doc_id % 7 AS k, {tokens_sql('text')} AS words FROM documents)
SELECT e.doc_id, round(coalesce(len(list_intersect(e.words, c.words)) / nullif(sqrt(len(e.words)::DOUBLE * len(c.words)), 0), 0), 6) AS semantic
FROM e LEFT JOIN c ON e.k = c.k""".replace(", b AS (SELECT 1 AS one) ,", "WITH"))
def set_cosine(spark, sf):
    context = table(spark, sf, "conversations").select((F.col("turn") % 7).alias("k"), "text")
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).alias("k"), "text")
    return S.token_overlap(docs, context, "k", "doc_id").select("doc_id", rounded("semantic").alias("semantic"))


_GRAPH = list(S.GRAPH_WEIGHTS)


def _signal(i: int) -> str:
    return f"(item * {1000003 + 2 * i} % {97 + 2 * i}) / {96 + 2 * i}.0"


_BLEND = " + ".join(f"{w} * ({_signal(i)})" for i, (_, w) in enumerate(S.GRAPH_WEIGHTS.items()))


@query(f" SELECT case_id, item, round(greatest(0.0, least(1.0, {_BLEND})), 6) AS graph FROM ranked", "ranked")
def graph_blend(spark, sf):
    r = VIEWS["ranked"](spark, sf)
    r = r.select("case_id", "item", *[F.expr(_signal(i).replace(".0", ".0D")).alias(c) for i, c in enumerate(_GRAPH)])
    return r.select("case_id", "item", rounded(S.fuse(S.GRAPH_WEIGHTS)).alias("graph"))


@query(SIGNALS_SQL + """ SELECT case_id, item, round(greatest(0.0, least(1.0, CASE WHEN case_id % 2 = 0
THEN 0.30 * sbfl + 0.25 * graph + 0.15 * static + 0.10 * semantic + 0.15 * llm - 0.05 * risk
ELSE 0.20 * graph + 0.60 * static + 0.10 * semantic + 0.10 * llm END)), 6) AS score FROM r""", "ranked")
def fused_score(spark, sf):
    return signals(spark, sf).select("case_id", "item", rounded(S.fuse_by_coverage(F.col("case_id") % 2 == 0)).alias("score"))


@query(SIGNALS_SQL + ", t AS (" + " UNION ALL ".join(
    f"SELECT case_id, item, 'without_{off}' AS variant, greatest(0.0, least(1.0, {' + '.join(f'{w} * {c}' for c, w in WEIGHTS.items() if c != off)})) AS s FROM r" for off in WEIGHTS)
    + ") SELECT case_id, variant, round(max(s), 6) AS best, round(avg(s), 6) AS mean FROM t GROUP BY 1, 2", "ranked")
def fused_toggles(spark, sf):
    t = S.toggled(signals(spark, sf).drop("score"), {f"without_{c}": [c] for c in WEIGHTS}, WEIGHTS)
    return t.groupBy("case_id", "variant").agg(rounded(F.max("score")).alias("best"), rounded(F.avg("score")).alias("mean"))


@query("""SELECT c_custkey AS id, round(greatest(0.0, least(1.0, coalesce(max(o_totalprice) / 500000.0 - 0.2, 0))) + 1e-9, 6) AS external
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def external_score(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") / 500000.0 - 0.2).alias("score"))
    return S.with_external(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), s, "id").select("id", rounded(F.col("external") + 1e-9).alias("external"))


@query(SIGNALS_SQL + " SELECT case_id, item, CAST(rank AS INTEGER) AS rank, round(fused, 6) AS score FROM r WHERE rank <= 5", "ranked")
def rank_topk(spark, sf):
    return signals(spark, sf).where("rank <= 5").select("case_id", "item", "rank", rounded("score").alias("score"))


# ---- texts as diffs: a line that begins with a capital is added, others are removed

_DIFF = "list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[A-Z]') THEN '+' || x ELSE '-' || x END)"


def _diff(c="text"):
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(x.rlike("^[A-Z]"), F.concat(F.lit("+"), x)).otherwise(F.concat(F.lit("-"), x))), "\n")


@query(f"""SELECT doc_id, CAST(len(list_filter({_DIFF}, lambda x: (starts_with(x, '+') AND NOT starts_with(x, '+++'))
OR (starts_with(x, '-') AND NOT starts_with(x, '---')))) AS BIGINT) AS size FROM documents""")
def diff_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.diff_size(_diff()).alias("size"))


@query("""SELECT page_id, CAST(1 + CASE WHEN page_id % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS files FROM pages""")
def diff_files(spark, sf):
    new = F.when(F.col("page_id") % 2 == 1, F.concat("url", F.lit(".new"))).otherwise(F.col("url"))
    diff = F.concat(F.lit("--- a/"), "url", F.lit("\n+++ b/"), new, F.lit("\n+added\n-removed"))
    return table(spark, sf, "pages").select("page_id", S.diff_files(diff).alias("files"))


# ---- line items as changes

_CHANGE = """c AS (SELECT l_orderkey AS case_id, l_partkey AS function, l_suppkey AS owner, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS size, l_linenumber AS callers, l_suppkey % 4 AS cross_file,
  l_partkey % 3 AS files, l_suppkey % 5 AS fanout, l_returnflag = 'R' AS control, l_linestatus = 'F' AS signature, l_discount AS risk0, l_tax * 10 AS ratio, l_partkey % 4 AS variant,
  l_extendedprice AS price FROM lineitem),
k AS (SELECT *, least(1.0, 0.40 * least(1.0, size / 20.0) + 0.35 * least(1.0, callers / 5.0) + 0.15 * least(1.0, cross_file / 3.0) + 0.10 * least(1.0, files / 2.0)
  + 0.12 * least(1.0, fanout / 4.0) + CASE WHEN control THEN 0.08 ELSE 0 END + CASE WHEN signature THEN 0.05 ELSE 0 END) AS risk FROM c)"""


def changes(spark, sf):
    c = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("function"), F.col("l_suppkey").alias("owner"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("long").alias("size"), F.col("l_linenumber").alias("callers"), (F.col("l_suppkey") % 4).alias("cross_file"),
        (F.col("l_partkey") % 3).alias("files"), (F.col("l_suppkey") % 5).alias("fanout"), (F.col("l_returnflag") == "R").alias("control"),
        (F.col("l_linestatus") == "F").alias("signature"), F.col("l_discount").alias("risk0"), (F.col("l_tax") * 10).alias("ratio"),
        (F.col("l_partkey") % 4).alias("variant"), F.col("l_extendedprice").alias("price"))
    return c.withColumn("risk", S.change_risk())


_KEY = "case_id, function, owner, line, price"


@query(f"WITH {_CHANGE} SELECT {_KEY}, round(risk, 6) AS risk FROM k")
def change_risk(spark, sf):
    return changes(spark, sf).select(*_KEY.split(", "), rounded("risk").alias("risk"))


@query(f"WITH {_CHANGE} SELECT CASE WHEN risk >= 0.60 THEN 'high' WHEN risk >= 0.30 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n, round(avg(ratio), 6) AS mean_ratio FROM k GROUP BY 1")
def risk_bucket(spark, sf):
    return changes(spark, sf).groupBy(S.risk_bucket().alias("bucket")).agg(F.count("*").alias("n"), rounded(F.avg("ratio")).alias("mean_ratio"))


@query(f"""WITH {_CHANGE} SELECT {_KEY}, round(greatest(0.0, least(1.0, 0.55 * ratio + 0.20 * risk0 + 0.20 / (1 + variant) - 0.03 * risk - 0.02 * least(1.0, size / 50.0))), 4) AS prior FROM k""")
def prior_score(spark, sf):
    return changes(spark, sf).select(*_KEY.split(", "), F.round(S.prior_score("ratio", "risk0", "variant", "risk", "size"), 4).alias("prior"))


def _as_attempt(c):
    return c.select("*", F.col("ratio").alias("pass_ratio"), (F.col("price") / 100000.0).alias("localisation"), F.col("control").cast("double").alias("static_ok"),
                    F.lit(0.0).alias("prior"), (F.col("fanout") / 4.0).alias("feedback"), F.least(F.lit(1.0), F.col("size") / 50.0).alias("diff"),
                    (F.col("variant") == 3).cast("double").alias("warning"), F.col("signature").cast("double").alias("success"), (F.col("fanout") / 4.0).alias("bonus"))


_ATT = "ratio AS pass_ratio, price / 100000.0 AS localisation, CASE WHEN control THEN 1.0 ELSE 0 END AS static_ok, fanout / 4.0 AS feedback, least(1.0, size / 50.0) AS diff, CASE WHEN variant = 3 THEN 1.0 ELSE 0 END AS warning, CASE WHEN signature THEN 1.0 ELSE 0 END AS success"


@query(f"""WITH {_CHANGE}, a AS (SELECT *, {_ATT} FROM k) SELECT {_KEY}, round(greatest(0.0, least(1.0, 0.60 * pass_ratio + 0.20 * localisation + 0.10 * static_ok
+ 0.08 * feedback - 0.06 * diff - 0.03 * risk - 0.01 * warning + 0.12 * success)) + 1e-9, 6) AS score FROM a""")
def attempt_score(spark, sf):
    return _as_attempt(changes(spark, sf)).select(*_KEY.split(", "), rounded(S.fuse(S.ATTEMPT_WEIGHTS) + 1e-9).alias("score"))


@query(f"""WITH {_CHANGE}, a AS (SELECT *, {_ATT} FROM k) SELECT {_KEY}, round(greatest(0.0, least(1.0, 0.62 * pass_ratio + 0.22 * localisation + 0.10 * static_ok
+ 0.10 * feedback - 0.04 * risk - 0.02 * diff + 0.14 * success)) + 1e-9, 6) AS score FROM a""")
def bundle_score(spark, sf):
    return _as_attempt(changes(spark, sf)).select(*_KEY.split(", "), rounded(S.fuse(S.BUNDLE_WEIGHTS) + 1e-9).alias("score"))


@query(f"""WITH {_CHANGE} SELECT {_KEY}, round(greatest(0.0, least(0.99, least(0.99, ratio) + {case_sql(rule_sql('owner'), S.RULE_PRIORS, 0.0)}
+ least(0.08, risk0) - least(0.18, variant * 0.08) - least(0.08, size / 100.0))), 6) AS calibrated FROM k""")
def rule_calibration(spark, sf):
    c = changes(spark, sf)
    x = S.rule_calibration(F.col("ratio"), rule_name("owner"), F.col("risk0"), F.col("variant"), F.col("size"))
    return c.select(*_KEY.split(", "), rounded(x).alias("calibrated"))


_KINDS = ["success", "test_failure", "type_error", "syntax_error", "timeout", "execution_error", "unknown_failure", "import_error", "runtime_error"]
_KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"
_FB = """f AS (SELECT *, {kinds}[rule + variant % 3 + 1] AS kind, k / 99.0 AS ratio, variant % 2 = 0 AS target_hit FROM attempts),
b AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN kind = 'success' THEN 1.0 WHEN kind = 'test_failure' THEN 0.55 + 0.25 * ratio
  WHEN kind IN ('type_error', 'attribute_error', 'runtime_error') THEN 0.35 + 0.15 * ratio
  WHEN kind IN ('patch_apply_error', 'syntax_error', 'import_error', 'safety_gate_blocked') THEN 0.10 WHEN kind = 'timeout' THEN 0.05
  WHEN kind = 'execution_error' THEN 0.12 ELSE 0.20 END + CASE WHEN target_hit THEN 0.05 ELSE 0 END)) AS feedback FROM f)""".replace("{kinds}", _KINDS_SQL)


def feedback(spark, sf):
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("rule") + F.col("variant") % 3).cast("int"))
    a = VIEWS["attempts"](spark, sf).withColumn("kind", kind).withColumn("ratio", F.col("k") / 99.0).withColumn("target_hit", F.col("variant") % 2 == 0)
    return a.withColumn("feedback", S.feedback_score("kind", "ratio", "target_hit"))


@query(f", {_FB} SELECT id, kind, round(feedback, 6) AS feedback FROM b", "attempts")
def feedback_score(spark, sf):
    return feedback(spark, sf).select("id", "kind", rounded("feedback").alias("feedback"))


@query(f""", {_FB} SELECT id, CASE WHEN kind = 'success' THEN 'success' WHEN kind IN ('syntax_error', 'import_error') THEN 'static_validation' WHEN kind = 'timeout' THEN 'performance'
WHEN kind IN ('type_error', 'runtime_error') THEN 'runtime_execution' WHEN kind = 'test_failure' THEN 'test_assertion' WHEN kind = 'execution_error' THEN 'sandbox_execution'
ELSE 'unknown' END AS stage, CASE WHEN kind = 'success' THEN 'complete' WHEN kind = 'test_failure' THEN CASE WHEN ratio > 0 OR target_hit THEN 'high' ELSE 'medium' END
WHEN kind IN ('type_error', 'runtime_error') THEN CASE WHEN ratio > 0 OR target_hit THEN 'medium' ELSE 'low' END WHEN kind = 'unknown_failure' THEN 'unknown' ELSE 'low' END AS recoverability FROM b""", "attempts")
def failure_stage(spark, sf):
    return feedback(spark, sf).select("id", S.failure_stage("kind").alias("stage"), S.recoverability("kind", "ratio", "target_hit").alias("recoverability"))


_EV = f", {_FB}, e AS (SELECT *, 0.50 * ratio + 0.20 * (1 - variant / 5.0) + 0.15 * CASE WHEN success THEN 1 ELSE 0 END + 0.15 * feedback AS evidence FROM b)"


def with_evidence(spark, sf):
    f = feedback(spark, sf).withColumn("risk", F.col("variant") / 5.0)
    return f.withColumn("evidence", S.evidence_score("ratio", "risk", "success", "feedback"))


@query(_EV + " SELECT id, round(evidence, 6) AS evidence FROM e", "attempts")
def evidence_score(spark, sf):
    return with_evidence(spark, sf).select("id", rounded("evidence").alias("evidence"))


@query(_EV + """ SELECT id, round(greatest(CASE WHEN kind = 'success' THEN 0.55 ELSE 0 END, least(CASE WHEN kind = 'success' THEN 1.0 WHEN kind = 'timeout' THEN 0.35
WHEN kind IN ('syntax_error', 'import_error') THEN 0.40 WHEN ratio > 0 THEN 0.75 ELSE 0.65 END, 0.65 * score + 0.35 * evidence)), 6) AS calibrated FROM e""", "attempts")
def judge_calibrated(spark, sf):
    x = S.capped_judgment(F.col("score"), F.col("evidence"), "kind", "ratio")
    return with_evidence(spark, sf).select("id", rounded(x).alias("calibrated"))


@query(_EV + """ SELECT CASE WHEN abs(score - evidence) <= 0.20 THEN 'aligned' WHEN score > evidence THEN 'judge_more_optimistic' ELSE 'judge_more_conservative' END AS agreement,
count(*) AS n FROM e GROUP BY 1""", "attempts")
def judge_agreement(spark, sf):
    return with_evidence(spark, sf).groupBy(S.judge_agreement(F.col("score"), F.col("evidence")).alias("agreement")).agg(F.count("*").alias("n"))


@query(_EV + " SELECT id, round(CASE WHEN rule = 6 THEN feedback ELSE 0.75 * feedback + 0.25 * CASE WHEN rule % 2 = 0 THEN evidence ELSE score END END, 6) AS blended FROM e", "attempts")
def judge_blend(spark, sf):
    calibrated = F.when((F.col("rule") % 2 == 0) & (F.col("rule") != 6), F.col("evidence"))
    raw = F.when(F.col("rule") != 6, F.col("score"))
    return with_evidence(spark, sf).select("id", rounded(S.judge_blend(F.col("feedback"), calibrated, raw)).alias("blended"))


_HYP = SIGNALS_SQL + """, y AS (SELECT r.*, CASE WHEN relevant THEN static END AS confidence, CASE WHEN item % 3 = 0 THEN 1 + item % 4 END AS n, risk AS least_risk FROM r),
z AS (SELECT case_id, item, CASE WHEN confidence IS NOT NULL THEN 'finding' ELSE 'localisation' END AS origin, 1 - (1 - greatest(0.0, least(1.0, coalesce(0.55 * fused + 0.30 * confidence + 0.10 * static + 0.05 * semantic,
  0.70 * fused + 0.15 * graph + 0.15 * semantic)))) * (1 - 0.35 * graph * CASE WHEN item % 5 > 0 THEN 1.0 ELSE 0.75 END)
  * (1 - CASE WHEN n IS NULL THEN 0.0 ELSE 0.18 + 0.04 * least(n, 3) + 0.08 * (1 - least_risk) END) AS score FROM y)"""


@query(_HYP + """ SELECT case_id, item AS function, origin, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, item) AS INTEGER) AS rank FROM z
QUALIFY rank <= 4""", "ranked")
def hypotheses(spark, sf):
    s = signals(spark, sf).withColumnRenamed("item", "function")
    functions = s.select("case_id", "function", F.col("score").alias("localisation"), "static", "semantic", "graph", (F.col("function") % 5).alias("chain"))
    findings = s.where("relevant").select("case_id", "function", F.col("static").alias("confidence"))
    found = s.where("function % 3 = 0").select("case_id", "function", "risk", F.explode(F.sequence(F.lit(1), (F.col("function") % 4 + 1).cast("int"))).alias("nth"))
    return S.hypotheses(functions, findings, found).withColumn("score", rounded("score"))


@query(SIGNALS_SQL + """, m0 AS (SELECT case_id, item AS function, fused AS localisation, (item + v) % 12 AS rule, risk + 0.05 * (v % 2) AS risk, (item * 7 + v * 11) % 30 AS size, v AS variant
  FROM r, (SELECT unnest(range(0, 3)) AS v) WHERE rank <= 10),
m1 AS (SELECT *, row_number() OVER (PARTITION BY case_id, function ORDER BY localisation + 0.10 * (1 - least(1.0, risk)) - 0.03 * variant - 0.02 * least(1.0, size / 20.0) DESC, variant) AS n FROM m0),
m AS MATERIALIZED (SELECT case_id, function, variant, localisation, rule, risk, size FROM m1 WHERE n <= 2),
g AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y, count(*) FILTER (kind = 'calls') > 0 AS c, count(*) FILTER (kind = 'data_flow') > 0 AS d, count(*) FILTER (kind = 'control_flow') > 0 AS t FROM edges GROUP BY 1, 2),
h AS (SELECT DISTINCT a.function AS a, b.function AS b, least(a.function % 2000 + 1, b.function % 2000 + 1) AS x, greatest(a.function % 2000 + 1, b.function % 2000 + 1) AS y FROM m a JOIN m b ON a.case_id = b.case_id AND a.function < b.function),
l AS MATERIALIZED (SELECT a, b, c, d, t FROM h JOIN g USING (x, y)),
p AS (SELECT a.case_id, [{'function': a.function, 'variant': a.variant}, {'function': b.function, 'variant': b.variant}] AS members, len(list_distinct([a.rule, b.rule])) AS rules, (a.risk + b.risk) / 2 AS risk,
  (a.localisation + b.localisation) / 2 AS loc, a.size + b.size AS size, coalesce(l.c, false) AS c, coalesce(l.d, false) AS d, coalesce(l.t, false) AS t, CASE WHEN l.c THEN 1.0 ELSE 0.0 END AS share
  FROM m a JOIN m b ON a.case_id = b.case_id AND a.function < b.function LEFT JOIN l ON l.a = a.function AND l.b = b.function
UNION ALL SELECT a.case_id, [{'function': a.function, 'variant': a.variant}, {'function': b.function, 'variant': b.variant}, {'function': e.function, 'variant': e.variant}],
  len(list_distinct([a.rule, b.rule, e.rule])), (a.risk + b.risk + e.risk) / 3, (a.localisation + b.localisation + e.localisation) / 3, a.size + b.size + e.size,
  coalesce(l.c, false) OR coalesce(n.c, false) OR coalesce(o.c, false), coalesce(l.d, false) OR coalesce(n.d, false) OR coalesce(o.d, false), coalesce(l.t, false) OR coalesce(n.t, false) OR coalesce(o.t, false),
  (CASE WHEN l.c THEN 1 ELSE 0 END + CASE WHEN n.c THEN 1 ELSE 0 END + CASE WHEN o.c THEN 1 ELSE 0 END) / 3.0
  FROM m a JOIN m b ON a.case_id = b.case_id AND a.function < b.function JOIN m e ON a.case_id = e.case_id AND b.function < e.function LEFT JOIN l ON l.a = a.function AND l.b = b.function
  LEFT JOIN l n ON n.a = a.function AND n.b = e.function LEFT JOIN l o ON o.a = b.function AND o.b = e.function),
q AS (SELECT *, least(0.20, 0.08 * CASE WHEN c THEN 1 ELSE 0 END + 0.06 * CASE WHEN d THEN 1 ELSE 0 END + 0.04 * CASE WHEN t THEN 1 ELSE 0 END + 0.04 * share) AS bonus FROM p),
z AS (SELECT *, CAST(loc + 0.08 * rules + bonus - 0.08 * risk - 0.02 * least(1.0, size / 40.0) AS DOUBLE) AS priority FROM q)
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(priority, 9) DESC, members) AS INTEGER) AS rank, array_to_string(list_transform(members, lambda x: x.function || ':' || x.variant), ',') AS members,
  CAST(rules AS INTEGER) AS rules, CAST(round(risk, 6) AS DOUBLE) AS risk, CAST(round(bonus, 6) AS DOUBLE) AS bonus, round(priority, 6) AS priority FROM z QUALIFY rank <= 8""", "ranked", "edges")
def bundles(spark, sf):
    """Pairs and triples of a case's ten best items, with the edges between parts of the same number as links; a direct call connects."""
    m = signals(spark, sf).where("rank <= 10").withColumn("variant", F.explode(F.array(*map(F.lit, range(3))))).selectExpr(
        "case_id", "item as function", "variant", "score as localisation", "(item + variant) % 12 as rule", "risk + 0.05D * (variant % 2) as risk", "(item * 7 + variant * 11) % 30 as size")
    e = VIEWS["edges"](spark, sf).groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(
        *[count_if(F.col("kind") == k).alias(k) for k in ("calls", "data_flow", "control_flow")]).withColumn("connected", F.col("calls") > 0)
    f = m.select("case_id", "function").distinct()
    pairs = f.withColumnRenamed("function", "a").join(f.withColumnRenamed("function", "b"), "case_id").where("a < b").selectExpr(
        "a", "b", "least(a % 2000, b % 2000) + 1 as x", "greatest(a % 2000, b % 2000) + 1 as y").distinct()
    links = pairs.join(e, ["x", "y"]).drop("x", "y")
    found = S.bundles(m, links).withColumn("members", F.array_join(F.transform("members", lambda x: F.concat_ws(":", x["function"], x["variant"])), ","))
    return found.select("case_id", "rank", "members", "rules", *[rounded(c).alias(c) for c in ("risk", "bonus", "priority")])


@query(f"""WITH {_CHANGE} SELECT {_KEY}, round(least(1.0, 0.55 * ratio + 0.25 * {case_sql(rule_sql('function'), S.TRIGGER_PRIORS, 0.5)}
+ 0.10 * CASE variant WHEN 0 THEN 1.0 WHEN 1 THEN 0.90 ELSE 0.92 END + 0.10 * CASE WHEN control THEN 1.0 ELSE 0.70 END + CASE WHEN signature THEN 0.02 ELSE 0 END), 6) AS score FROM k""")
def trigger_score(spark, sf):
    kind = F.when(F.col("variant") == 0, "function").when(F.col("variant") == 1, "returned_nested_function").otherwise("method")
    x = S.trigger_score(F.col("ratio"), rule_name("function"), kind, F.col("control"), F.col("signature"))
    return changes(spark, sf).select(*_KEY.split(", "), rounded(x).alias("score"))


_PATHS = ["src/app/core.py", "tests/test_app.py", "conftest.py", "setup.py", "tools/run.py", "lib/parser.py", "pkg/cache/index.py", "pkg/__init__.py", "docs/conf.py", "x_test.py",
          "lib/sort_search.py", "stats/mean_mode.py", "fmt/format_score.py", "stats/median_average.py", "src/encrypt_validator.py", "src/counter_iterator.py"]
_PATHS_SQL = "[" + ", ".join(f"'{p}'" for p in _PATHS) + "]"
_ROLE = """CASE WHEN regexp_matches(path, '(^|/)test_[^/]*$|_test[.]py$|(^|/)tests?/') THEN 'test' WHEN path = 'conftest.py' THEN 'test_automation'
WHEN path = 'setup.py' THEN 'project_automation' WHEN regexp_matches(path, '(^|/)(scripts|tools|examples|docs|doc)/') THEN 'support' ELSE 'application' END"""


def part_paths(spark, sf):
    return table(spark, sf, "part").withColumn("path", F.get(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % len(_PATHS)).cast("int")))


_RANKED = f"""WITH p AS (SELECT *, {_PATHS_SQL}[p_partkey % {len(_PATHS)} + 1] AS path FROM part), r AS (SELECT p_brand AS brand, p_partkey AS id, p_name AS name, path, {_ROLE} AS role,
  p_size % 7 + 0.5 * (p_size % 4) + 0.25 * (p_size % 3) AS raw, p_retailprice AS graph FROM p),
m AS (SELECT *, coalesce(raw / nullif(max(raw) OVER (PARTITION BY brand), 0), 0) AS s, graph / max(graph) OVER (PARTITION BY brand) AS g, {case_sql('role', S.ROLE_WEIGHTS, 0.8)} AS w FROM r),
f AS (SELECT *, 0.55 * s + 0.30 * g + 0.15 * w AS final FROM m),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY brand ORDER BY round(final, 9) DESC, round(s, 9) DESC, round(g, 9) DESC, round(w, 9) DESC, path, name) AS INTEGER) AS rank FROM f)"""


def _role_ranked(spark, sf):
    p = part_paths(spark, sf).select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "path", (F.col("p_size") % 7).alias("findings"), (F.col("p_size") % 4).alias("rules"),
        (F.col("p_size") % 3).alias("types"), F.col("p_retailprice").alias("graph"))
    return S.role_ranking(p, "brand", "path", "name")


@query(_RANKED + " SELECT brand, id, role, round(s, 6) AS static_rule, round(g, 6) AS graph, round(final, 6) AS final, rank FROM k")
def source_role(spark, sf):
    return _role_ranked(spark, sf).select("brand", "id", "role", rounded("static_rule").alias("static_rule"), rounded("graph_share").alias("graph"), rounded("final").alias("final"), "rank")


@query(_RANKED + f""" SELECT brand, count(*) AS n, {", ".join(f"count(*) FILTER (role = '{r}') AS {r}" for r in S.ROLE_WEIGHTS)}, arg_min(role, rank) AS top_role,
  bool_or(role = 'application') AS any_application, arg_min(role, rank) = 'application' AS top_application FROM k GROUP BY 1""")
def source_role_audit(spark, sf):
    """How the roles of a brand's ranked parts spread, and which one leads."""
    return S.role_audit(_role_ranked(spark, sf), "brand")


_HINT = " + ".join(f"CASE WHEN contains(path, '{w}') THEN {n} ELSE 0 END" for w, n in S.PATH_HINTS.items())


@query(f"""WITH p AS (SELECT p_partkey AS id, {_PATHS_SQL}[p_partkey % {len(_PATHS)} + 1] AS path FROM part)
SELECT id, CAST(CASE WHEN regexp_matches(path, '(^|/)test_[^/]*$|_test[.]py$|(^|/)tests?/') THEN 0 ELSE 20 END + {_HINT} - CASE WHEN regexp_matches(path, '(^|/)__init__[.]py$') THEN 10 ELSE 0 END AS INTEGER) AS priority FROM p""")
def path_priority(spark, sf):
    return part_paths(spark, sf).select(F.col("p_partkey").alias("id"), S.path_priority("path").cast("int").alias("priority"))


_WANT = [("deep", [0, 3, 5], ["A"], 0), ("wide", [1, 4], ["N", "R"], None), ("hard", [2, 6, 5], ["R"], 2)]


@query("WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {r}, {k}, {'NULL' if g is None else g})" for n, r, k, g in _WANT) + """) v(signal, rules, kinds, grp)),
c AS (SELECT o_orderkey AS id, [o_custkey % 7, o_orderkey % 5] AS rules, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS kind, o_custkey % 9 AS nf,
  CASE WHEN o_orderkey % 3 = 0 THEN 'case deep' ELSE 'case hard' END AS name, o_custkey % 4 AS grp FROM orders),
j AS (SELECT c.id, s.signal, len(list_intersect(list_distinct(c.rules), s.rules)) AS shared, kind, kinds, nf, name, c.grp, s.grp AS want FROM c, s)
SELECT id, signal, CAST(CASE WHEN shared > 0 THEN 10 + shared ELSE -5 END + CASE WHEN list_contains(kinds, kind) THEN 3 ELSE 0 END + least(3.0, 0.5 * nf) + CASE WHEN contains(name, signal) THEN 2 ELSE 0 END
+ CASE WHEN want IS NULL THEN 0 WHEN want = grp THEN 50 ELSE -5 END AS DOUBLE) AS priority FROM j""")
def target_priority(spark, sf):
    wanted = spark.createDataFrame(_WANT, "signal string, rules array<bigint>, kinds array<string>, grp bigint")
    kind = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    none = F.col("o_custkey") % 9 == 0
    failures = F.when(none, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("o_custkey") % 9)))
    c = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey") % 7, F.col("o_orderkey") % 5).alias("rules"), kind.alias("kind"), failures.alias("failures"),
        F.when(F.col("o_orderkey") % 3 == 0, "case deep").otherwise("case hard").alias("name"), (F.col("o_custkey") % 4).alias("grp"))
    return S.target_priority(c, wanted, "id", every=True)


@query(f"""WITH {_CHANGE} SELECT {_KEY}, round(CASE WHEN control THEN 4 ELSE 0 END + least(3.0, size / 2.0) + least(2.0, callers / 2.0) + least(2.0, fanout)
+ CASE WHEN signature THEN 1 ELSE 0 END + CASE WHEN variant = 1 THEN 1 ELSE 0 END + CASE WHEN variant = 2 THEN 1 ELSE 0 END + CASE WHEN cross_file > 0 THEN 1 ELSE 0 END, 6) AS interest FROM k""")
def interest_score(spark, sf):
    c = changes(spark, sf).select(*_KEY.split(", "), F.col("control").alias("inversion"), F.col("size").alias("nodes"), F.col("callers").alias("candidates"), F.col("fanout").alias("chain"),
                                  F.col("signature").alias("reflection"), (F.col("variant") == 1).alias("multi"), (F.col("variant") == 2).alias("diverse"), (F.col("cross_file") > 0).alias("cross_file"))
    return c.select(*_KEY.split(", "), rounded(S.interest_score()).alias("interest"))
