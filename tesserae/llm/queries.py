"""The registered queries: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fuzzyhash, k2treap, licences, quality, secrets, simhash, spelling, tokenfiles, toxicity, urlfilters, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.transform("licences", lambda x: F.concat_ws(":", x["word"], x["licence"]))
    return found.select(
        "doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join(listed, ",").alias("licences"),
        F.coalesce(F.round(F.array_max("licences.dice"), 6), F.lit(0.0)).alias("best_dice"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = tokenfiles.write(docs)
    got = tokenfiles.read(tokenfiles.lookup(docs.select("doc_id"), folder), folder)
    return got.select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.tokenize(docs))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_fuzzy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzyhash.edit_study(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return m.select(
        "doc_id", "match.n_words", "match.n_hit", F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("match.n_hit") > 0).alias("contaminated"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["no"] < 3)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    count = lambda rule: F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return member.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


#: The rules of op11, and the words that put a host's addresses on its list.
URL_RULES = [
    urlfilters.Rule("allow", "com", "/"), urlfilters.Rule("block", "example.com", "/en/"),
    urlfilters.Rule("allow", "www.example.com", "/en/"), urlfilters.Rule("block", "net", "/es/"), urlfilters.Rule("block", "net", "/fr/")]
LISTED_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam"]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = urlfilters.addresses_with_words(pages, LISTED_WORDS)
    return urlfilters.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = k2treap.build(table(spark, sf_dir, "documents"))
    return k2treap.search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_licences, op3_token_files, op4_bpe, op5_quality, op6_fuzzy_hash, op7_decontaminate, op8_secrets,
    op9_simhash, op10_toxicity, op11_url_filters, op12_lexical_search, op13_spelling_variants)}

#: Base32 of a SHA-1: five hex digits at a time are four letters.
_BASE32 = """list_reduce(list_transform(range(0, 8), lambda i: list_reduce(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT) >> s) & 31 AS INTEGER), 1)),
  lambda a, b: a || b)), lambda a, b: a || b)"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_N = f"least({decontaminate.WORDS}, len(ws))"

#: Queries that SQL can express; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
    "op2_licences": licences.oracle(),
    "op7_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
ip AS (SELECT item_id, ws, {_N} AS n, unnest(range(1, len(ws) - {_N} + 2)) AS p FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS g FROM ip),
dp AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n),
m AS (SELECT doc_id, item_id, p, n FROM (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g FROM dp) JOIN iw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_url_filters": f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE
    {" ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.host}{r.path}'"
              for r in sorted(URL_RULES, key=lambda r: (-len(r.host) - len(r.path), -len(r.host))))} END AS fits FROM u)
SELECT page_id, host, path, split_part(fits, ' ', 2) AS rule,
  CASE WHEN fits IS NOT NULL THEN split_part(fits, ' ', 1)
    WHEN regexp_matches(host, '(^|[.-])({"|".join(LISTED_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM f""",
    "op12_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY 1, 2),
n AS (SELECT doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
a AS (SELECT count(*) AS all_n, CAST(sum(n) AS BIGINT) AS all_l FROM n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(all_n) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM f, a WHERE term IN (SELECT term FROM q) GROUP BY 1),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_n) // all_l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (doc_id), a GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {k2treap.K}""",
    "op13_spelling_variants": f"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(3988292384 AS UBIGINT) for k in range(0, 8)]),
  lambda c, p: CASE WHEN c & 1 = 1 THEN xor(c >> 1, p) ELSE c >> 1 END)) AS crc),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM o WHERE length(run) >= {spelling.LEAST_CHARS} GROUP BY 1, 2),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
    list_transform(range(0, length(x) // 2), lambda i: CAST(CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) AS UBIGINT))),
  lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, b) AS INTEGER) + 1]))) AS h FROM r, t),
w AS (SELECT CASE WHEN h % {spelling.DELETE_ONE_IN} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY 1 HAVING sum(n) >= {spelling.LEAST_COUNT}),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.rest = v.word UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.rest = v.word),
b AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.TIMES} * v.n THEN near END AS form, CASE WHEN near_n >= {spelling.TIMES} * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN b ON v.word = b.word AND k = 1),
steps AS (SELECT word, form, word AS root, n, n_near, form_n, 0 AS k FROM f UNION ALL
  SELECT s.word, s.form, f.form, s.n, s.n_near, s.form_n, k + 1 FROM steps s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT word, any_value(form) AS form, arg_max(root, k) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n FROM steps GROUP BY word""",
}
