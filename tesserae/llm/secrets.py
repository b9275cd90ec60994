"""Secret scans with an incremental blob ledger.

Every version of a text is content-addressed (SHA-256 of its UTF-8). The
ledger, two Parquet tables in one folder, remembers which (blob, rule, rule
version) have been scanned and what was found. A run looks up all blobs of its
input by their digests alone, takes the texts of those only that the ledger
hasn't seen under some rule, scans each of them once under these rules, appends
to the ledger, and joins the findings back to all paths. A run that meets
nothing new moves no text.

A run writes its findings before its marks in the ledger, so a run that dies
between leaves findings only, which the next run writes again and readers drop
as repeats.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import made, new_folder, release_since, stored

SCANNED = "blob string, rule string, version int"
BROADCAST_BLOBS = 100_000
FOUND = "blob string, rule string, version int, start long, end long"


def _starts(data: bytes, needle: bytes) -> Iterator[int]:
    at = data.find(needle)
    while at >= 0:
        yield at
        at = data.find(needle, at + 1)


_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")


def _assign(data: bytes) -> Iterator[tuple[int, int]]:
    lower, end = data.lower(), 0
    for at in sorted(p for name in _NAMES for p in _starts(lower, name)):
        if at >= end and (m := _ASSIGN.match(data, at)):
            end = m.end()
            if len(m[2]) >= 8:
                yield m.span()


_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


def _access(data: bytes) -> Iterator[tuple[int, int]]:
    end = 0
    for at in _starts(data, b"AKIA"):
        if at >= end and (m := _ACCESS.match(data, at)):
            end = m.end()
            if end - at >= 16:
                yield at, end


_HEX = re.compile(rb"[0-9a-f]+")
_IS_HEX = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))


def _hex(data: bytes) -> Iterator[tuple[int, int]]:
    marks, run, at = data.translate(_IS_HEX), b"\x01" * 32, 0
    while (at := marks.find(run, at)) >= 0:
        span = _HEX.match(data, at).span()
        yield span
        at = span[1]


_PEM = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_PEM_END = re.compile(rb"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
# What may stand between the lines of a key: blanks, quote marks, comment signs, line ends written out.
_GAP = rb"""(?:[\s>"'`,;|#*]|\\[nrt])"""
_PEM_BODY = re.compile(
    rb"(?:" + _GAP + rb"*+[A-Za-z][A-Za-z0-9-]*+:\x20[^\n\\]*+)*+"  # Proc-Type, DEK-Info
    rb"(?:" + _GAP + rb"*+[A-Za-z0-9+/]{16,}+={0,2}+)++"
    # the last, shorter line is padded or stands alone on the next line
    rb"""(?:[\x20\t\r"'>|#*]*+(?:\\r)?(?:\n|\\n)[\x20\t"'>|#*]*+[A-Za-z0-9+/]++(?:=+|(?![^\r\n"'`,;\\])))?""")


def _pem(data: bytes) -> Iterator[tuple[int, int]]:
    """Whole keys: to the END line, or where none comes before the next BEGIN, over the base64 lines that follow."""
    starts = [*_starts(data, b"-----BEGIN "), len(data)]
    for at, limit in zip(starts, starts[1:], strict=False):
        if m := _PEM.match(data, at):
            last = _PEM_END.search(data, m.end(), limit) or _PEM_BODY.match(data, m.end(), limit) or m
            yield at, last.end()


@dataclass(frozen=True)
class Rule:
    """A rule; raise ``version`` whenever ``spans`` changes what it finds.

    ``may`` is a condition on a text column that each text with a finding
    meets; without one every text may have findings.
    """

    name: str
    version: int
    spans: Callable[[bytes], Iterator[tuple[int, int]]]
    may: Callable[[Column], Column] | None = None


def _has(*words: str) -> Callable[[Column], Column]:
    return lambda text: reduce(or_, [F.lower(text).contains(w) for w in words])


RULES = (
    Rule("assign", 1, _assign, _has(*[n.decode() for n in _NAMES])), Rule("access", 1, _access, lambda text: text.contains("AKIA")),
    Rule("hex", 1, _hex, lambda text: text.rlike("[0-9a-f]{32}")), Rule("pem", 2, _pem, lambda text: text.contains("-----BEGIN ")))


def find(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(rule, start, end) in code points, end exclusive.

    The text becomes one byte a code point; all rules look for ASCII only, and
    other characters become bytes that no rule takes.
    """
    data = (text or "").encode("latin-1", "replace")
    return [(r.name, a, b) for r in rules for a, b in r.spans(data)]


def _read(spark, path: str, schema: str) -> DataFrame:
    """A ledger table; empty where no run has written it yet."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(there) else spark.createDataFrame([], schema)


def scan(versions: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every row of ``versions``: path, blob, spans.

    ``spans`` is an array of (start, no, end, rule), sorted, with ``no`` the
    place of the rule in ``rules``; empty where nothing is found. A null text
    is an empty blob. Repeated rows and null paths each keep their row; texts of
    any length are scanned whole, so no span is cut; other
    columns are not looked at; an empty table has no findings. Without a
    ``ledger`` folder the run has one of its own.

    Up to BROADCAST_BLOBS unseen blobs (about 15 MB of digests) go to the
    texts, so that only unseen texts are shuffled. Beyond, the texts' first
    copies go to the digests.
    """
    spark = versions.sparkSession
    ledger = ledger or new_folder(spark, "ledger")
    content = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blob = F.sha2(F.col("text"), 256).alias("blob")
    begun = made()
    paths = stored(content.select("path", blob), "paths")
    paths_at = made()[-1]

    asked = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    done = (
        _read(spark, f"{ledger}/scanned", SCANNED)
        .groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))  # at most as many as rule versions
    )
    pending = stored(
        paths.select("blob").distinct().join(done, "blob", "left")
        .withColumn("todo", F.array_except(asked, F.coalesce("done", F.array().cast("array<struct<rule:string,version:int>>"))))
        .where(F.size("todo") > 0).select("blob", "todo"), "pending")
    unseen = pending.count()
    texts, first = content.select(blob, "text"), F.first("text").alias("text")
    if unseen <= BROADCAST_BLOBS:
        fresh = texts.join(F.broadcast(pending), "blob").groupBy("blob").agg(first, F.first("todo").alias("todo"))
    else:
        fresh = texts.groupBy("blob").agg(first).join(pending, "blob")

    def scan_blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {(r.name, r.version): r for r in rules}
        for pdf in batches:
            out = []
            for b, t, todo in zip(pdf["blob"], pdf["text"], pdf["todo"], strict=True):
                todo = [(x["rule"], x["version"]) for x in todo]
                versions_of = dict(todo)
                out.append((b, [n for n, _ in todo], [v for _, v in todo],
                            [(n, versions_of[n], a, z) for n, a, z in find(t, tuple(known[k] for k in todo))]))
            yield pd.DataFrame(out, columns=["blob", "rules", "versions", "found"])

    if unseen:
        scanned = stored(
            fresh.select("blob", "text", "todo").mapInPandas(
                scan_blobs,
                "blob string, rules array<string>, versions array<int>, "
                "found array<struct<rule: string, version: int, start: long, end: long>>"), "scanned")
        scanned.select("blob", F.explode("found").alias("f")).select("blob", "f.*").write.mode("append").parquet(f"{ledger}/found")
        scanned.select("blob", F.explode(F.arrays_zip("rules", "versions")).alias("r")).select(
            "blob", F.col("r.rules").alias("rule"), F.col("r.versions").alias("version")
        ).write.mode("append").parquet(f"{ledger}/scanned")

    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    current = F.exists(asked, lambda a: (a["rule"] == F.col("rule")) & (a["version"] == F.col("version")))
    found = stored(
        _read(spark, f"{ledger}/found", FOUND).where(current)
        .groupBy("blob").agg(F.array_sort(F.collect_set(
            F.struct("start", number[F.col("rule")].alias("no"), "end", "rule"))).alias("spans")), "found")
    release_since(begun, paths_at, made()[-1])
    empty = F.array().cast("array<struct<start:bigint,no:int,end:bigint,rule:string>>")
    return paths.join(found, "blob", "left").select(
        F.col("path").alias(path), "blob", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, mask: str = "[REDACTED]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each stretch of secrets in ``text`` replaced by ``mask``.

    Overlapping findings are masked as one. ``n_chars``, where there is such a
    column, follows the new text; texts without findings, null ones too, stay
    as they are. All rows and columns stay, in no set order; rows are told by
    their text only, so ids may be null, repeated or missing. Only rows whose
    text may have a finding by some rule meet the findings in a join; the
    others don't leave their task. Texts of any length are masked whole. An empty
    table stays one.
    """
    own = docs.columns
    found = scan(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), rules=rules).where(F.size("spans") > 0)
    spans = stored(found.groupBy("blob").agg(F.first("spans").alias("spans")), "spans")
    row = docs.select(F.struct(*own).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    may = reduce(or_, [r.may(F.col("text")) if r.may else F.lit(True) for r in rules])

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, found):
            if found is None:
                return text
            out, at, end = [], 0, 0
            for s in sorted((int(x["start"]), int(x["end"])) for x in found):
                if s[0] >= end:
                    out += [text[end:s[0]], mask]
                end = max(end, s[1])
            return "".join(out) + text[end:]

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    hit = row.where(may).withColumn("blob", F.sha2("text", 256)).join(spans, "blob", "left").withColumn("masked", masked("text", "spans"))
    changed = {"text": F.col("masked")}
    if "n_chars" in own:
        changed["n_chars"] = F.char_length("masked").cast(docs.schema["n_chars"].dataType)
    new = [F.when(F.col("spans").isNotNull(), changed[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in own]
    return row.where(~may).select("row.*").unionByName(hit.select(*new))
