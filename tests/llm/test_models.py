"""Classifiers by held-out accuracy, licences by SQL, the pipeline by its stages."""

import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).parents[2]), str(Path(__file__).parent)]
import brute  # noqa: E402

from tesserae.llm import licences, quality, queries, toxicity  # noqa: E402

LARGER = "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("query", "label", "least"), [("op10_toxicity", "toxic", 0.95), ("op5_quality", "quality", 0.97)])
def test_held_out(spark, query, label, least):
    scored = queries.QUERIES[query](spark, LARGER).toPandas()
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.3).astype(int) == scored.predicted).all()
    held = scored[scored.held_out].merge(spark.read.parquet(f"{LARGER}/labels.parquet").toPandas(), on="doc_id")
    assert auc(held[label].to_numpy(), held.score.to_numpy()) > least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_odd(spark, module):
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", 0, "y"), (3, "a " * 60000, 120000, "z"), (None, "b", 1, None), (3, "a " * 60000, 120000, "z")], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (3, 1, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        model = module.train(docs, known)
        got = module.score(docs, model).select("doc_id", "score", module.held_out().alias("held_out")).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and all(r.held_out is not None for r in got)
        same = [r.score for r in got if r.doc_id == 3]
        assert same[0] == same[1]
    assert module.score(docs.limit(0), model).count() == 0


def some_texts(spark, sf, n):
    return [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n).collect()]


def test_quality_features_plain(spark, small):
    russian = "Мы видим большой город. Он стоит у реки! Где он?"
    for text in [*some_texts(spark, small, 60), "", russian, "word " * 5000, "a|b\na|b\n!!??"]:
        for n in (None, 17.0):
            at, x = quality.features(text, n)
            words, rest = brute.quality_features(text, n)
            assert {int(i): v for i, v in zip(at, x) if i < quality.BUCKETS} == pytest.approx(words)
            assert list(x[at >= quality.BUCKETS]) == pytest.approx(rest) and len(rest) == len(quality.STATS) + quality.METADATA
    got = dict(zip(quality.STATS, quality.features(russian)[1][-len(quality.STATS) - quality.METADATA :], strict=False))
    assert got["other"] > 0.7 and got["marks"] < 0.1 and got["sentence_ends"] < 1


def test_machine_sums_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, quality.FACTORS)))
    rows = [(at, rng.normal(size=len(at))) for at in (np.array([3, 7, 20, 41]), np.array([7]), np.array([49, 0, 3]))]
    slow = [brute.machine_raw(m, list(zip(*r, strict=True))) for r in rows]
    assert np.allclose(m.raw(rows), slow)
    quality_slice, quality.SLICE = quality.SLICE, 2
    try:
        assert np.allclose(m.raw(rows), slow)
    finally:
        quality.SLICE = quality_slice


def test_machine_gradient_is_the_slope():
    """Each part of the gradient against the loss a little to either side."""
    rng = np.random.default_rng(4)
    m = quality.Machine(0.1, rng.normal(size=12), rng.normal(size=(12, quality.FACTORS)))
    rows, y = [(np.array([1, 4, 9]), rng.normal(size=3)), (np.array([4, 5]), rng.normal(size=2))], np.array([1.0, 0.0])

    def loss():
        p = [1 / (1 + np.exp(-brute.machine_raw(m, list(zip(*r, strict=True))))) for r in rows]
        return -sum(b * np.log(a) + (1 - b) * np.log(1 - a) for a, b in zip(p, y, strict=True)) / len(y)

    def slope(array, i):
        kept, h = array[i], 1e-5
        array[i] = kept + h
        up = loss()
        array[i] = kept - h
        down = loss()
        array[i] = kept
        return (up - down) / (2 * h)

    at, linear, factors, _ = m.gradient(rows, y)
    assert at.tolist() == [1, 4, 5, 9]
    assert np.allclose(linear, [slope(m.linear, i) for i in at], atol=1e-6)
    assert np.allclose(factors, [[slope(m.factors, (i, f)) for f in range(quality.FACTORS)] for i in at], atol=1e-6)


def bucket_of(gram):
    """The bucket of one n-gram by itself."""
    h, mix, full = ord(gram[0]), 0x9E3779B97F4A7C15, (1 << 64) - 1
    for c in gram[1:]:
        h = (h * mix & full) ^ (h >> 29) ^ ord(c)
    return (h * mix & full) >> (64 - toxicity.BITS)


def test_toxic_ngrams_plain(spark, small):
    for text in [*some_texts(spark, small, 40), "", "Größe ßß", "x"]:
        assert set(toxicity.features(text).tolist()) == {bucket_of(g) for g in brute.toxic_ngrams(text)}
    long = "ab c" * (toxicity.SLICE // 2)
    assert len(toxicity.features(long)) == len(brute.toxic_ngrams("ab c" * 20))


def test_toxic_ratios_plain(spark):
    """Counts, ratios and the choice of n-grams against plain ones, on texts of few letters."""
    texts = [("bad bad word", 1), ("a bad day", 1), ("so bad", 1), ("good day", 0), ("a good word", 0), ("good", 0)] * 4
    known = [(t, y) for i, (t, y) in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2]
    pos, neg = {}, {}
    for t, y in known:
        for g in brute.toxic_ngrams(t):
            (pos if y else neg)[g] = (pos if y else neg).get(g, 0) + 1
    n_pos = sum(y for _, y in known)
    n_neg = len(known) - n_pos
    want = set()
    for g in pos.keys() | neg.keys():
        p, q = pos.get(g, 0), neg.get(g, 0)
        ratio = np.log((p + 1) / (n_pos + 2)) - np.log((q + 1) / (n_neg + 2))
        if p + q >= toxicity.MIN_DOCS and abs(ratio) >= toxicity.MIN_RATIO:
            want.add(bucket_of(g))
            assert toxicity.chosen_buckets(np.array([p]), np.array([q]), n_pos, n_neg)[1][0] == pytest.approx(ratio)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert set(np.flatnonzero(model.weights).tolist()) == want
    # a score is the sum of the weights of the n-grams that a text has
    for t in ("very bad", "very good", "bad good"):
        z = model.bias + sum(float(model.weights[b]) for b in {bucket_of(g) for g in brute.toxic_ngrams(t)})
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-z)))
    assert model.score("very bad") > 0.5 > model.score("very good")


def test_models_are_reproducible(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    for module in (toxicity, quality):
        a = module.train(docs, labels)
        b = module.train(docs.repartition(7), labels.repartition(3))
        assert all(np.array_equal(x, y) for x, y in zip(vars(a).values(), vars(b).values(), strict=True))


def test_licences_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.execute(queries.ORACLES["op2_licences"]).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in queries.op2_licences(spark, small).collect()}
    assert got == want


def test_licences_odd(spark):
    filler = "some words that stand around it " * 30
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 400)
    text = ["Licensed under the Apache License, Version 2.0.", "  LICENSED under the (apache) License -- version 2.0", "This work is licensed under the GNU Public License, version 3.",
            "nothing", None, "", "x y z\nReleased under the MIT License.\nmore", "Released under\nthe MIT License.", "word " * 40000,
            f"{filler}\nThis work is licensed under the GNU General\n * Public License, version 3.\n{filler}",
            f"Released under the MIT License. {filler}", "Copyright 2020 X\n\n" + " ".join(mit.split()[:70]), f"{filler} {mit.upper()} {filler}",
            "licence", f"{filler} This work is licensed under the GNU Lesser General Public License, version 3. {filler} Licensed under CC BY-NC 4.0."]
    docs = spark.createDataFrame([(i, t, "k", "l") for i, t in enumerate(text)], "doc_id long, text string, licences string, _lines string")
    found = licences.scan(docs)
    assert found.columns == ["doc_id", "text", "licences", "_lines"] and found.where("_lines = 'l'").count() == len(text)
    got = {r.doc_id: [(x["word"], x["licence"]) for x in r.licences] for r in found.collect()}
    assert got[0] == got[1] == [(1, "Apache-2.0")] and got[2][0][1] == "GPL-3.0" and got[6] == [(4, "MIT")] and got[7] == [(1, "MIT")]
    n = len(filler.split())
    assert got[9] == [(n + 1, "GPL-3.0")] and got[10] == [(1, "MIT")] and got[11][0][1] == "MIT" and [x[1] for x in got[12]] == ["MIT"]
    assert [x[1] for x in got[14]] == ["LGPL-3.0", "CC-BY-NC-4.0"]
    assert all(got[i] == [] for i in (3, 4, 5, 8, 13))
    assert licences.scan(docs.limit(0)).count() == 0 and licences.scan(docs, {}).head().licences == []
    with pytest.raises(ValueError):
        licences.scan(docs, {"bad": "a"})


def dice_windows(text, templates, threshold):
    """Sorted (word, words, licence, dice): every start of every template, without any pruning."""
    def grams(t):
        w = licences.normalised(t or "").split()
        return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    def meet(a, b):
        return a[0] <= b[1] and b[0] <= a[1]

    g, kept = grams(text), []
    for nr, (_, body) in enumerate(templates):
        own = grams(body)
        n = min(len(own), len(g))
        found = []
        for s in range(len(g) - n + 1):
            unit = {*g[s : s + n]}
            dice = 2 * len(unit & {*own}) / max(1, len(unit) + len({*own}))
            if dice >= threshold - 1e-12:
                found.append((s, s + n, dice, nr))
        kept += [a for a in found if not any(meet(a, b) and (b[2], -b[0]) > (a[2], -a[0]) for b in found)]
    kept = [a for a in kept if not any(a[3] != b[3] and meet(a, b) and (b[2], -b[3]) > (a[2], -a[3]) for b in kept)]
    return sorted((a + 1, z - a + 1, templates[nr][0], round(dice, 9)) for a, z, dice, nr in kept)


def seen_licences(row):
    return sorted((x["word"], x["words"], x["licence"], round(x["dice"], 9)) for x in row.licences)


def test_licences_plain(spark, small):
    """Nothing is lost by pruning: texts cut, mixed, shortened and repeated, against every window of every template."""
    import random

    rng, bodies = random.Random(3), [" ".join(t.split()) for _, t in licences.TEMPLATES]
    texts = some_texts(spark, small, 30)
    for b in bodies:
        w = b.split()
        texts += [b, " ".join(x for x in w if rng.random() > 0.1), f"before it {b} after it", " ".join(w[: len(w) * 3 // 4]), " ".join([*w[::-1], *w]), f"{b} {b} and {b}"]
    for threshold in (0.8, 0.5):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for r in licences.scan(docs, threshold=threshold).collect():
            assert seen_licences(r) == dice_windows(r.text, licences.TEMPLATES, threshold)


def test_damaged_notices_are_all_found(spark):
    """Notices with 2 to 10 % of their words replaced, between filler: each whose own place reaches the threshold is found."""
    import random

    rng, texts = random.Random(11), []
    for licence, body in licences.TEMPLATES:
        w = body.split()
        for _ in range(12 if len(w) > 16 else 0):
            some = [f"z{rng.randrange(999)}" if rng.random() < rng.choice([0.02, 0.05, 0.1]) else x for x in w]
            filler = lambda n: [f"f{rng.randrange(999)}" for _ in range(rng.randrange(n))]
            texts.append((licence, " ".join([*filler(40), *some, *filler(40)])))
    rows = licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        want = dice_windows(r.text, licences.TEMPLATES, 0.8)
        assert seen_licences(r) == want
        assert not want or r.licences
    mit = " ".join(dict(licences.TEMPLATES)["ISC"].split())
    twice = licences.scan(spark.createDataFrame([(1, f"{mit} and then {mit}")], "doc_id long, text string")).head().licences
    assert [(x["licence"], x["dice"]) for x in twice] == [("ISC", 1.0)] * 2


def test_no_python_in_licence_plan(spark, small):
    plan = queries.op2_licences(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_pipeline(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen, columns = [docs], docs.columns
    for _, stage in pipeline.STAGES:
        seen.append(stage(spark, seen[-1], small).cache())
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == columns for d in seen[:-1])
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    texts = [[(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for d in seen[:-1]]
    assert ids[2] == {*brute.near_copies(texts[1]).values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert ids[3] == {d for d, v in brute.op7(texts[2], items).items() if not v[4]}
    assert ids[4] == ids[3] and all(v[:3] == (0, 0, 0) for v in brute.op8(texts[4]).values())
    clean = {d for d, v in brute.op8(texts[3]).items() if v[:3] == (0, 0, 0)}
    assert {d: t for d, t in texts[4] if d in clean} == {d: t for d, t in texts[3] if d in clean}
    e = brute.tiktoken_encoding()
    assert {r.doc_id: r.ids for r in seen[-1].collect()} == {d: e.encode_ordinary(t or "") for d, t in texts[4]}
    from tesserae.llm import common

    begun = common.made()
    assert {r.doc_id for r in pipeline.run(spark, small).select("doc_id").collect()} == ids[5]
    assert len(common.made()) == len(begun) + 1  # only the last stage's rows are left
