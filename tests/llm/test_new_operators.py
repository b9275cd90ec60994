"""URL filters, ranked search and spelling variants against plain versions, on the given tables and on odd cases."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tesserae.llm import k2treap, queries, spelling, urlfilters  # noqa: E402
from tesserae.llm.urlfilters import Rule  # noqa: E402


def rows(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


# ---- URL filters


def test_urls(spark, small):
    pages = rows(spark, small, "pages", "page_id", "url")
    got = {r.page_id: tuple(r)[1:] for r in queries.op11_url_filters(spark, small).collect()}
    listed = {h + p for h, p in map(brute.host_path, (u for _, u in pages)) if {"ads", "adult", "bets", "casino", "pills", "spam"} & set(h.replace("-", ".").split("."))}
    assert got == {i: brute.op11(u, queries.URL_RULES, listed) for i, u in pages}


ODD_URLS = [
    None, "", "no scheme", "http://", "http://A.Com", "http://a.com/", "http://a.com?x=/", "HTTP://WWW.Example.COM/en/É", "x://b://c.com/d", "http://é.net/es/ü",
    "http://example.com/en/", "http://notexample.com/en/", "http://a.example.com/en/x", "http://www.example.com/en/x", "http://net/es/", "http://a.net/es", "http://a.com\n/x",
    "http://long.org/" + "x" * 100_000, "http://long.org/" + "x" * 100_000, "http://com.:80/", "http://a.net#/es/"]


@pytest.mark.parametrize("held", [8, 0])
def test_urls_odd(spark, monkeypatch, held):
    monkeypatch.setattr(urlfilters, "HELD_PARTS", held or 1)
    monkeypatch.setattr(urlfilters, "KEYS_A_SHARD", 2)
    monkeypatch.setattr(urlfilters, "ROWS_A_TASK", 3)
    if not held:
        monkeypatch.setattr(urlfilters, "PART_BYTES", 1)
    pages = spark.createDataFrame([(i, u, f"h{i}", None) for i, u in enumerate(ODD_URLS)], "page_id long, url string, host string, row string")
    listed = ["long.org/" + "x" * 100_000, "", "elsewhere.org/", None, "elsewhere.org/"]
    found = urlfilters.judge(pages, queries.URL_RULES, spark.createDataFrame([(x,) for x in listed], "key string"))
    assert found.columns == ["page_id", "url", "row", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got == {i: brute.op11(u, queries.URL_RULES, set(listed)) for i, u in enumerate(ODD_URLS)}


def test_urls_empty_tables_and_ties(spark):
    none = spark.createDataFrame([], "key string")
    pages = spark.createDataFrame([(1, "http://b.a.org/x/y")], "page_id long, url string")
    tied = [Rule("block", "a.org", "/x/y"), Rule("allow", "b.a.org", "/x"), Rule("block", "org", "/")]
    assert urlfilters.judge(pages, tied, none).head().rule == "b.a.org/x"
    assert urlfilters.judge(pages, [], none).head().verdict == "allow"
    assert urlfilters.judge(pages.limit(0), tied, none).count() == 0


def test_cascade_is_exact(spark):
    chance = np.random.default_rng(5)
    for n, share in ((1, 1.0), (50, 0.0), (1000, 0.5), (20_000, 0.01), (20_000, 0.99)):
        h = chance.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        listed = chance.random(n) < share
        levels = urlfilters.levels_of(*h, listed)
        assert (urlfilters.told(levels, *h) == listed).all()
        # far below what the addresses themselves take: some bits a listed one
        assert sum(bits for _, bits, _ in levels) <= 8 * max(1, len(levels)) + listed.sum() * 20
    keys = spark.range(30_000).selectExpr("concat('k', id) as key", "id % 7 = 0 as is")
    cascade = urlfilters.build(keys, keys.where("is"))
    assert cascade.shards > 1
    asked = urlfilters.with_listed(keys.unionByName(keys.limit(100)), cascade, keys["key"])
    assert asked.where("listed <> is").count() == 0


# ---- ranked search


def test_search(spark, small):
    docs, items = rows(spark, small, "documents", "doc_id", "text"), rows(spark, small, "benchmark", "item_id", "text")
    got = sorted(tuple(r) for r in queries.op12_lexical_search(spark, small).collect())
    assert got == brute.op12(docs, items, 50)


ODD_TEXTS = [
    (1, None), (2, ""), (3, "?!"), (4, "Alpha beta"), (5, "alpha BETA"), (6, "alpha beta"), (7, "gamma " * 50_000 + "alpha"), (8, "É é 日本 x1"), (9, "é"), (None, "alpha alpha"),
    (None, "alpha alpha"), (10, "delta"), (10, "delta"), (11, " ".join(f"w{i}" for i in range(30_000)))]
ODD_ITEMS = [(1, "alpha alpha beta?"), (2, None), (3, ""), (4, "é É"), (5, "nowhere"), (None, "delta"), (6, "gamma w7 w29999 x1"), (6, "beta")]


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_odd(spark, cells, k):
    docs = spark.createDataFrame([(d, t, f"s{d}", 1) for d, t in ODD_TEXTS], "doc_id long, text string, score string, rank int").coalesce(2)
    items = spark.createDataFrame([(i, t, "x") for i, t in ODD_ITEMS], "item_id long, text string, key string")
    got = [tuple(r) for r in k2treap.search(k2treap.build(docs, cells_a_shard=cells), items, k=k).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(brute.op12(ODD_TEXTS, ODD_ITEMS, k), key=order)


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert k2treap.search(k2treap.build(none), items).count() == 0
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    assert k2treap.search(k2treap.build(docs), items.limit(0)).count() == 0


def test_search_ties_among_copies(spark):
    """A large group of copies ties: the smallest ids stay, and not all of the group is opened."""
    chance = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, "w1 w2 w3" if i % 3 else " ".join(chance.choices(words, k=9))) for i in range(3000)]
    chance.shuffle(docs)
    items = [(1, "w1 w2 w3"), (2, "w4 w5")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in k2treap.search(k2treap.build(frame, cells_a_shard=2000), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute.op12(docs, items, 50)


def test_tree_round_trip():
    """All cells come back with their values, and a node has the largest of its children's."""
    chance = np.random.default_rng(2)
    for n, r, c in ((1, 1, 1), (5, 3, 2), (400, 37, 900), (3000, 500, 64)):
        at = chance.choice(r * c, min(n, r * c), replace=False)
        row, column, value = at // c, at % c, chance.integers(1, 1 << 20, len(at))
        height, bits, lacks = k2treap.tree(row, column, value)
        treap = k2treap.open_tree(height, bits, lacks)
        node = np.zeros(len(at), np.int64)
        for level in range(height):
            down = height - 1 - level
            there, child = treap.children(node, 2 * (row >> down & 1) + (column >> down & 1))
            assert len(there) == len(at) and (treap.largest[child] <= treap.largest[node]).all()
            node = child
        assert (treap.largest[node] == value).all() and treap.largest[0] == value.max()
        gone = np.setdiff1d(np.arange(r * c), at)[:50]
        node = np.zeros(len(gone), np.int64)
        for level in range(height):
            there, node = treap.children(node, 2 * (gone // c >> height - 1 - level & 1)[: len(node)] + (gone % c >> height - 1 - level & 1)[: len(node)])
            gone = gone[there]
        assert not len(gone)


# ---- spelling variants


def test_spelling(spark, small):
    got = sorted(tuple(r) for r in queries.op13_spelling_variants(spark, small).collect())
    assert got == brute.op13(rows(spark, small, "documents", "doc_id", "text"))


def test_spelling_odd(spark):
    texts = [(1, None), (2, ""), (3, "short"), (4, "Señores señores senores " * 5), (5, "colour " * 60 + "color colors colours " * 6), (None, "colour " * 9), (5, "colour " * 60 + "color colors colours " * 6),
             (7, "x" * 50_000 + " " + "x" * 49_999 + " "), (8, "ÀÉ×÷ŸĀbcdefg " * 7), (9, "colourcolour " * 40_000)] + [(20 + i, "x" * 50_000 + " " + "x" * 49_999) for i in range(6)]
    docs = spark.createDataFrame([(d, t, "w", 3) for d, t in texts], "doc_id long, text string, word string, n int")
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs).collect())
    assert got == brute.op13(texts) and len(got) > 5
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 5, 512])
def test_spelling_blocks(spark, block):
    """Files of more words than a block are cut; chains of forms lead to their end; ties go to the smallest word."""
    chance = random.Random(block)
    words = {"".join(chance.choices("ab", k=chance.choice([6, 7, 8]))): chance.choice([5, 30, 200, 1200, 7000]) for _ in range(200)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(tuple(r) for r in spelling.variants(frame, block=block).collect())
    assert got == brute.variants(words)
    assert any(root != form for _, form, root, *_ in got if form)


def test_tile_is_edit_distance_one():
    chance = random.Random(1)
    words = list({"".join(chance.choices("abc", k=chance.choice([6, 7]))).encode() for _ in range(150)})
    near, _ = spelling.tile(words, words, 7)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert near[i, j] == (7 in (len(a), len(b)) and brute.one_edit(a, b))


def test_words_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    docs = spark.createDataFrame([(i, f"aaaaaa bbbbbb{'cd' * (i % 3)} dddddd eeeeee") for i in range(60)], "doc_id long, text string")
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs).collect())
    assert got == brute.op13([tuple(r)[:2] for r in docs.collect()])
