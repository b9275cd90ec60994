"""Hot ids, held batches and very long texts at the bounds where they are cut."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tesserae.llm import decontaminate, fuzzyhash, nearcopies, simhash, tokenfiles, toxicity  # noqa: E402


def test_edit_study_repeated_id_in_many_ranges(spark):
    """An id with two thirds of all rows is many tasks, and still a run of its own in the order of ids."""
    docs = spark.range(900).selectExpr("if(id % 3 = 0, id, 450) as doc_id", "concat('text ', id % 600, repeat(' x', 50)) as text")
    pairs = fuzzyhash.with_next(docs, each=2000)
    placed = pairs.select("doc_id", "text", "next_text", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("n")).orderBy("p", "n").collect()
    assert len(placed) == 900 and len({r.p for r in placed if r.doc_id == 450}) > 4
    order = [r.doc_id for r in placed]
    assert order == sorted(order, reverse=True)
    assert [r.next_text for r in placed] == [r.text for r in placed[1:] + placed[:1]]


@pytest.mark.parametrize("held", [1, 60, 1 << 26])
def test_blocks_over_held_batches(spark, monkeypatch, held):
    monkeypatch.setattr(decontaminate, "HELD_CHARS", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(6)]
        docs = [(d, f"a {items[d % 6][1]} b" if d % 4 else None if d % 8 else "nothing here") for d in range(40)]
        frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
        got = decontaminate.matches(frame, spark.createDataFrame(items, "item_id long, text string"), block_chars=70)
        seen = {r.doc_id: (r.match["n_words"], r.match["n_hit"], len(r.match["items"])) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen == {k: v[:3] for k, v in brute.op7(docs, items).items()}


@pytest.mark.parametrize("shard", [3, 50])
def test_decontaminate_shards(monkeypatch, shard):
    """Texts longer than a shard, and shards of several texts, give what one shard gives."""
    import pandas as pd

    items = decontaminate.Items([("1", "a b c d e f g h i j k"), ("2", "short one")], 10)
    texts = pd.Series(["x " * 90 + "a b c d e f g h i j k", None, "", "short one", "a b c d e f g h i j", "y " * 200 + "short one " * 30])
    whole = decontaminate.match_shard(list(texts), items)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    parts = list(decontaminate._shards(texts))
    assert len(parts) > 2 and [r for p in parts for r in decontaminate.match_shard(p, items)] == whole


def test_near_copies_between_groups_in_blocks(spark, monkeypatch):
    """Members that don't link to the first of a list link to others; blocks of a few rows lose none of them."""
    import random

    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", 3)
    chance = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        words = list(base)
        for at in chance.sample(range(120), chance.choice([1, 2, 3])):
            words[at] = f"n{chance.randrange(40)}"
        docs.append((i, " ".join(words)))
    shingle = lambda t: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    sets = {i: shingle(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r.doc_id for r in nearcopies.one_of_each(frame).collect())
    assert kept == sorted({find(i) for i in sets}) and 1 < len(kept) < 60


def test_slices_change_nothing(monkeypatch):
    """Texts of many slices and chunks have the features and fingerprints of one slice."""
    import random

    chance = random.Random(2)
    texts = ["", "a", " ".join("".join(chance.choices("abcdeé", k=chance.randrange(1, 8))) for _ in range(700)), "xyz" * 500]
    features, prints = [toxicity.features(t).tolist() for t in texts], [simhash.fingerprint_of(t) for t in texts]
    for size in (7, 64, 1000):
        monkeypatch.setattr(toxicity, "SLICE", size)
        monkeypatch.setattr(simhash, "CHUNK", size)
        assert [toxicity.features(t).tolist() for t in texts] == features and [simhash.fingerprint_of(t) for t in texts] == prints


def test_token_pieces_are_asked_once():
    """The model is asked once for each of 450,000 pieces that come twice; odd and plain pieces get the library's ids."""
    import public_tokenizers

    coder = tokenfiles.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a  b\n\tc \x7f d", " été ß 12 34", "x" * 300, "\x00 \x01", "tail "):
        assert coder.encode(text) == np.array(coder.whole.encode(text, add_special_tokens=False).ids, coder.kind).tobytes()

    class Counting:
        asked = 0

        def tokenize(self, letters):
            self.asked += 1
            return []

    coder.model, coder.memory = Counting(), {}
    for _ in range(2):
        for i in range(450):
            coder.encode(" ".join(str(1000 * i + j + 10**6) for j in range(1000)))
    assert coder.model.asked == 450_000
