from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from lattica.llm import toxicity

from .conftest import frame

DATA = "/root/testdata/sf0.1"


def test_words_and_grams():
    assert toxicity.words_of("Idiot, IDIOT! thé 3x".encode()) == {b"idiot", "thé".encode(), b"3x"}
    flat, counts = toxicity.grams([b"ab", b"idiot"])
    assert counts.tolist() == [3, 5 + 4 + 3 + 2] and len(set(flat.tolist())) == 17 - 0


def test_a_telling_word_is_learned_and_others_are_left_alone(words):
    clean = [" ".join(words[i : i + 30]).encode() for i in range(0, 300, 3)]
    toxic = [t + b" scum" for t in clean[:40]]
    model = toxicity.fit(clean + toxic, [0] * 100 + [1] * 40)
    margins = model.margins([b"scum", " ".join(words[300:340]).encode(), b""], {})
    assert margins[0] > 0 > margins[1] and margins[2] == model.intercept


def test_small_cache_gives_the_same_scores(words, monkeypatch):
    texts = [" ".join(words[i : i + 50]).encode() for i in range(0, 300, 7)]
    model = toxicity.fit(texts[:20] + [b"vile " + t for t in texts[:20]], [0] * 20 + [1] * 20)
    whole = model.margins(texts, {})
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 30)
    assert [model.margins([t], known)[0] for known in [{}] for t in texts] == pytest.approx(whole)


def test_copies_count_once(words):
    t = " ".join(words[:60]).encode()
    found = toxicity.without_copies(toxicity.samples([t, t, t + b" x", b"another", b""], [1, 1, 1, 0, 0]))
    assert [set(x) for x, _, _ in found] == [toxicity.words_of(t), {b"another"}, set()] and [y for _, _, y in found] == [1, 0, 0]


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = toxicity.scores(spark.read.parquet(f"{DATA}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.97
    assert ((found.predicted == 1) & (found.toxic == 0)).mean() < 0.01


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(10, 1), (11, 0), (22, 0), (23, 0), (22, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.scores(odd, labels)
    assert found.count() == odd.count() and found.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.scores(none, labels).count() == 0
    assert [r[0] for r in toxicity.scores(odd, labels.limit(0)).select("score").distinct().collect()] == [0.5]


def test_small_label_sets(spark, words):
    """Ordinary texts of which no n-gram tells the labels apart: the smoothed share for all."""
    rows = [(i, " ".join(words[5 * i : 5 * i + 30]), "en", "a") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    found = {r["score"] for r in toxicity.scores(frame(spark, rows), labels).collect()}
    assert len(found) == 1 and 0.3 < found.pop() < 0.7


def plain_score(model, text):
    """From the model's weights, n-gram by n-gram."""
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    total = model.intercept
    for w in toxicity.words_of((text or "").encode()):
        marked = b"^" + w + b"$"
        for n in toxicity.SIZES:
            for i in range(len(marked) - n + 1):
                h = n
                for k, byte in enumerate(marked[i : i + n]):
                    h = (h + (byte + 1) * int(toxicity._MULTIPLY[k])) % 2**64
                total += weights.get(int(toxicity.mix(np.array([h], dtype=np.uint64))[0]), 0.0)
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_scores_against_a_plain_scoring_of_all_rows(spark):
    small = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.learn(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = toxicity.scores(docs, labels).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        assert r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_long_texts_are_learned_whole(spark, words):
    """The only toxic word stands at the end of texts of over 20,000 characters."""
    rng = random.Random(9)
    filler = [" ".join(rng.choices(words, k=4500)) for _ in range(60)]
    rows = [(i, filler[i] + (" scum" if i % 2 else ""), "en", "a") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    found = toxicity.scores(frame(spark, [*rows, (100, "scum", "en", "a"), (101, words[0], "en", "a")]), labels)
    assert {r["doc_id"]: r["predicted"] for r in found.where("doc_id >= 100").collect()} == {100: 1, 101: 0}
