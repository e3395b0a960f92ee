from __future__ import annotations

import zlib

import numpy as np
import pytest

from lattica.llm import language

from .conftest import frame

DATA = "/root/testdata/sf0.01"


def test_counts_against_a_plain_count():
    text = "Ab é"
    marked = b" " + text.encode().translate(language.TABLE) + b" "
    grams = [marked[i : i + n] for n in language.SIZES for i in range(len(marked) - n + 1)]
    assert language.counts([text.encode(), b""]).sum(axis=1).tolist() == [sum(g.strip() != b"" for g in grams), 0]
    both = language.counts([b"one two", text.encode()])
    assert (both[1] == language.counts([text.encode()])[0]).all()


def test_clusters_are_unit_vectors():
    x = np.abs(np.random.default_rng(0).normal(size=(50, 8))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = language.cluster(x, 4)
    assert c.shape == (4, 8) and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
    assert len(language.cluster(x[:2], 4)) == 2


def test_rejection():
    model = language.fit([b"the cat and the dog"] * 5 + ["der hund und die katze".encode()] * 5, ["en"] * 5 + ["de"] * 5)
    names, score, far = model.predict([b"the dog and the cat", "Привет мир".encode(), b"123 !", b""])
    assert names[0] == "en" and not far[0] and far[1] and names[2:] == ["und", "und"] and score[2] == 0.0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language.identify(docs, reject=False).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97


def test_odd_documents(spark, odd, none):
    found = {(r["doc_id"], r["lang_pred"]) for r in language.identify(odd, reject=False).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= found
    assert {x for _, x in found} <= {"und", "en", "de", "fr"}
    assert language.identify(odd).count() == odd.count()
    assert language.identify(none).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", odd["lang"].substr(1, 0)).where("lang is null")).collect()} == {"und"}


def test_predictions_against_a_plain_scoring_of_all_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = language.identify(docs, reject=False).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        text = texts[r["doc_id"]] or ""
        x = np.sqrt(language.counts([text.encode()])[0]) * model.idf.astype(float)
        cosine = model.centroids.astype(float) @ (x / max(np.linalg.norm(x), 1e-12))
        letter = any(c.isalpha() for c in text)
        assert r["score"] == pytest.approx(cosine.max() if letter else 0, abs=1e-4)
        assert r["lang_pred"] == (model.languages[int(cosine.argmax())] if letter else "und")
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_parts_of_a_long_text(monkeypatch, words):
    texts = [" ".join(words[:300]).encode(), b"", b"short one", " ".join(words[300:]).encode()]
    whole = language.counts(texts)
    for most in (1, 7, 64, 500):
        monkeypatch.setattr(language, "AT_ONCE", most)
        assert (language.counts(texts) == whole).all()


def test_picked_ids_are_the_first_by_hash(spark):
    """Many rows of one id, few of a language, and many ids: the first by hash of each, as a plain ranking finds them."""
    rows = [(i, "text", "en", "a") for i in range(3000)] + [(7, "text", "de", "a")] * 2000 + [(i, "text", "de", "a") for i in range(5000, 5040)] + [(9, "t", "fr", "a"), (11, None, "it", "a")]
    df = frame(spark, rows)
    found = {r[0] for r in language.pick(df, 25).collect()}
    hashed = df.where("text is not null").selectExpr("doc_id", "lang", "xxhash64(doc_id) as h").distinct().collect()
    want = set()
    for lang in ("en", "de", "fr"):
        want |= {i for _, i in sorted((r["h"], r["doc_id"]) for r in hashed if r["lang"] == lang and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1)[:25]}
    assert found == want
