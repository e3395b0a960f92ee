from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lattica.llm import quality

DATA = "/root/testdata/sf0.01"


def test_lasso_drops_noise():
    rng = np.random.default_rng(1)
    z = rng.integers(0, 2, (600, 20)).astype(float)
    y = (z[:, 3] > 0).astype(float)
    w, _ = quality.lasso(z, y, 0.02)
    assert abs(w[3]) > 1 and np.abs(np.delete(w, 3)).max() < 0.1


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.5)).astype(float)
    model = quality.fit_ensemble(x, y, ("a", "b", "c"))
    assert ((model.predict(x, ("a", "b", "c")) >= 0.5) == (y > 0)).mean() > 0.95
    assert any(len(rule) > 1 for rule, _ in model.rules)


def test_compiled_score_equals_the_model(spark):
    x = np.random.default_rng(3).random((300, len(quality.NAMES)))
    model = quality.fit_ensemble(x, (x[:, 2] > 0.4).astype(float))
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in quality.NAMES))
    found = [r[0] for r in df.select(model.score({n: F.col(n) for n in quality.NAMES})).collect()]
    assert found == pytest.approx(model.predict(x).tolist())


def test_one_class_or_no_labels():
    empty = np.zeros((0, len(quality.NAMES)))
    assert quality.fit_ensemble(empty, np.zeros(0)).predict(np.zeros((1, len(quality.NAMES))))[0] == 0.5
    assert quality.fit_ensemble(np.ones((3, len(quality.NAMES))), np.ones(3)).rules == ()


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = quality.scores(spark.read.parquet(f"{DATA}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.95


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(10, 1), (11, 1), (22, 0), (23, 0), (22, None), (None, 1)], "doc_id long, quality int")
    found = quality.scores(odd, labels)
    assert found.count() == odd.count() and found.where("score is null or score < 0 or score > 1").isEmpty()
    assert quality.scores(none, labels).count() == 0
    assert [r[0] for r in quality.scores(odd, labels.limit(0)).select("score").distinct().collect()] == [0.5]
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_truth_values_are_fitted_as_numbers():
    """The rule matrix is held as truth values, a block of rows at a time as numbers, for all 20,000 rows."""
    rng = np.random.default_rng(4)
    z = rng.integers(0, 2, (5000, 12)).astype(bool)
    y = (z[:, 3] & z[:, 5]).astype(float)
    w, b = quality.lasso(z, y, 0.003)
    other, c = quality.lasso(z.astype(float), y, 0.003)
    assert w == pytest.approx(other, abs=1e-3) and b == pytest.approx(c, abs=1e-3)
    assert quality.MAX_LABELLED == 20_000


def plain_statistics(text):
    """The statistics of a text, counted by hand."""
    t = text or ""
    words = re.split(r"[\x20\x09-\x0D]+", t.strip(" \t\n\v\f\r"))
    lines, n = t.split("\n"), len(t)
    kind = lambda c: regex.match(r"\p{Lu}", c) is not None
    per = lambda a, b: a / b if b else 0.0
    return {
        "log_words": math.log1p(len(words)), "word_length": per(n, len(words)), "distinct_words": per(len(set(words)), len(words)),
        "distinct_lines": per(len(set(lines)), len(lines)), "words_per_line": per(len(words), len(lines)), "upper": per(sum(map(kind, t)), n),
        "digits": per(sum(c in "0123456789" for c in t), n), "symbols": per(sum(c in "#$%&*@~^=+<>{}[]\\/_" for c in t), len(words)),
        "bars": per(t.count("|"), len(words)), "bangs": per(sum(c in "!?" for c in t), len(words)), "stops": per(sum(c in ".,;:" for c in t), len(words)),
    }


def test_scores_against_a_plain_scoring_of_all_rows(spark, odd, odd_rows):
    """Statistics by hand and the fitted rules written out, for every row of a table and of the odd documents."""
    small = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    odd_labels = spark.createDataFrame([(10, 1), (11, 1), (22, 0), (23, 0), (30, 1), (31, 0)], "doc_id long, quality int")
    for df, given, rows in ((docs, labels, [(r["doc_id"], r["text"]) for r in docs.collect()]), (odd, odd_labels, [(i, t) for i, t, *_ in odd_rows])):
        model = quality.learn(quality.with_statistics(df), quality.pick(given))
        want = []
        for i, t in rows:
            x = plain_statistics(t)
            margin = model.intercept + sum(w for rule, w in model.rules if all((x[n] > at) if above else (x[n] <= at) for n, above, at in rule))
            want.append((i, 1 / (1 + math.exp(-margin)), zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else False))
        found = quality.scores(df, given).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        for r, (i, score, held) in zip(sorted(((r["doc_id"], r["score"], r["held_out"], r["predicted"]) for r in found), key=key), sorted(want, key=key), strict=True):
            assert (r[0], r[2], r[3]) == (i, held, int(score >= 0.5)) and r[1] == pytest.approx(score)
        assert sorted((r["doc_id"] for r in quality.keep_good(df, given).collect()), key=str) == sorted((i for i, score, _ in want if score >= 0.5), key=str)
