from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from lattica.llm import pseudo_likelihood as pl

from .conftest import frame


def words_of(df):
    return pl.vocabulary(pl.word_counts(df))


def plain_score(text, words, net, counts):
    """Token by token, both softmax levels written out."""
    ws = pl.tokens(text.encode())
    hashes = np.array([pl.word_hash(w) for w in ws], dtype=np.int64)
    rank = {h: i for i, h in enumerate(words.hashes.tolist())}
    leaves = [rank.get(h, words.own + h % pl.RARE) for h in hashes.tolist()]
    width = net.inner.shape[2]
    soft = lambda z, i: float(z[i] - z.max() - np.log(np.exp(z - z.max()).sum()))
    total = 0.0
    for i, (w, h, own) in enumerate(zip(ws, hashes.tolist(), leaves, strict=True)):
        at = [leaves[i + d] if 0 <= i + d < len(ws) else words.mark for d in pl.WINDOW]
        hidden = np.tanh(sum(net.embeddings[a] * p for a, p in zip(at, net.places, strict=True)) + net.hidden)
        c, k = divmod(own, width)
        total += soft(hidden @ net.classes + net.class_bias, c) + soft(hidden @ net.inner[c] + net.inner_bias[c], k)
        if h not in rank:
            mass = sum(n + 1 for v, n in counts.items() if pl.word_hash(v) not in rank and pl.word_hash(v) % pl.RARE == h % pl.RARE)
            total += np.log((counts[w] + 1) / mass)
    return len(ws), total


@pytest.mark.parametrize(("own", "known"), [(pl.OWN_SHARE, pl.KNOWN_SHARE), (300, 900), (300, 300), (1, 1)])
def test_scores_against_a_plain_loop(spark, odd, odd_rows, monkeypatch, own, known):
    """All words with leaves; leaves, broadcast counts and joined counts; leaves and joined counts; joined counts only."""
    monkeypatch.setattr(pl, "OWN_SHARE", own)
    monkeypatch.setattr(pl, "KNOWN_SHARE", known)
    counts = Counter(w for _, t, *_ in odd_rows for w in pl.tokens((t or "").encode()))
    words = words_of(odd)
    net = pl.learn(odd, words)
    found = {r["doc_id"]: r for r in pl.score_documents(odd).collect()}
    for i, t, *_ in odd_rows:
        if i is not None and i != 5:
            n, total = plain_score(t or "", words, net, counts)
            assert (found[i]["n_tokens"], found[i]["log_probability"]) == (n, pytest.approx(total, rel=1e-3, abs=1e-2))


def test_word_counts_cover_everything(odd, odd_rows):
    words = words_of(odd)
    total = sum(len(pl.tokens((t or "").encode())) for _, t, *_ in odd_rows)
    assert words.counts.sum() + words.rare_counts.sum() == total


def test_probabilities_of_the_first_weights_are_the_shares():
    counts = np.array([5.0, 4.0, 3.0, 2.0, 1.0, 0.5])
    net = pl.Network.start(counts)
    net.classes[:], net.inner[:] = 0, 0
    leaves = np.arange(6)
    assert np.exp(net.log_probabilities(np.full((6, 4), 6, np.int32), leaves)) == pytest.approx(counts / counts.sum(), rel=1e-4)


def trained(ids, leaves, rounds=1):
    net = pl.Network.start(np.bincount(ids, minlength=leaves) + 0.5)
    for k in range(rounds):
        own = pl.Pass(net, leaves, k)
        own.take(ids.astype(np.int32), np.array([len(ids)]))
        own.end()
        net = own.learner.net
    return net


def test_training_learns_both_sides():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 8, 6000)
    ids[1::2] = (ids[0::2] + np.append(ids[2::2], 0)) % 8  # a token that its two neighbours tell
    net = trained(ids, 8, 2)
    windows = pl.contexts(ids.astype(np.int32), np.array([len(ids)]), 8)
    assert net.log_probabilities(windows[1::2], ids[1::2]).mean() > np.log(1 / 8) + 0.15


def test_each_side_tells_something_of_unseen_text():
    rng = np.random.default_rng(1)

    def text(n):
        ids = rng.integers(0, 4, n)
        ids[1::2] = 4 + 2 * (ids[0::2] % 2) + np.append(ids[2::2], 0) % 2
        return ids

    net, unseen = trained(text(8000), 8), text(2000)
    windows, y = pl.contexts(unseen.astype(np.int32), np.array([len(unseen)]), 8)[1::2], unseen[1::2]
    whole = net.log_probabilities(windows, y).mean()
    for side in (slice(0, 2), slice(2, 4)):
        cut = windows.copy()
        cut[:, side] = 8
        assert net.log_probabilities(cut, y).mean() < whole - 0.3
    assert whole > -0.3


def test_a_step_follows_the_gradient():
    """The first step of Adagrad moves every weight that has a gradient by RATE against its numeric sign."""
    rng = np.random.default_rng(4)
    net = pl.Network.start(np.ones(7))
    windows, leaves = rng.integers(0, 8, (30, 4)).astype(np.int32), rng.integers(0, 7, 30)
    after = pl.Learner(net.copy())
    after.learn(windows, leaves)
    for k in (1, 2, 3, 5):
        p = net.params()[k]
        for at in zip(*(rng.integers(0, n, 6) for n in p.shape), strict=True):
            loss = []
            for d in (-1e-2, 1e-2):
                other = net.copy()
                other.params()[k][at] += d
                loss.append(-other.log_probabilities(windows, leaves).astype(np.float64).sum())
            slope = (loss[1] - loss[0]) / 2e-2
            if abs(slope) > 0.05:
                assert np.sign(after.net.params()[k][at] - p[at]) == -np.sign(slope)


def test_huge_logits():
    z = np.array([[200.0, 0.0], [0.0, 200.0]], dtype=np.float32)
    assert pl._log_share(z, np.array([0, 0])).tolist() == [0.0, -200.0]


def test_contexts_do_not_cross_texts():
    m = 9
    w = pl.contexts(np.array([1, 2, 3, 4], dtype=np.int32), np.array([2, 0, 2]), m)
    assert w.tolist() == [[m, m, 2, m], [m, 1, m, m], [m, m, 4, m], [m, 3, m, m]]
    assert pl.contexts(np.array([1, 2, 3, 4], dtype=np.int32), np.array([2, 0, 2]), m, np.array([1, 2])).tolist() == w[1:3].tolist()


def test_weights_are_averaged_by_tokens_over_many_partitions(spark, words, monkeypatch):
    df = frame(spark, [(i, " ".join(words[i : i + 20]), "en", "a") for i in range(60)]).repartition(40).persist()
    vocabulary = words_of(df)
    monkeypatch.setattr(pl, "LEAST_STEPS", 2)
    shared = spark.sparkContext.broadcast((vocabulary, pl.Network.start(vocabulary.leaf_counts())))
    rows = df.select("text").mapInArrow(pl._passed(shared, 0), "slot long, part long, n long, weights binary").toArrow().to_pylist()
    slots = sorted({r["slot"] for r in rows})
    assert len({r["part"] for r in rows}) > pl.GROUP
    want = np.concatenate([sum(r["n"] * np.frombuffer(r["weights"], "<f4").astype(float) for r in rows if r["slot"] == k) / sum(r["n"] for r in rows if r["slot"] == k) for k in slots])
    found = np.concatenate([p.ravel() for p in pl.learn(df, vocabulary).params()])
    assert found == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_empty_table(none):
    assert pl.score_documents(none).count() == 0


def test_long_texts_are_trained_on(spark):
    """A text over 20,000 characters whose words no other text has teaches the network."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"s{k}" for k in rng.integers(0, 40, 60)), "en", "a") for i in range(30)]
    long = " ".join(["x y"] * 6000)
    df = frame(spark, [*rows, (99, long, "en", "a")]).repartition(2).persist()
    words = words_of(df)
    net = pl.learn(df, words)
    leaves, _, _ = pl.placed(words, pl.prepare([long.encode()], pl._Hashes())[0])
    windows = pl.contexts(leaves, np.array([len(leaves)]), words.mark)
    assert net.log_probabilities(windows, leaves).mean() > np.log(0.5)
