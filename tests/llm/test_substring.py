from __future__ import annotations

import random

import numpy as np

from lattica.llm import substring as sub

from .conftest import frame


def plain_boundaries(text):
    out = []
    for i in range(len(text)):
        h = 0
        for k in range(16):
            if i - k >= 0:
                h = (h + (int(sub.GEAR[text[i - k]]) << k)) & 0xFFFF
        if h >> 11 == 0:
            out.append(i + 1)
    return out if out and out[-1] == len(text) else [*out, len(text)] if text else []


def test_boundaries_against_a_plain_loop():
    rng = random.Random(1)
    for n in (0, 1, 5, 16, 17, 400):
        text = bytes(rng.randrange(256) for _ in range(n))
        assert sub.boundaries(text).tolist() == plain_boundaries(text)


def test_boundaries_resist_insertions():
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 123) for _ in range(3000))
    a = {text[i:j] for i, j in zip([0, *sub.boundaries(text)], sub.boundaries(text), strict=False)}
    moved = b"inserted" + text[:1500] + b"!" + text[1500:]
    b = {moved[i:j] for i, j in zip([0, *sub.boundaries(moved)], sub.boundaries(moved), strict=False)}
    assert len(a & b) >= len(a) - 4


def plain(rows, min_words):
    """All chunks in one table: what is removed of each row."""
    rows = sorted(((-(2**63) if i is None else i, (t or "").encode()) for i, t, *_ in rows), key=lambda r: r)
    first, out = {}, []
    for k, (i, t) in enumerate(rows):
        ends = sub.boundaries(t)
        for p, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
            first.setdefault(t[a:b], (k, p))
    for k, (i, t) in enumerate(rows):
        ends = sub.boundaries(t)
        repeated = np.array([first[t[a:b]] != (k, p) for p, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False))], dtype=bool)
        for a, b, _ in sub.runs(t, ends, repeated, min_words) if len(ends) else []:
            out.append((None if i == -(2**63) else i, t[a:b].decode()))
    return sorted(out, key=str)


def test_documents(spark, odd, odd_rows, monkeypatch):
    for group in (512, 4):
        monkeypatch.setattr(sub, "GROUP", group)
        found = sub.repeats(odd, 8).collect()
        assert sorted([(r["doc_id"], r["passage"]) for r in found], key=str) == plain(odd_rows, 8)
        texts = {i: t for i, t, *_ in odd_rows}
        assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["passage"] for r in found)


def test_a_shared_passage_is_cut_and_the_rest_is_left(spark, words):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(30)} {passage} {text(30)}", "en", "a") for i in range(12)] + [(100 + i, text(80), "en", "a") for i in range(12)]
    df = frame(spark, rows)
    found = sub.repeats(df)
    assert {r["doc_id"] for r in found.collect()} == set(range(1, 12))
    assert {r["first_doc_id"] for r in found.collect()} == {0}
    out = {r["doc_id"]: r for r in sub.remove_repeats(df).collect()}
    assert sub.remove_repeats(df).columns == df.columns
    for i, t, *_ in rows:
        if i == 0 or i >= 100:
            assert out[i]["text"] == t
        else:
            assert len(out[i]["text"].split()) < 85 and out[i]["text"].split()[:30] == t.split()[:30] and out[i]["text"].split()[-30:] == t.split()[-30:]
        assert out[i]["n_chars"] == len(out[i]["text"]) and (out[i]["pos"], out[i]["id"], out[i]["count"]) == ("p", "q", 7)


def test_rows_stay(odd, none):
    assert sub.remove_repeats(odd).count() == odd.count()
    assert sub.remove_repeats(odd).where("doc_id = 0 and text is null").count() == 1
    assert sub.repeats(none).count() == 0 and sub.remove_repeats(none).count() == 0


def test_every_passage_over_50_words_is_found(spark):
    """Passages of 51 words whose chunk ends leave fewer than 20 words between them, and one without any chunk end."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))
    passages = []
    while len(passages) < 8:
        p = text(51)
        ends = sub.boundaries(f" {p} ".encode())[:-1]
        if len(ends) < 2 or len(p.encode()[ends[0] : ends[-1]].split()) < 20:
            passages.append(p)
    flat = next(w for w in (text(1) for _ in range(1000)) if len(sub.boundaries(f"{w} ".encode() * 60)) == 1)
    passages.append(" ".join([flat] * 60))
    rows = [(100 * k + i, f"{text(30)} {p} {text(30)}", "en", "a") for k, p in enumerate(passages) for i in range(3)]
    df = frame(spark, rows)
    found = sub.repeats(df).collect()
    assert {r["doc_id"] for r in found} >= {100 * k + i for k in range(len(passages)) for i in (1, 2)}
    texts = {i: t for i, t, *_ in rows}
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["passage"] and r["n_words"] >= 20 for r in found)
    out = {r["doc_id"]: r["text"] for r in sub.remove_repeats(df).collect()}
    for i, t in texts.items():
        assert out[i].split()[:30] == t.split()[:30] and out[i].split()[-30:] == t.split()[-30:]
        assert out[i] == t if i % 100 == 0 and i < 800 else len(out[i]) <= len(t)


def test_an_anchor_of_one_text_stays_where_it_stands_first(spark):
    df = frame(spark, [(1, "spam " * 25 + " ".join(f"w{i}" for i in range(60)), "en", "a")])
    assert sub.repeats(df).count() == 0
