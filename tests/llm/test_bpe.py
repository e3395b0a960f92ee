from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattica.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
MINE, OTHER = bpe.Bpe(PATH), Tokenizer.from_file(PATH)


def same(texts):
    found = MINE.encode_batch(texts)
    for t, f, e in zip(texts, found, OTHER.encode_batch(texts, add_special_tokens=False), strict=True):
        assert f == (len(e.ids), " ".join(map(str, e.ids)), OTHER.decode(e.ids, skip_special_tokens=False)), t
        assert MINE.decode(e.ids) == f[2]


def test_fixed_texts():
    same(["", " \n\t", "Hello, WORLD's 123 they'LL", "ΟΔΟΣ ΣΑΣ İstanbul ﬁ é   x\u0085y\x1cz", "<|startoftext|>a<|endoftext|>b <|start", "a" * 300, "ab" * 1000, "日本語 😀😀 !!??", "naïve—café…"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abcdet's <|>ÉéßΣσ1\n"), st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_same_as_the_library(texts):
    same(texts)


@pytest.mark.parametrize("template", ["a{}b1", "{0}{0}.", "1{}á"])
def test_every_code_point(template):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same([" ".join(template.format(c) for c in every[i : i + 500]) for i in range(0, len(every), 500)])


def test_one_tree_and_many_trees_agree():
    rng = random.Random(1)
    pieces = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 300))).encode() for _ in range(300)]
    sizes = np.array([len(p) for p in pieces])
    ids, counts = MINE.merge(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes)
    for p, own in zip(pieces, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        raw = np.frombuffer(p, np.uint8)
        assert own.tolist() == MINE.merge_one([*MINE.inner[raw[:-1]].tolist(), int(MINE.last[raw[-1]])])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abstremvld'’1²\u00a0é!ßx"), min_size=1, max_size=12).filter(lambda w: w.encode().split() == [w.encode()]), min_size=1, max_size=8))
def test_spans_are_those_of_the_pattern(words):
    words = [w.encode() for w in words]
    raw, starts, sizes, owners = MINE.spans(words)
    found = [(o, raw[i : i + n].tobytes()) for o, i, n in zip(owners.tolist(), starts.tolist(), sizes.tolist(), strict=True)]
    assert found == [(k, p.encode()) for k, w in enumerate(words) for p in MINE.pieces.findall(w.decode())]


def test_segments_of_a_long_text(monkeypatch, words):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(30)] + ["\n", "", "<|endoftext|>" * 9, "x" * 500 + " y"]
    monkeypatch.setattr(bpe, "SEGMENT", 64)
    monkeypatch.setattr(bpe, "AT_ONCE", 300)
    same(texts)


def test_small_cache(monkeypatch, words):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 2000)
    for i in range(0, 60, 6):
        same([" ".join(words[i : i + 6])])


def test_documents(odd, odd_rows, none):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, *_ in odd_rows:
        e = OTHER.encode(t or "", add_special_tokens=False)
        want.append((i, len(e.ids), sha(" ".join(map(str, e.ids))), sha(OTHER.decode(e.ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.encode_documents(odd, PATH).collect()), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(none, PATH).count() == 0
    with_texts = bpe.encode_documents(odd, PATH, ids=True, decoded=True).where("doc_id = 10").first()
    assert sha(" ".join(map(str, with_texts["ids"]))) == with_texts["ids_sha256"] and sha(with_texts["decoded"]) == with_texts["decoded_sha256"]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_tree_gives_the_leftmost_least(n):
    rng = random.Random(n)
    leaves = [rng.randrange(9) << bpe.PLACE | i for i in range(n)]
    tree = bpe.Tree(list(leaves))
    for _ in range(20):
        assert tree.nodes[1] == min(leaves)
        at = rng.randrange(n)
        leaves[at] = rng.randrange(9) << bpe.PLACE | at
        tree.put(at, leaves[at])
