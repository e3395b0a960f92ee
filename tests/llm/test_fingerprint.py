from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import fingerprint as fp


def test_equal_texts_have_equal_fingerprints():
    a = fp.digests("one\ntwo\ntwo\n\nthree")
    assert fp.encode([a]) == fp.encode([fp.digests("one\ntwo\ntwo\nthree")])
    assert len(set(a.tolist())) == 4


def test_difference_of_stored_fingerprints():
    a, b = fp.digests("one\ntwo\nthree"), fp.digests("one\nzwei\nthree\nfour")
    only_a, only_b = fp.difference(*fp.encode([a, b]))
    assert (only_a, only_b) == (sorted(set(a.tolist()) - set(b.tolist())), sorted(set(b.tolist()) - set(a.tolist())))
    many = fp.digests("\n".join(f"line {i}" for i in range(500)))
    assert fp.difference(*fp.encode([a, many])) is None


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300))), min_size=1, max_size=5))
def test_compare_recovers_every_difference(pairs):
    of = lambda s: fp.mix(np.array(sorted(s), dtype=np.uint64) + np.uint64(1))
    likeness, only_a, only_b, cells = fp.compare([of(a) for a, _ in pairs], [of(b) for _, b in pairs])
    for i, (a, b) in enumerate(pairs):
        assert sorted(only_a[i]) == sorted(of(a - b).tolist()) and sorted(only_b[i]) == sorted(of(b - a).tolist())
        assert likeness[i] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert cells[i] > 0


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for k, (i, t, *_) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        sets = [set(fp.digests(x).tolist()) for x in (t, e, n)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *fp.encode([fp.digests(t), fp.digests(e)]), *(round(x, 9) for x in near)))
    return sorted(out, key=str)


def test_documents(odd, odd_rows):
    found = fp.fingerprints(odd, ranges=7).collect()
    assert sorted([(r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in found], key=str) == brute(odd_rows)


def test_one_row_and_none(spark, odd, none):
    one = odd.where("doc_id = 3")
    assert fp.fingerprints(one).first()["near_next"] == 1.0
    assert fp.fingerprints(none).count() == 0
