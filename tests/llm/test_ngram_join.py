from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import ngram_join as nj
from lattica.llm.components import components

from .conftest import frame


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def tie(x, y):
        root[find(x)] = find(y)

    inverse = defaultdict(list)
    for k, s in enumerate(sets):
        if rows[k][0] is not None:
            for g in s:
                inverse[g].append(k)
    for k, s in enumerate(sets):
        both = Counter(j for g in s for j in inverse[g] if j != k) if rows[k][0] is not None else {}
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                tie(k, j)
    by_id = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None and sets[k]:
            by_id[r[0]].append(k)
    for ks in by_id.values():
        for k in ks[1:]:
            tie(ks[0], k)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted([(r[0], len(sets[k]), None if r[0] is None else least[find(k)] if sets[k] else r[0]) for k, r in enumerate(rows)], key=str)


def found(spark, rows, parts=3):
    return sorted([tuple(r) for r in nj.link_documents(frame(spark, [(*r, None, None)[:4] for r in rows]).repartition(parts)).collect()], key=str)


def test_odd_documents(odd, odd_rows):
    assert sorted([tuple(r) for r in nj.link_documents(odd).collect()], key=str) == brute(odd_rows)


def test_many_near_copies_and_shared_passages(spark, words):
    rng = random.Random(9)
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage, base = [], text(30), text(120)
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((1000 - i, " ".join(t[: rng.randint(95, 120)])))
    rows += [(2000 + i, " ".join(passage + text(rng.randint(1, 40)))) for i in range(80)]
    rows += [(3000 + i, " ".join(text(rng.randint(1, 9)))) for i in range(30)]
    rows += [(4000 + i, "A b C d") for i in range(3)] + [(4000, "another text of the same id")]
    assert found(spark, rows) == brute(rows)


def test_product_finds_what_the_bands_miss(spark, words, monkeypatch):
    """Without any leader pairs the product between components must find every link."""
    rng = random.Random(10)
    base = [rng.choice(words) for _ in range(80)]
    rows = [(i, " ".join(base[:k] + [f"w{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 80, 9))]
    rows += [(50 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)]
    stars = nj._stars
    monkeypatch.setattr(nj, "_stars", lambda classes: nj.stage(stars(classes).limit(0), "none"))
    assert found(spark, rows) == brute(rows)


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words[:104])), (2, " ".join(words[:79])), (3, " ".join(words[:78]))]  # 100, 75 and 74 shingles
    assert found(spark, rows[:2]) == [(1, 100, 1), (2, 75, 1)]
    assert found(spark, [rows[0], rows[2]]) == [(1, 100, 1), (3, 74, 3)]


def test_empty_table(none):
    assert nj.link_documents(none).count() == 0
    assert nj.keep_one(none).count() == 0


def test_keep_one(odd, odd_rows):
    kept = [tuple(r) for r in nj.keep_one(odd).select("doc_id").collect()]
    expected = {r[0] for r in brute(odd_rows) if r[0] is not None and r[0] == r[2]}
    assert sorted(x for (x,) in kept if x is not None) == sorted(expected)
    assert (None,) in kept


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 340)] + [(5, 5)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in edges:
        a, b = sorted((find(x), find(y)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: find(x) for x in root if any(find(x) == find(y) and x != y for y in root)}


def test_overlaps(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 60))) for _ in range(70)] + [np.arange(40)] * 30
    for left, right in ((sets, sets), (sets[:10], sets[50:]), (sets[:1], sets[:0])):
        want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
        assert nj.overlaps(left, right).tolist() == want


def test_tiles_of_several_blocks(spark, words, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(nj, "TILE", 4)
    base = [rng.choice(words) for _ in range(60)]
    rows = [(i, " ".join(base[: rng.randint(30, 60)] + [f"w{i}"] * rng.randint(0, 3))) for i in range(50)]
    stars = nj._stars
    monkeypatch.setattr(nj, "_stars", lambda classes: nj.stage(stars(classes).limit(0), "none"))
    assert found(spark, rows) == brute(rows)


def test_links_of_an_id_with_several_texts(spark, words, monkeypatch):
    """The product between components meets each class by a text of its own, whichever rows of its doc_id come first."""
    rng = random.Random(12)
    monkeypatch.setattr(nj, "_stars", lambda classes, stars=nj._stars: nj.stage(stars(classes).limit(0), "none"))
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for k in range(6):
        a, b = text(60), text(60)
        rows += [(10 * k, " ".join(a)), (10 * k, " ".join(b)), (10 * k + 1, " ".join([*a[:-1], "x"])), (10 * k + 2, " ".join([*b[:-1], "y"]))]
    assert found(spark, rows, 1) == brute(rows)
    assert found(spark, rows[::-1], 1) == brute(rows)


def test_entries_of_a_block_in_parts(monkeypatch):
    """Whatever waits in a task, each entry of a column of two classes or more comes out, and no other."""
    rng = random.Random(12)
    entries = sorted({(rng.randrange(200), rng.randrange(40)) for _ in range(400)} | {(7, c) for c in range(40)})
    rng.shuffle(entries)
    want = sorted((h, c) for h, c in entries if sum(x == h for x, _ in entries) > 1)
    for held in (1, 5, 10**6):
        monkeypatch.setattr(nj, "HELD", held)
        parts = [entries[i : i + 3] for i in range(0, len(entries), 3)]
        batch = pa.RecordBatch.from_pydict({"block": [0] * len(parts), "columns": [np.array([h for h, _ in p], np.uint64).tobytes() for p in parts], "classes": [np.array([c for _, c in p], np.int64).tobytes() for p in parts]})
        found = [x for b in nj._shared(iter([batch])) for x in zip(*(b.column(k).to_pylist() for k in (0, 1)), strict=True)]
        assert sorted(found) == want


def test_plans_stay_small(spark, odd, odd_rows, monkeypatch):
    """No table that is written is planned from more than some 50 operators: the driver plans anew after each shuffle."""
    operators, stage = {}, nj.stage

    def counted(df, name):
        operators[name] = max(operators.get(name, 0), df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return stage(df, name)

    for module in ("ngram_join", "components"):
        monkeypatch.setattr(f"lattica.llm.{module}.stage", counted)
    assert sorted([tuple(r) for r in nj.link_documents(odd).collect()], key=str) == brute(odd_rows)
    assert {"edges", "links"} <= set(operators) and max(operators.values()) <= 50, operators
