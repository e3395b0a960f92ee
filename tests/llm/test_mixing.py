from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import mixing

from .conftest import frame


def plain_targets(sizes):
    """One source clamped at a time, until none is above its cap."""
    weight = dict(mixing.weights_of(list(sizes)))
    fixed, total = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("abÄ😀", max_size=2)), st.integers(0, 1000), max_size=8))
def test_water_filling(sizes):
    found = mixing.water_fill(sizes)
    assert found == pytest.approx(plain_targets(sizes))
    assert sum(found.values()) == pytest.approx(sum(sizes.values()))
    assert all(found[s] <= 3 * sizes[s] + 1e-9 for s in sizes)


def test_sources_are_ordered_by_code_point():
    assert mixing.weights_of([None, "b", "B", "😀", "￿"]) == [("B", 1), ("b", 2), ("￿", 3), ("😀", 1), (None, 2)]


def test_shares(spark, odd, odd_rows):
    found = mixing.shares(odd).collect()
    assert sorted(r["size"] for r in found) == sorted(len((t or "").encode().split()) for _, t, *_ in odd_rows)
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for _, t, _, s in odd_rows:
        sizes[s] += len((t or "").encode().split())
    wanted = mixing.water_fill(dict(sizes))
    by_target = {round(v, 6): k for k, v in wanted.items()}
    for r in found:
        s = by_target[round(r["target"], 6)]
        assert r["source_size"] == sizes[s] and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= max(1, largest[s])
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.shares(odd.repartition(5)).collect()), key=str)


def test_many_documents_meet_their_targets(spark):
    rows = [(i, "w " * (i % 13 + 1), "en", "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = frame(spark, rows)
    found = mixing.shares(df)
    by_source = found.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg({"target": "max", "taken": "sum"}).collect()
    assert all(abs(r["max(target)"] - r["sum(taken)"]) <= 13 for r in by_source)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(r["taken"] == r["size"] * times.get(r["doc_id"], 0) for r in found.collect())


def test_equal_rows_meet_their_targets(spark):
    df = frame(spark, [(1, "w", "en", "a")] * 3000 + [(1, "w", "en", "b")] * 17000).repartition(7).persist()
    found = mixing.shares(df).collect()
    taken = Counter()
    for r in found:
        taken[r["target"], r["source_size"]] += r["taken"]
    want = mixing.water_fill({"a": 3000, "b": 17000})
    assert taken == {(want["a"], 3000): round(want["a"]), (want["b"], 17000): round(want["b"])}
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.shares(df.repartition(2)).collect()))
    assert mixing.mix_documents(df).groupBy("source").count().collect() == [(s, round(want[s])) for s in [r[0] for r in mixing.mix_documents(df).groupBy("source").count().collect()]]


INNER = ["target", "rest", "whole", "edge_bin", "size", "number", "bin", "hash", "part", "times", "document", "copy", "plan_source", "text_hash", "a", "b"]


def test_columns_of_any_name(spark, odd_rows):
    df = frame(spark, odd_rows)
    plain = mixing.mix_documents(df).collect()
    for name in INNER:
        df = df.withColumn(name, F.lit(name))
    found = mixing.mix_documents(df)
    assert found.columns == df.columns and mixing.shares(df).count() == len(odd_rows)
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == sorted((tuple(r)[:5] for r in plain), key=str)
    assert {tuple(r[n] for n in INNER) for r in found.select(INNER).collect()} == {tuple(INNER)}


def test_empty_table(none):
    assert mixing.shares(none).count() == 0
    assert mixing.mix_documents(none).count() == 0
