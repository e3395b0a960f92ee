from __future__ import annotations

import math

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    out.append(docs)
    for name, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(f(spark, docs, DATA), name)
        out.append(docs)
    return out


def test_columns_and_effect(stages):
    docs, good, single, cut, mixed, ids = stages
    for s in (good, single, cut, mixed):
        assert s.columns == docs.columns
    assert docs.count() > good.count() > single.count() == cut.count()
    assert cut.agg(F.sum(F.length("text"))).first()[0] < single.agg(F.sum(F.length("text"))).first()[0]
    assert ids.count() == mixed.count()


def test_rejected_documents_are_the_bad_ones(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = labels.join(stages[1], "doc_id", "left_semi")
    assert kept.where("quality = 1").count() >= 0.98 * labels.where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()


def test_one_of_each_group_stays(stages):
    from lattica.llm.ngram_join import link_documents

    groups = link_documents(stages[1])
    assert {r[0] for r in stages[2].select("doc_id").collect()} == {r["component_id"] for r in groups.collect()}


def test_tokens(stages):
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    for r in stages[5].collect():
        assert r["ids"] == other.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run_is_the_stages_in_order(spark, stages):
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert sorted(map(key, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(key, stages[-1].collect()))


def test_odd_documents_go_through_all_stages(spark, odd, odd_rows, none):
    """Nulls, empty and very long texts, ties and repeated rows, and extra columns whose names the stages use inside."""
    inner = ["document", "kept_id", "target", "rest", "whole", "edge_bin", "size", "statistics", "mark", "upper", "lattica_rest", "doc_group", "row", "there", "number"]
    for start, rows in ((odd, len(odd_rows)), (none, 0)):
        docs = start
        for name in inner:
            docs = docs.withColumn(name, F.lit(name))
        columns, counts = docs.columns, []
        for k, (name, f) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.stage(f(spark, docs, DATA), name)
            counts.append(docs.count())
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
                assert {tuple(r) for r in docs.select(inner).distinct().collect()} <= {tuple(inner)}
        assert rows >= counts[0] >= counts[1] == counts[2] and counts[3] == counts[4] and (rows == 0 or counts[1] > 0)


def test_rejected_rows_are_those_the_rules_score_low(spark, stages):
    """Stage 1 against a plain scoring from the fitted rules."""
    from lattica.llm import quality
    from lattica.llm.common import table

    labels = quality.pick(table(spark, DATA, "labels"))
    model = quality.learn(quality.with_statistics(stages[0]), labels)
    rows = quality.with_statistics(stages[0]).collect()
    score = lambda r: 1 / (1 + math.exp(-(model.intercept + sum(w for rule, w in model.rules if all((r[n] > t) if above else (r[n] <= t) for n, above, t in rule)))))
    assert {r["doc_id"] for r in stages[1].select("doc_id").collect()} == {r["doc_id"] for r in rows if score(r) >= 0.5}


def test_only_repeated_passages_go(spark, stages):
    """Stage 3 against the runs that the operator itself reports, cut out one by one."""
    from lattica.llm.substring import repeats

    cuts = {}
    for r in repeats(stages[2]).collect():
        cuts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    after = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[2].collect():
        text = r["text"]
        for start, length in sorted(cuts.get(r["doc_id"], []), reverse=True):
            text = text[:start] + text[start + length :]
        assert after[r["doc_id"]] == text


@pytest.mark.parametrize("k", [1, 2, 4])
def test_workers_get_texts_in_small_batches(spark, none, k):
    """An executor holds several copies of a batch; by the default of 64 MB a task's texts are one."""
    from lattica.llm.common import BATCH_BYTES

    for name in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        spark.conf.unset(name)
    corpus_pipeline.STAGES[k][1](spark, none, DATA)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 3000 and max(r["size"] for r in sizes) <= 2 * BATCH_BYTES
