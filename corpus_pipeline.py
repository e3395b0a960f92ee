"""The corpus pipeline: reject, deduplicate, trim, mix and tokenize `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of `documents`.

Defined results of every stage: an empty table gives no rows; extra columns of any name are kept, by the last stage
ignored; texts are taken whole, whatever their length. What holds besides is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bpe, mixing, ngram_join, quality, substring
from lattica.llm.common import stage, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores under 0.5 go.

    A null text is scored as an empty one; equal texts, and so repeated rows, stay or go together; a score of 0.5 stays;
    lang, source and doc_id, null or not, do not matter.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of linked documents stays.

    Documents with a null doc_id, or with a null, empty or blank text, are linked with nothing and stay; of several rows
    of one doc_id the first by text stays, so of repeated rows one.
    """
    return ngram_join.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; every document stays, in the end with an empty text.

    A null text stays null; a null doc_id comes first; rows of one doc_id are ordered by text, and the later of two
    equal rows loses its repeated passages; n_chars is counted again, 0 for a null text.
    """
    return substring.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources meet their target weights.

    A null source is a source of its own, the last; a null text has size 0, and a source of size 0 is not taken; rows
    that agree in all that tells them apart are numbered, so that some may be taken and others not.
    """
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document taken, with the digests that the BPE query returns.

    A null text has no ids; every row, repeated or without doc_id, has its own result.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mix_sources", mix_sources),
    ("bpe_encode", tokenize),
]

#: The stages learn, hash and tokenize; no SQL expresses them. tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole of `documents`; each is written to the shared folder but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
