"""Mixing sources to target weights by capped water-filling.

Sources share the sum of all sizes by weight; a source is clamped at ``EPOCHS`` times its size and what is left over
is shared again by weight among the others, until none is above its cap. A source's target is met by whole
repetitions of all its documents and one more of a seeded selection: documents come in a seeded order, and a
histogram of that order finds the point up to which they are taken, so the taken words miss the target by half a
document at most.

Rows that agree in id, source and text are numbered, and the number goes into the seeded order, so that some of them
may be taken and others not. A group of such rows may hold a third of the table: they are numbered within the
partitions they were read from, and the partitions' counts are added up, so no task holds a group.

Sizes are words; null texts have size 0. Sources are ordered by code point, null last, and weigh 1, 2, 3 in turn.

Defined results: a source of size 0 has target 0; texts of any length are counted whole; repeated rows are rows of
their own, of which any may be taken as they are alike; rows without id are told apart by text; of equal places in the
seeded order the one with the smaller id comes first; extra columns of any name are ignored or, in
``mix_documents``, kept; an empty table gives no rows.

The driver holds one row per source (name, sum, target, cut).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD, bounded_broadcast, stage, unstage

WEIGHTS, EPOCHS, SEED = (1, 2, 3), 3, 20_240_607
#: Bins of the seeded order, a source each.
BINS = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs outside ASCII white space; every run becomes one letter and the rest goes."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def weights_of(sources: list[str | None], weights: tuple[int, ...] = WEIGHTS) -> list[tuple[str | None, int]]:
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sources)
    return [(s, weights[i % len(weights)]) for i, s in enumerate(ordered)]


def water_fill(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> dict[str | None, float]:
    """The target of each source."""
    weight = dict(weights_of(list(sizes), weights))
    targets: dict[str | None, float] = {}
    open_, left = list(weight), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > epochs * sizes[s]]
        if not above:
            return targets | share
        for s in above:
            targets[s] = float(epochs * sizes[s])
            left -= targets[s]
        open_ = [s for s in open_ if s not in targets]
    return targets


#: What tells rows apart.
SAME = ["source", "doc_id", "size", "text_hash"]


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size and a hash of the text, and the columns asked for besides."""
    text = F.col("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text, text.isNull()).alias("text_hash"), *more)


def _equal(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in SAME:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _repeated_rows(small: DataFrame) -> DataFrame:
    """What rows that are there more than once have in common."""
    return small.groupBy(*SAME).agg(F.count("*").alias("k")).where("k > 1").select(*SAME)


def _numbered(again: DataFrame) -> DataFrame:
    """``again``: repeated rows with ``part``, the partition they were read from. Adds their number among equal rows."""
    sizes = again.groupBy(*SAME, "part").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy(*SAME).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*SAME, "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = again.withColumn("own", F.row_number().over(Window.partitionBy(*SAME, "part").orderBy(F.lit(0))) - 1)
    both = own.alias("a").join(sizes.alias("b"), _equal("a", "b") & (F.col("a.part") == F.col("b.part")))
    return both.select(*[F.col(f"a.{c}") for c in again.columns if c != "part"], (F.col("a.own") + F.col("b.before")).cast("long").alias("number"))


def _placed(numbered: DataFrame) -> DataFrame:
    """Adds the place in the seeded order: its bin and its hash."""
    h = F.xxhash64(F.lit(SEED), "doc_id", "text_hash", "number")
    return numbered.withColumns({"bin": F.pmod(h, F.lit(BINS)), "hash": h})


def _seeded(rows: DataFrame, repeated: DataFrame, part: bool) -> DataFrame:
    """Rows with their place. Repeated ones, and only those, are numbered; without ``part`` they are staged for it."""
    first = rows.drop("part").withColumn("number", F.lit(0).cast("long"))
    if not (n := repeated.count()):
        return _placed(first)
    keys = bounded_broadcast(repeated, n).alias("b")
    again = rows.alias("a").join(keys, _equal("a", "b"), "left_semi")
    if not part:
        again = stage(again.withColumn("part", F.spark_partition_id()), "mix-again")
    once = first.alias("a").join(keys, _equal("a", "b"), "left_anti")
    return _placed(once.unionByName(_numbered(again)))


def _key() -> Column:
    return F.struct(F.col("hash").alias("h"), F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.col("text_hash").alias("t"), F.col("number").alias("n"))


PLAN = "plan_source string, source_size long, target double, whole int, rest double"


def _plan(seeded: DataFrame) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, and where the selection for one more ends."""
    spark = seeded.sparkSession
    sums = stage(seeded.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    sizes = {r["source"]: int(r["words"] or 0) for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    targets = water_fill(sizes)
    rows = []
    for s, size in sizes.items():
        whole = int(targets[s] // size) if size else 0
        rows.append((s, size, targets[s], whole, targets[s] - whole * size))
    plan = bounded_broadcast(spark.createDataFrame(rows, PLAN), len(rows))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    run = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    # the last bin that begins before the rest is used up holds the cut
    last = run.where(F.col("before") < F.col("rest")).groupBy("plan_source").agg(F.max(F.struct("bin", "before")).alias("l"))
    known = {r["plan_source"]: (r["l"]["bin"], r["l"]["before"]) for r in last.collect()}
    full = [(*r, *known.get(r[0], (-1, 0))) for r in rows]
    plan = bounded_broadcast(spark.createDataFrame(full, PLAN + ", edge_bin long, edge_before long"), len(full))
    inside = seeded.select(*SAME, "number", "bin", "hash").join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("bin") == F.col("edge_bin")))
    order = Window.partitionBy("source").orderBy(_key()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = inside.withColumn("upto", F.sum("size").over(order) + F.col("edge_before"))
    taken = upto.where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("plan_source").agg(F.max(_key()).alias("edge_key"))
    keys = {r["plan_source"]: tuple(r["edge_key"]) for r in taken.collect()}
    out = [(*r, *keys.get(r[0], (None, None, None, None))) for r in full]
    unstage(sums)
    return bounded_broadcast(spark.createDataFrame(out, PLAN + ", edge_bin long, edge_before long, edge_h long, edge_i long, edge_t long, edge_n long"), len(out))


def _times(seeded: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds how often each row is taken."""
    edge = F.struct(F.col("edge_h").alias("h"), F.col("edge_i").alias("i"), F.col("edge_t").alias("t"), F.col("edge_n").alias("n"))
    more = (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & F.col("edge_h").isNotNull() & (_key() <= edge))
    return seeded.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("times", F.col("whole") + F.when(more, 1).otherwise(0))


def _sizes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without their texts, and what is there more than once."""
    small = stage(_rows(docs).withColumn("part", F.spark_partition_id()), "mix-sizes")
    return small, stage(_repeated_rows(small), "mix-repeated")


def shares(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; texts are read once."""
    small, repeated = _sizes(docs)
    if small.isEmpty():
        return small.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    seeded = stage(_seeded(small, repeated, True), "mix-places")
    unstage(small, repeated)
    return _times(seeded, _plan(seeded)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with its columns."""
    small, repeated = _sizes(docs)
    if small.isEmpty():
        return docs
    places = stage(_seeded(small, repeated, True), "mix-places")
    plan = _plan(places)
    unstage(small, places)
    rows = _rows(docs, F.struct(*[F.col(c) for c in docs.columns]).alias("document"))
    out = _times(_seeded(rows, repeated, False), plan)
    return out.select("document", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).select("document.*")
