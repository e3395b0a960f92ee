"""Exact top-k inner-product search: columnar branch and bound over blocks of dimensions.

Vectors are kept vertically, dimension by dimension, in packs of candidates. For a block of queries the scores are
accumulated one block of dimensions at a time. After each block a candidate stays only if its partial score plus
the most that the remaining dimensions can add (product of the remaining norms, Cauchy-Schwarz) reaches the score
that the query's k-th best has so far; survivors are compacted before the next block.

Each component becomes floor(64 * x), so scores are integers and exact. Query blocks meet the packs of one span of
candidates in one task, which streams the packs and keeps k rows a query; spans are merged by a last ranking.

A candidate is copied once per query block. Blocks are as large as a task holds, and fewer queries than that are in a
number of blocks that depends on the parallelism only, so the shuffle grows in proportion to the table up to
``QUERIES`` times that number of queries, and beyond by one copy of the candidates for each further ``QUERIES``.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a query is compared
with vectors of its own length only, and never with rows of its own vec_id; with fewer than k candidates all are
returned; ties go to the smaller vec_id; repeated rows of one vec_id are candidates each, and as queries share one list
of k; null ids take no part; an integer component or a score beyond 64 bits counts as the nearest one within; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import parallelism

K, EVERY, SCALE = 20, 20, 64
#: Candidates of a pack at most and at least, queries of a block, queries at once, and packs of a span.
PACK, LEAST_PACK, QUERIES, NEAR, SPAN = 4096, 256, 16_384, 256, 256
#: Dimensions of a block; survivors are compacted when under this share of the pairs is left.
BLOCK, SPARSE = 16, 0.25
#: Up to here a product of two components, summed over the dimensions, is exact in a double.
EXACT = 2**53
#: Largest integers; products that may reach beyond are taken one by one.
LARGEST = 2**63 - 1

PACKS = "dims int, block long, kind int, ids binary, matrix binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and the integer components of the vectors that take part."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", good))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"))


_PACK_SCHEMA = pa.schema([("dims", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())])


def _packs(limit: int, kind: int):
    """Batches of (vec_id, block, v) to packs: vertical matrices of at most ``limit`` vectors of one length and block."""

    def out(dims: int, block: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
        wide = np.int64 if rows.size and np.abs(rows).max() >= 2**15 else np.int16
        body = struct.pack("<i", np.dtype(wide).itemsize) + np.ascontiguousarray(rows.T.astype(wide)).tobytes()
        return pa.RecordBatch.from_pydict({"dims": [dims], "block": [block], "kind": [kind], "ids": [ids.tobytes()], "matrix": [body]}, schema=_PACK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            lists = batch.column(2)
            sizes, ids, blocks = np.asarray(lists.value_lengths()).astype(np.int64), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, at = np.maximum(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), -LARGEST), np.concatenate([[0], np.cumsum(sizes)])
            for dims, block in sorted(set(zip(sizes.tolist(), blocks.tolist(), strict=True))):
                rows = np.flatnonzero((sizes == dims) & (blocks == block))
                for i in range(0, len(rows), limit):
                    cut = rows[i : i + limit]
                    own = held.setdefault((dims, block), [])
                    own.append((ids[cut], flat[at[cut][:, None] + np.arange(dims)].reshape(len(cut), dims)))
                    if sum(len(x) for x, _ in own) >= limit:
                        yield out(dims, block, held.pop((dims, block)))
        for (dims, block), parts in held.items():
            yield out(dims, block, parts)

    return run


def _unpack(dims: int, ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int16 if struct.unpack_from("<i", matrix)[0] == 2 else np.int64
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(matrix, kind, offset=4).reshape(dims, len(own))


def _rest(m: np.ndarray) -> np.ndarray:
    """Norms of what is left after each block of dimensions, per vector, rounded up."""
    squares = np.square(m.astype(np.float64))
    blocks = [squares[i : i + BLOCK].sum(axis=0) for i in range(0, len(m), BLOCK)]
    left = np.cumsum(np.array([np.zeros(m.shape[1]), *blocks[::-1]]), axis=0)[::-1]
    return np.sqrt(left) * (1 + 1e-9)


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.k, self.n = ids, k, len(ids)
        self.q = queries
        self.top = np.abs(queries).max(axis=0).astype(np.float64) if queries.size else np.zeros(self.n)
        self.rest = _rest(queries)
        self.scores = np.full((self.n, k), -LARGEST - 1, dtype=np.int64)
        self.found = np.full((self.n, k), LARGEST, dtype=np.int64)
        self.held = np.zeros(self.n, dtype=np.int64)
        self.least = np.full(self.n, -np.inf)

    def meet(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Search one pack of candidates, for some queries at a time."""
        if not len(ids) or not self.n:
            return
        rest = _rest(m)
        top = np.abs(m).max(axis=0).astype(np.float64) if m.size else np.zeros(len(ids))
        bound = max(top.max(), 1) * max(self.top.max(), 1) * max(len(m), 1)
        kind = np.float64 if bound < EXACT else np.int64
        v = m.astype(kind)
        open_ = np.flatnonzero(self.rest[0] * rest[0].max() >= self.least)  # the others have k that the pack cannot reach
        for i in range(0, len(open_), NEAR):
            rows = open_[i : i + NEAR]
            unsafe = np.nonzero(np.outer(self.top[rows], top) * len(m) >= 2.0**62) if bound >= 2.0**62 else None
            self._keep(*self._pairs(rows, ids, v, rest, kind, unsafe))
            if unsafe is not None:
                pairs = [(r, c) for r, c in zip(rows[unsafe[0]].tolist(), unsafe[1].tolist(), strict=True) if self.ids[r] != ids[c]]
                exact = [sum(a * b for a, b in zip(self.q[:, r].tolist(), m[:, c].tolist(), strict=True)) for r, c in pairs]
                part = np.array([min(max(x, -LARGEST), LARGEST) for x in exact], dtype=np.int64)
                at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
                self._keep(at[:, 0], ids[at[:, 1]], part)

    def _pairs(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, rest: np.ndarray, kind: type, unsafe: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (query, id, score) that may be among the k best, by blocks of dimensions."""
        q, left, least, dims = self.q[:, rows].astype(kind), self.rest[:, rows], self.least[rows], len(v)
        alive = self.ids[rows][:, None] != ids[None, :]
        if unsafe is not None:
            alive[unsafe] = False
        part = np.zeros((len(rows), len(ids)), dtype=kind)
        pairs = None
        for b, i in enumerate(range(0, dims, BLOCK)):
            if pairs is None:
                part += q[i : i + BLOCK].T @ v[i : i + BLOCK]
                alive &= part + left[b + 1][:, None] * rest[b + 1][None, :] >= least[:, None]
                if np.count_nonzero(alive) <= SPARSE * alive.size:
                    pairs = np.nonzero(alive)
                    part = part[pairs]
            else:
                qi, ci = pairs
                part = part + np.einsum("dp,dp->p", q[i : i + BLOCK][:, qi], v[i : i + BLOCK][:, ci])
                keep = part + left[b + 1][qi] * rest[b + 1][ci] >= least[qi]
                pairs, part = (qi[keep], ci[keep]), part[keep]
        if pairs is None:
            if len(ids) > self.k:  # of a full row only what reaches its own k-th is of use
                low = np.where(alive, part, part.min() if kind is np.float64 else -LARGEST)
                alive &= part >= np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k][:, None]
            pairs = np.nonzero(alive)
            part = part[pairs]
        return rows[pairs[0]], ids[pairs[1]], part.astype(np.int64)

    def _keep(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge into the k best; ties go to the smaller id."""
        if not len(query):
            return
        met = np.unique(query)
        old = np.repeat(met, self.held[met])
        there = np.arange(self.k)[None, :] < self.held[met][:, None]
        query, score, ids = np.concatenate([old, query]), np.concatenate([self.scores[met][there], score]), np.concatenate([self.found[met][there], ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        sizes = np.diff(np.append(first, len(query)))
        rank = np.arange(len(query)) - np.repeat(first, sizes)
        keep = rank < self.k
        self.scores[query[keep], rank[keep]], self.found[query[keep], rank[keep]] = score[keep], ids[keep]
        self.held[met] = np.minimum(sizes, self.k)
        full = met[self.held[met] == self.k]
        self.least[full] = self.scores[full, self.k - 1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = np.arange(self.k)[None, :] < self.held[:, None]
        return np.repeat(self.ids, self.held), self.found[there], self.scores[there]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None

        def out(best: Best) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.rows()], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for dims, block, span, kind, ids, matrix in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (dims, block, span) != at:
                    if best is not None:
                        yield out(best)
                    at, best = (dims, block, span), None
                own, m = _unpack(dims, ids, matrix)
                if kind == 0:  # a block's queries may come in several packs, all before the candidates
                    best = Best(own, m.astype(np.int64), k) if best is None else Best(np.concatenate([best.ids, own]), np.concatenate([best.q, m.astype(np.int64)], axis=1), k)
                elif best is not None:
                    best.meet(own, m)
        if best is not None:
            yield out(best)

    return run


def layout(all_rows: int, asked: int, n: int) -> tuple[int, int, int]:
    """Query blocks, spans of candidates and candidates of a pack, for a table and a parallelism of ``n``.

    Twice ``n`` tasks at least; of the ways to cut them, one that copies little: a candidate goes to each block, a query
    and its k rows to each span, and there are some twenty candidates a query.
    """
    blocks = max(1, -(-asked // QUERIES), round(n**0.5 / 2))
    spans = max(1, -(-all_rows // (PACK * SPAN)), -(-2 * n // blocks))
    return blocks, spans, min(PACK, max(LEAST_PACK, -(-all_rows // (4 * spans))))


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows for each row whose id is divisible by ``every``.

    Candidates are copied once per query block and queries once per span, as packs, so the work is dealt out over
    blocks x spans tasks, and a task holds one query block and one pack. Rows are dealt out by their place, not by
    their id, of which many may be equal.
    """
    spark = embeddings.sparkSession
    n = parallelism(spark)
    rows = usable(embeddings)
    asked = F.col("vec_id") % every == 0
    count = rows.agg(F.count("*").alias("all"), F.count_if(asked).alias("asked")).first()
    blocks, spans, pack = layout(count["all"], count["asked"], n)
    place = F.xxhash64(F.monotonically_increasing_id())
    queries = rows.where(asked).withColumn("block", F.pmod(place, F.lit(blocks)))
    queries = queries.repartition(n, "block").select("vec_id", "block", "v").mapInArrow(_packs(QUERIES, 0), PACKS)
    candidates = rows.select("vec_id", F.lit(0).cast("long").alias("block"), "v").mapInArrow(_packs(pack, 1), PACKS)
    every_of = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    order = ["dims", "block", "span", "kind", "ids", "matrix"]
    candidates = candidates.withColumn("span", F.pmod(place, F.lit(spans)).cast("long")).withColumn("block", every_of(blocks))
    meeting = queries.withColumn("span", every_of(spans)).select(order).unionByName(candidates.select(order))
    found = meeting.repartition(4 * n, "dims", "block", "span").sortWithinPartitions("dims", "block", "span", "kind")
    found = found.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
