"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A fingerprint has three sub-tables of cells (count, xor of digests, xor of checks). The cells of two versions
subtract; peeling cells that hold one digest recovers the paragraphs in which the versions differ. When peeling
gets stuck, the pair is sketched again with twice the cells until it succeeds.

Paragraphs are the non-empty lines; a line over ``LONG_LINE`` code points is cut after its sentence ends. The k-th
occurrence of a paragraph within a text has a digest of its own, so that a sketch holds a multiset.

Defined results: a null text counts as empty; two empty texts have likeness 1; rows with one doc_id follow each
other by text; a null doc_id comes first; a table of one row is its own next row; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import U64, mix, parallelism

LONG_LINE = 200
#: Cells of one of the three sub-tables in a stored fingerprint.
BASE_CELLS = 8
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
SALTS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))
CHECK = U64(0x27D4EB2F165667C5)
ROWS = 256
#: Cells worked on at once.
CELLS = 100_000


def paragraphs(text: str) -> list[str]:
    out: list[str] = []
    for line in text.split("\n"):
        if len(line) > LONG_LINE:
            out += SENTENCE_END.split(line)
        else:
            out.append(line)
    return [x for x in out if x]


def digests(text: str) -> np.ndarray:
    """One 64-bit digest per paragraph occurrence, each digest once.

    The number of the occurrence is mixed in after hashing: as a seed of the hash it can cancel against short texts.
    """
    seen: dict[str, int] = {}
    hashes, repeat = [], []
    for p in paragraphs(text):
        k = seen.get(p, 0)
        seen[p] = k + 1
        hashes.append(xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")))
        repeat.append(k)
    with np.errstate(over="ignore"):
        return np.unique(mix(np.array(hashes, dtype=U64) + np.array(repeat, dtype=U64) * SALTS[0]))


class Cells:
    """Sketches of ``n`` sets side by side, each of 3 * sub cells."""

    def __init__(self, n: int, sub: int):
        self.n, self.sub = n, sub
        self.count = np.zeros(n * 3 * sub, dtype=np.int32)
        self.key = np.zeros(n * 3 * sub, dtype=U64)
        self.check = np.zeros(n * 3 * sub, dtype=U64)

    def at(self, owner: np.ndarray, key: np.ndarray, j: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return owner * (3 * self.sub) + j * self.sub + (mix(key + SALTS[j]) % U64(self.sub)).astype(np.int64)

    def add(self, owner: np.ndarray, key: np.ndarray, sign: np.ndarray | int) -> None:
        check = mix(key ^ CHECK)
        for j in range(3):
            at = self.at(owner, key, j)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, key)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (owner, digest, sign) and, per set, whether all was recovered. Empties the cells."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(3 * self.sub + 8):
            pure = (np.abs(self.count) == 1) & (mix(self.key ^ CHECK) == self.check)
            at = np.flatnonzero(pure)
            if not len(at):
                break
            owner, key, sign, j = at // (3 * self.sub), self.key[at], self.count[at], (at // self.sub) % 3
            keep = np.ones(len(at), dtype=bool)  # a digest alone in several of its cells counts once
            for k in (0, 1):
                other = self.at(owner, key, k)
                keep &= ~((j > k) & pure[other] & (self.key[other] == key))
            owner, key, sign = owner[keep], key[keep], sign[keep]
            self.add(owner, key, -sign)
            found.append((owner, key, sign))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = ~left.reshape(self.n, 3 * self.sub).any(axis=1) if self.n else np.zeros(0, dtype=bool)
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int32)]
        return parts[0], parts[1], parts[2], done


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    return owner, np.concatenate([*sets, np.zeros(0, U64)])


def encode(sets: list[np.ndarray], sub: int = BASE_CELLS) -> list[str]:
    """Fingerprints as text: the number of paragraphs, a colon, and the cells in base 64."""
    cells = Cells(len(sets), sub)
    cells.add(*flat(sets), 1)
    out, width = [], 3 * sub
    for i, s in enumerate(sets):
        cut = slice(i * width, (i + 1) * width)
        raw = cells.count[cut].astype("<i4").tobytes() + cells.key[cut].astype("<u8").tobytes() + cells.check[cut].astype("<u8").tobytes()
        out.append(f"{len(s)}:{base64.b64encode(raw).decode()}")
    return out


def decode(fingerprint: str) -> tuple[int, Cells]:
    n, _, body = fingerprint.partition(":")
    raw = base64.b64decode(body)
    width = len(raw) // 20
    cells = Cells(1, width // 3)
    cells.count = np.frombuffer(raw, "<i4", width).astype(np.int32)
    cells.key = np.frombuffer(raw, "<u8", width, 4 * width).astype(U64)
    cells.check = np.frombuffer(raw, "<u8", width, 12 * width).astype(U64)
    return int(n), cells


def difference(a: str, b: str) -> tuple[list[int], list[int]] | None:
    """Digests only in ``a`` and only in ``b``, from two stored fingerprints alone; None if they differ by too much."""
    (_, x), (_, y) = decode(a), decode(b)
    x.count = x.count - y.count
    x.key ^= y.key
    x.check ^= y.check
    _, key, sign, done = x.peel()
    return (sorted(key[sign > 0].tolist()), sorted(key[sign < 0].tolist())) if done[0] else None


def compare(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, list[list[int]], list[list[int]], np.ndarray]:
    """For each pair of digest sets: likeness, digests only in the first, only in the second, and the cells it took.

    Every pair starts at the base size, or at what the difference of the set sizes needs at least, and doubles.
    """
    n = len(a)
    na, nb = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    only_a: list[list[int]] = [[] for _ in range(n)]
    only_b: list[list[int]] = [[] for _ in range(n)]
    taken = np.zeros(n, dtype=np.int64)
    sub = np.full(n, BASE_CELLS, dtype=np.int64)
    while len(small := np.flatnonzero(3 * sub < 1.3 * np.abs(na - nb))):
        sub[small] *= 2
    todo = np.arange(n)
    while len(todo):
        size = int(sub[todo].min())
        now = todo[sub[todo] == size][: max(1, CELLS // (3 * size))]
        cells = Cells(len(now), size)
        cells.add(*flat([a[i] for i in now]), 1)
        cells.add(*flat([b[i] for i in now]), -1)
        owner, key, sign, done = cells.peel()
        good = done[owner] if len(owner) else np.zeros(0, bool)
        for o, k, s in zip(now[owner[good]].tolist(), key[good].tolist(), sign[good].tolist(), strict=True):
            (only_a if s > 0 else only_b)[o].append(k)
        taken[now[done]] = 3 * size
        sub[now[~done]] *= 2
        todo = todo[taken[todo] == 0]
    differ = np.array([len(x) + len(y) for x, y in zip(only_a, only_b, strict=True)], dtype=np.float64)
    union = (na + nb + differ) / 2
    likeness = np.where(union > 0, (na + nb - differ) / 2 / np.maximum(union, 1), 1.0)
    return likeness, only_a, only_b, taken


def edited(text: str, follower: str) -> str:
    """``text`` whose last half is replaced by as much of the start of ``follower``."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, n_paragraphs long, edited_only long, next_only long, cells long"
)


def _block(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """``rows``: consecutive documents; the last one only serves as follower of the one before it."""
    own = [digests(t) for _, t in rows]
    texts = [edited(t, rows[i + 1][1]) for i, (_, t) in enumerate(rows[:-1])]
    changed = [digests(t) for t in texts]
    prints = encode([*own[:-1], *changed])
    n = len(texts)
    near_edited, _, edited_only, cells = compare(own[:-1], changed)
    near_next, _, next_only, more = compare(own[:-1], own[1:])
    columns = [
        pa.array([i for i, _ in rows[:-1]], pa.int64()), pa.array([len(t) for _, t in rows[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string()), pa.array(prints[:n], pa.string()), pa.array(prints[n:], pa.string()),
        pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64()), pa.array([len(x) for x in own[:-1]], pa.int64()),
        pa.array([len(x) for x in edited_only], pa.int64()), pa.array([len(x) for x in next_only], pa.int64()), pa.array(np.maximum(cells, more), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (range, borrowed, id, text); a range's own rows are followed by the head of the next range."""
    held: list[tuple[int | None, str]] = []
    at, closed = None, False
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        for r, borrowed, i, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if r != at:
                at, held, closed = r, [], False
            if closed:
                continue
            held.append((i, t))
            closed = bool(borrowed)
            if len(held) > 1 and (closed or len(held) > ROWS):
                yield _block(held)
                held = held[-1:]


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint every document and its edited text, which borrows from the next document by id.

    One shuffle of the texts: rows are dealt into id ranges whose split points are ids that exist (approximate
    quantiles), sorted there and streamed. The row at a split point also goes to the range before it, so each
    range ends with the first row of the next and no row waits for another task.
    """
    spark = docs.sparkSession
    n = ranges or 4 * parallelism(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("id_key"))
    cuts, least = rows.agg(F.percentile_approx("id_key", [i / n for i in range(1, n)], max(10_000, 20 * n)), F.min("id_key")).first()
    heads = np.array(sorted({least, *(cuts or [])} - {None}), dtype=np.int64)

    @F.pandas_udf("array<int>")
    def ranges_of(keys):
        import pandas as pd

        own = np.searchsorted(heads, keys.to_numpy(), side="right") - 1
        head = heads[np.maximum(own, 0)] == keys.to_numpy()
        return pd.Series([[o, (o - 1) % len(heads)] if h else [o] for o, h in zip(own.tolist(), head.tolist(), strict=True)])

    return (
        rows.select("*", F.posexplode(ranges_of("id_key")).alias("borrowed", "id_range"))
        .repartition(parallelism(spark), "id_range")
        .sortWithinPartitions("id_range", "borrowed", "id_key", "text")
        .select("id_range", "borrowed", "doc_id", "text")
        .mapInArrow(_walk, SCHEMA)
    )
