"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 16 bytes has its five top bits clear, so chunks average 32 bytes and
their ends depend on nearby bytes only: an insertion shifts later chunks but does not change them. Chunks are
deduplicated by digest; of equal chunks the one first by (doc_id, place) is the owner and stays. A run of repeated
chunks is removed when the whole words inside it number ``MIN_WORDS`` or more.

A passage may hold few chunk ends, or none. So each text also has anchors: of every ``SHARED - MIN_WORDS + 1`` runs of
``MIN_WORDS`` words that follow one another, the one of least hash (winnowing). A passage of ``SHARED`` words or more
has the same anchors wherever it stands, so all its copies meet; an anchor that repeats and lies outside the runs of
chunks is removed as well.

Documents are dealt into groups by a hash of the id. A group asks once for each distinct digest it has, the digests
meet by block, and a block answers only the groups that hold a digest of which there are several; the answers meet
the texts of the group again. A passage shared by a third of all documents costs a block one entry per group.

Defined results: null and empty texts have no chunks; a null doc_id comes first; rows of one doc_id are ordered by
text, so the later of two equal rows loses its repeated runs; spans count code points; extra columns are kept in
``remove_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import U64, mix, parallelism, small_batches, starts_of

#: Words that a run must hold to be removed.
MIN_WORDS = 20
#: A shared passage of so many whole words or more is always found.
SHARED = 51
#: Documents of a group, on average; bytes of a chunk, on average; chunks of a block, about.
GROUP, MEAN, BLOCK = 512, 32, 2_000_000
#: The gear table: 16 random bits for each byte, from a fixed rule.
GEAR = (mix(np.arange(1, 257, dtype=U64)) & U64(0xFFFF)).astype(np.uint16)
TOP = np.uint16(11)
#: For the hashes of runs of words: a value for each byte, an odd multiplier and its inverse modulo 2**64.
VALUE, STEP = mix(np.arange(257, 513, dtype=U64)), 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
WORD_START, WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]+")


def boundaries(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text, the last at its length."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    h = GEAR[np.frombuffer(text, dtype=np.uint8)]
    for k in (1, 2, 4, 8):  # the sum over 16 bytes of gear << distance, by doubling
        if n > k:
            h = np.concatenate([h[:k], h[k:] + (h[:-k] << np.uint16(k))])
    ends = np.flatnonzero((h >> TOP) == 0) + 1
    return ends if len(ends) and ends[-1] == n else np.append(ends, n)


def chunk_digests(text: bytes, ends: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    at = [0, *ends.tolist()]
    return np.fromiter((digest(text[i:j]) for i, j in zip(at, at[1:], strict=False)), dtype=U64, count=len(ends))


def runs(text: bytes, ends: np.ndarray, repeated: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, index of the first chunk) in bytes of what is removed: whole words inside runs of repeated chunks."""
    out = []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    for a, b in edge.reshape(-1, 2).tolist():
        i, j = (int(ends[a - 1]) if a else 0), int(ends[b - 1])
        if i and not WORD_START.match(text, i - 1) and not WORD_START.match(text, i):  # begin after the word that is cut
            m = WORD_START.search(text, i, j)
            i = m.start() if m else j
        if j < len(text) and not WORD_START.match(text, j) and not WORD_START.match(text, j - 1):  # end before it
            while j > i and not WORD_START.match(text, j - 1):
                j -= 1
        if 0 < i < j < len(text) and not WORD_START.match(text, i - 1) and not WORD_START.match(text, j):
            j -= 1  # the blank between the words on both sides stays
        if j > i and len(WORD.findall(text, i, j)) >= min_words:
            out.append((i, j, a))
    return out


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def anchors(text: bytes, width: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed runs of ``width`` words: number of the first word, start and end in bytes."""
    codes = np.frombuffer(text, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[codes], [True]])))
    starts, ends = edge[::2], edge[1::2]
    n, window = len(starts) - width + 1, max(1, SHARED - width + 1)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    starts, ends = starts[:n], ends[width - 1 :]
    total = np.zeros(len(text) + 1, dtype=U64)
    np.cumsum(VALUE[codes] * _powers(STEP, len(text)), out=total[1:])
    hashed = mix((total[ends] - total[starts]) * _powers(BACK, len(text))[starts])
    first = np.unique(np.lib.stride_tricks.sliding_window_view(hashed, window).argmin(axis=1) + np.arange(n - window + 1))
    return first, starts[first], ends[first]


def others(text: bytes, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, owner) of repeated anchors that touch none of the runs found, those that overlap as one."""
    out: list[tuple[int, int, int]] = []
    taken = iter([*((a, b) for a, b, _ in found), (len(text) + 1, len(text) + 1)])
    a, b = next(taken)
    for i, j, owner in zip(starts.tolist(), ends.tolist(), owners.tolist(), strict=True):
        i -= 0 < i and j < len(text)  # one blank stays between the words on both sides
        while b <= i:
            a, b = next(taken)
        if a < j:
            continue
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], j, out[-1][2])
        else:
            out.append((i, j, owner))
    return out


def _ordered(table: pa.Table) -> list[tuple[int, int | None, bytes, int]]:
    """A group's rows by (id, text): id key, id, text, row."""
    ids, texts, rows = (table.column(k).to_pylist() for k in ("doc_id", "text", "row"))
    out = [(-(2**63) if i is None else i, i, (t or "").encode("utf-8", "surrogatepass"), r) for i, t, r in zip(ids, texts, rows, strict=True)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _chunked(rows: list[tuple]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Ends per row; digests, ids and places of all chunks. Places run on over rows of one id."""
    ends = [boundaries(r[2]) for r in rows]
    digests = [chunk_digests(r[2], e) for r, e in zip(rows, ends, strict=True)]
    sizes = np.array([len(e) for e in ends], dtype=np.int64)
    place, last, at = [], None, 0
    for r, n in zip(rows, sizes.tolist(), strict=True):
        at = at if r[0] == last else 0
        place.append(np.arange(at, at + n))
        last, at = r[0], at + n
    ids = np.repeat(np.array([r[0] for r in rows], dtype=np.int64), sizes)
    return ends, np.concatenate([*digests, np.zeros(0, U64)]), ids, np.concatenate([*place, np.zeros(0, np.int64)])


def _anchored(rows: list[tuple], width: int) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Anchors per row; digests, ids and places (in words) of all anchors. Places run on over rows of one id."""
    digest = xxhash.xxh3_64_intdigest
    found, d, place, last, at = [], [], [], None, 0
    for r in rows:
        at = at if r[0] == last else 0
        first, starts, ends = anchors(r[2], width)
        found.append((starts, ends))
        d.append(np.fromiter((digest(r[2][i:j], 1) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=U64, count=len(first)))
        place.append(first + at)
        last, at = r[0], at + len(r[2])  # a text has no more words than bytes
    ids = np.repeat(np.array([r[0] for r in rows], dtype=np.int64), [len(x) for x in d])
    return found, np.concatenate([*d, np.zeros(0, U64)]), ids, np.concatenate([*place, np.zeros(0, np.int64)])


def _firsts(d: np.ndarray, ids: np.ndarray, place: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each distinct digest: digest, id and place of the first chunk, sum of ``extra``."""
    order = np.lexsort((place, ids, d))
    d, ids, place, extra = d[order], ids[order], place[order], extra[order]
    at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    return d[at], ids[at], place[at], np.add.reduceat(extra, at) if len(at) else extra


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 21
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<u4", n, 16 * n), np.frombuffer(raw, "u1", n, 20 * n)


def _entries(d: np.ndarray, ids: np.ndarray, place: np.ndarray, many: np.ndarray) -> bytes:
    return d.astype("<u8").tobytes() + ids.astype("<i8").tobytes() + place.astype("<u4").tobytes() + many.astype("u1").tobytes()


def _ask(blocks: int, min_words: int):
    def run(key, table):  # Spark tells grouped functions apart by their hints
        """A group's distinct digests with their first chunks and whether there are several, by block."""
        rows = _ordered(table)
        d, ids, place = (np.concatenate(x) for x in zip(_chunked(rows)[1:], _anchored(rows, min_words)[1:], strict=True))
        d, ids, place, many = _firsts(d, ids, place, np.ones(len(d), dtype=np.int64))
        block = (d % U64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        d, ids, place, many, block = d[order], ids[order], place[order], many[order] > 1, block[order]
        there, at = np.unique(block, return_index=True)
        ends = np.append(at[1:], len(d))
        packed = [_entries(d[i:j], ids[i:j], place[i:j], many[i:j]) for i, j in zip(at, ends, strict=True)]
        return pa.table({"block": pa.array(there, pa.int64()), "asker": pa.array([key[0].as_py()] * len(there), pa.int64()), "entries": pa.array(packed, pa.binary())})

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block: for each asker the digests of which there are several anywhere, with their owners."""
    schema = pa.schema([("doc_group", pa.int64()), ("entries", pa.binary())])
    at: int | None = None
    held: list[tuple[int, bytes]] = []

    def out() -> pa.RecordBatch:
        parts = [_unpack(x) for _, x in held]
        d, ids, place, many = (np.concatenate([p[k] for p in parts]) for k in range(4))
        asker = np.repeat(np.arange(len(held)), [len(p[0]) for p in parts])
        first, owner, where, total = _firsts(d, ids, place.astype(np.int64), many.astype(np.int64) + 1)
        slot = np.searchsorted(first, d)
        again = total[slot] > 1
        groups, entries = [], []
        bounds = np.searchsorted(asker, np.arange(len(held) + 1))
        for k, (group, _) in enumerate(held):
            s = slot[bounds[k] : bounds[k + 1]][again[bounds[k] : bounds[k + 1]]]
            if len(s):
                groups.append(group)
                entries.append(_entries(first[s], owner[s], where[s], np.ones(len(s))))
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(entries, pa.binary())], schema=schema)

    for batch in batches:
        for block, asker, entries in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if block != at and held:
                yield out()
                held = []
            at = block
            held.append((asker, entries))
    if held:
        yield out()


def _marked(texts: pa.Table, answers: pa.Table, min_words: int) -> Iterator[tuple[tuple, list[tuple[int, int, int]]]]:
    """Each row of a group with the runs that go, and the owner of each run's first chunk."""
    rows = _ordered(texts)
    ends, d, ids, place = _chunked(rows)
    parts = [_unpack(x) for x in answers.column("entries").to_pylist()]
    known, owner, where = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in ((0, U64), (1, np.int64), (2, np.int64)))
    order = np.argsort(known)
    known, owner, where = known[order], owner[order], where[order].astype(np.int64)

    def again(d: np.ndarray, ids: np.ndarray, place: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
        """Which stand ``apart`` or more behind the first of their kind, and its owner."""
        if not len(known):
            return np.zeros(len(d), dtype=bool), np.zeros(len(d), np.int64)
        slot = np.minimum(np.searchsorted(known, d), len(known) - 1)
        return (known[slot] == d) & ((owner[slot] != ids) | (place - where[slot] >= apart)), owner[slot]

    repeated, keeper = again(d, ids, place, 1)
    spans, d, ids, place = _anchored(rows, min_words)
    more, keepers = again(d, ids, place, min_words)
    at, start = (starts_of(np.array([len(x) for x in y], dtype=np.int64)).tolist() for y in (ends, [x for x, _ in spans]))
    for k, (r, e) in enumerate(zip(rows, ends, strict=True)):
        (i, j), (p, q) = at[k : k + 2], start[k : k + 2]
        found = [(a, b, int(keeper[i + c])) for a, b, c in runs(r[2], e, repeated[i:j], min_words)] if repeated[i:j].any() else []
        if more[p:q].any():
            keep = more[p:q]
            found = sorted(found + others(r[2], spans[k][0][keep], spans[k][1][keep], keepers[p:q][keep], found))
        yield r, found


def _grouped(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """The documents by group, and how many blocks their digests need."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups, blocks = max(1, -(-size["rows"] // GROUP)), max(4 * parallelism(docs.sparkSession), -(-(size["bytes"] or 0) // (MEAN * BLOCK)))
    group = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(groups)).alias("doc_group")
    rows = docs.select(group, F.col("doc_id").cast("long").alias("doc_id"), "text", *columns)
    return rows.repartition(max(parallelism(docs.sparkSession), 1), "doc_group"), blocks


def _answers(rows: DataFrame, blocks: int, min_words: int) -> DataFrame:
    n = parallelism(rows.sparkSession)
    asked = rows.select("doc_group", "doc_id", "text", F.lit(0).alias("row")).groupBy("doc_group").applyInArrow(_ask(blocks, min_words), "block long, asker long, entries binary")
    return asked.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_answer, "doc_group long, entries binary")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed run: doc_id, start, length (code points), n_words, first_doc_id (who keeps it), passage."""
    rows, blocks = _grouped(docs, [])

    def run(key, texts, answers):
        out = []
        for (_, doc_id, text, _), found in _marked(texts, answers, min_words):
            for a, b, owner in found:
                piece = text[a:b].decode("utf-8", "replace")
                out.append((doc_id, len(text[:a].decode("utf-8", "replace")), len(piece), len(WORD.findall(text, a, b)), owner if owner != -(2**63) else None, piece))
        names = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("n_words", pa.int64()), ("first_doc_id", pa.int64()), ("passage", pa.string())]
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(names)})

    texts = rows.select("doc_group", "doc_id", "text", F.lit(0).alias("row")).groupBy("doc_group")
    return texts.cogroup(_answers(rows, blocks, min_words).groupBy("doc_group")).applyInArrow(run, "doc_id long, start long, length long, n_words long, first_doc_id long, passage string")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without their repeated runs, with all columns; n_chars, where there is one, is counted again."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f.name) for f in others]) if others else F.struct(F.lit(0).alias("none"))
    rows, blocks = _grouped(docs.select("doc_id", "text", rest.alias("lattica_rest")), ["lattica_rest"])
    asked = rows.select("doc_group", "doc_id", "text")
    kind = rows.schema["lattica_rest"].dataType.simpleString()

    def run(key, texts, answers):
        numbered = texts.append_column("row", pa.array(range(texts.num_rows), pa.int64()))
        order, kept = [], []
        for (_, _, text, row), found in _marked(numbered, answers, min_words):
            at, parts = 0, []
            for a, b, _ in found:
                parts.append(text[at:a])
                at = b
            order.append(row)
            kept.append(b"".join([*parts, text[at:]]).decode("utf-8", "surrogatepass") if found else None)
        out = texts.take(pa.array(order, pa.int64()))
        old = out.column("text").to_pylist()
        return pa.table({"doc_id": out.column("doc_id"), "text": pa.array([o if k is None else k for o, k in zip(old, kept, strict=True)], pa.string()), "lattica_rest": out.column("lattica_rest")})

    texts = rows.select("doc_group", "doc_id", "text", "lattica_rest").groupBy("doc_group")
    out = texts.cogroup(_answers(asked, blocks, min_words).groupBy("doc_group")).applyInArrow(run, f"doc_id long, text string, lattica_rest {kind}")
    columns = {f.name: F.col("lattica_rest").getField(f.name) for f in others} | {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.select([columns[c].alias(c) for c in docs.columns])
