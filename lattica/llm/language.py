"""Language identification by nearest centroid: TF-IDF n-gram vectors, several clustered centroids per language.

A text's vector holds the square roots of its counts of 1- to 3-grams of bytes (letters lowered, other ASCII as
space), hashed, weighted by inverse document frequency and normalised. The training vectors of each language are
clustered by spherical k-means; a text gets the language of the centroid with the largest cosine. It is rejected
when that cosine is below what nearly all training texts of the centroid reach, less a margin.

Training sample: at most ``PER_LANGUAGE`` texts of each language outside the held-out fold, and ``MAX_TEXTS`` in all,
chosen by a hash of the id, whatever their length. Executors count their n-grams; only the counts reach the driver.
Scoring takes whole texts.

Defined results: null texts and texts without a letter are `und` with score 0 and count as rejected; a text of any
length is counted whole; without training texts everything is `und`; of several texts of one id the first by language
and text is learned; on ties the first centroid wins (languages in order); repeated rows and rows without id stay,
each with its result; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import U64, bounded_broadcast, crc_fold, give_back, mix, stage, texts_of, unstage

FOLDS, HELD = 3, 1
PER_LANGUAGE, MAX_TEXTS, CENTROIDS = 400, 6000, 4
#: Bytes that are counted at once.
AT_ONCE = 1_000_000
SIZES, DIMS, ROWS = (1, 2, 3), 4096, 256
UND = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes: ASCII letters lowered, other ASCII to space, the rest (parts of longer code points) kept.
TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MULTIPLY = (mix(np.arange(201, 201 + max(SIZES), dtype=U64)) | U64(1)).astype(np.uint32) | np.uint32(1)


def _add(out: np.ndarray, raw: np.ndarray, owner: np.ndarray, limit: int) -> None:
    """Adds the hashed n-grams that begin before ``limit`` and lie in one text to the rows of ``out``."""
    wide, blank = raw.astype(np.uint32), raw == 32
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = min(limit, len(raw) - n + 1)
            if m <= 0:
                continue
            total = np.full(m, n * 7919, dtype=np.uint32)
            keep = ~blank[:m]
            for k in range(n):
                total += wide[k : k + m] * _MULTIPLY[k]
                keep = keep | ~blank[k : k + m]
            total ^= total >> np.uint32(15)
            total *= np.uint32(0x2C1B3C6D)
            total ^= total >> np.uint32(12)
            keep &= owner[:m] == owner[n - 1 : n - 1 + m]
            cell = owner[:m] * DIMS + (total & np.uint32(DIMS - 1)).astype(np.int64)
            out += np.bincount(cell[keep], minlength=out.size).reshape(out.shape)


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed n-gram counts, a row for each text; n-grams of blanks only do not count. A long text is taken in parts."""
    marked = [b" " + t.translate(TABLE) + b" " for t in texts]
    out = np.zeros((len(texts), DIMS), dtype=np.int64)
    over = max(SIZES) - 1
    i = 0
    while i < len(marked):
        j, size = i + 1, len(marked[i])
        while j < len(marked) and size + len(marked[j]) <= AT_ONCE:
            size += len(marked[j])
            j += 1
        if size <= AT_ONCE:
            _add(out[i:j], np.frombuffer(b"".join(marked[i:j]), dtype=np.uint8), np.repeat(np.arange(j - i), [len(t) for t in marked[i:j]]), size)
        else:
            for at in range(0, size, AT_ONCE):
                raw = np.frombuffer(marked[i][at : at + AT_ONCE + over], dtype=np.uint8)
                _add(out[i:j], raw, np.zeros(len(raw), np.int64), AT_ONCE)
        i = j
    return out


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(found.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; at most ``k`` centroids."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    c = x[seeds]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    #: The least cosine that is not rejected, of each centroid.
    least: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Nearest language, cosine, and whether the text is too far from it."""
        there = np.array([LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], dtype=bool)
        if not len(self.centroids):
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        cosine = vectors(counts(texts), self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(np.float64)
        return [self.languages[b] if t else UND for b, t in zip(best.tolist(), there.tolist(), strict=True)], np.where(there, np.round(score, 6), 0.0), ~there | (score < self.least[best])


def fit(texts: list[bytes], languages: list[str], k: int = CENTROIDS) -> Centroids:
    return fit_counts(np.concatenate([np.zeros((0, DIMS), np.int64), *(counts(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS))]), languages, k)


def fit_counts(found: np.ndarray, languages: list[str], k: int = CENTROIDS) -> Centroids:
    """Centroids from the n-gram counts of the training texts."""
    if not len(found):
        return Centroids([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0))
    idf = (np.log((1 + len(found)) / (1 + (found > 0).sum(axis=0))) + 1).astype(np.float32)
    x, names, parts, least = vectors(found, idf), [], [], []
    for language in sorted(set(languages)):
        own = x[[i for i, y in enumerate(languages) if y == language]]
        c = cluster(own, k)
        c = c[np.unique((own @ c.T).argmax(axis=1))]  # a centroid that no text is nearest to says nothing of a distance
        near = own @ c.T
        reach, first = near.max(axis=1), near.argmax(axis=1)
        least += [float(np.quantile(reach[first == i], 0.01)) * 0.5 if (first == i).any() else float(reach.min()) * 0.5 for i in range(len(c))]
        names += [language] * len(c)
        parts.append(c)
    return Centroids(names, idf, np.concatenate(parts).astype(np.float32), np.array(least))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            found = np.minimum(counts(texts_of(part.column(2))), 2**31 - 1).astype("<i4")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "lang", "counts"])
    give_back()


def pick(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id of the first ids of each language by hash.

    The ids that take part in the ranking are cut by a hash bound that leaves some more than are wanted of each
    language, so no task ranks a whole language; a bound that leaves too few, as ids may repeat, is widened.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD))
    rows = stage(rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")), "languages")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    most = max(1, min(per_language, MAX_TEXTS // max(1, len(sizes))))
    share = {lang: min(1.0, (most + 8 * most**0.5 + 20) / n) for lang, n in sizes.items()}
    while True:
        bounds = rows.sparkSession.createDataFrame([(lang, min(2**63 - 1, int(-(2**63) + s * 2**64))) for lang, s in share.items()], "lang string, most long")
        near = rows.join(bounded_broadcast(bounds, len(share)), "lang").where(F.col("h") <= F.col("most")).select("lang", "doc_id", "h").distinct()
        there = {r["lang"]: r["n"] for r in near.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        few = [lang for lang, s in share.items() if s < 1 and there.get(lang, 0) < most]
        if not few:
            break
        share |= {lang: min(1.0, share[lang] * 8) for lang in few}
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    out = stage(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("doc_id").distinct(), "picked")
    unstage(rows)
    return out


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Centroids:
    picked = pick(docs, per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # at most PER_LANGUAGE ids a language and MAX_TEXTS in all, or one a language
    chosen = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("t"))
    got = chosen.select("doc_id", "t.lang", "t.text").mapInArrow(_counted, "doc_id long, lang string, counts binary").toArrow().sort_by("doc_id")
    unstage(picked)
    found = np.frombuffer(b"".join(got.column("counts").to_pylist()), "<i4").reshape(got.num_rows, DIMS)
    return fit_counts(found, got.column("lang").to_pylist())


def identify(docs: DataFrame, reject: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; with ``reject`` the language of a rejected text is `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                names, score, far = model.predict(texts_of(part.column(1)))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "lang_pred": pa.array([UND if reject and f else x for x, f in zip(names, far.tolist(), strict=True)], pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(far, pa.bool_())})
        give_back()

    held = crc_fold(F.col("doc_id"), FOLDS) == HELD
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
