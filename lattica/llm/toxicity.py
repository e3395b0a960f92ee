"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams (3 to 6 bytes, word ends marked) of its distinct words, hashed. Each feature is
scaled by the log ratio of its smoothed shares among toxic and clean training texts; a logistic regression under an
L1 penalty is fitted on the scaled features. A word's weight is the sum of its n-grams' weights, so a text is
scored by adding up its distinct words, all of them.

Training sample: at most ``PER_CLASS`` labelled texts of each class outside the held-out fold, chosen by a hash of
the id, whatever their length. Executors take a text's distinct words and min-hashes; only these reach the driver.
Scoring has no limit.

Defined results: a null text counts as empty; an empty text has the intercept's score; a text of any length is
trained on and scored whole; without labels of both classes, or where no n-gram tells them apart, every score is the
smoothed share of label 1 (0.5 without labels); of repeated labels the largest counts, and a label above 0 is toxic;
of several texts of one labelled id the first in order is learned; repeated rows and rows without id stay, each with
its score; equal texts have equal scores; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import U64, crc_fold, give_back, mix, starts_of, sums_by, texts_of
from lattica.llm.ngram_join import shingle_sets

FOLDS, HELD = 5, 0
PER_CLASS = 3000
SIZES, SIEVE, SMOOTH = (3, 4, 5, 6), 22, 0.5
#: Least G statistic of a feature, and the weight of the L1 penalty.
LEAST_G, PENALTY = 10.8, 0.0005
KEPT_WORDS, ROWS = 200_000, 256
#: ASCII bytes that are no letters or digits separate words; letters are lowered; other bytes stay.
TABLE = bytes(c if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MULTIPLY = mix(np.arange(101, 101 + max(SIZES), dtype=U64)) | U64(1)


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(TABLE).split())


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words with marked ends, word by word, and how many each word has."""
    marked = [b"^" + w + b"$" for w in words]
    sizes = np.array([len(w) for w in marked], dtype=np.int64)
    raw = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(U64)
    ends = np.repeat(starts_of(sizes)[1:], sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    parts, owners = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(raw) < n:
                continue
            at = np.flatnonzero(np.arange(len(raw)) + n <= ends)
            total = np.full(len(at), n, dtype=U64)
            for k in range(n):
                total += (raw[at + k] + U64(1)) * _MULTIPLY[k]
            parts.append(mix(total))
            owners.append(owner[at])
    if not parts:
        return np.zeros(0, U64), np.zeros(len(words), np.int64)
    flat, own = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return flat[order], np.bincount(own, minlength=len(words))


@dataclass
class NgramModel:
    intercept: float
    #: Sorted hashes of the chosen n-grams, and of each the learned weight times the log-count ratio.
    keys: np.ndarray
    weights: np.ndarray

    def word_scores(self, words: list[bytes]) -> list[float]:
        if not words:
            return []
        flat, counts = grams(words)
        if not len(self.keys):
            return [0.0] * len(words)
        at = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
        return sums_by(np.where(self.keys[at] == flat, self.weights[at], 0.0), counts).tolist()

    def margins(self, texts: list[bytes], known: dict[bytes, float]) -> list[float]:
        sets = [words_of(t) for t in texts]
        new = list({w for s in sets for w in s if w not in known})
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = list(set().union(*sets))
        known.update(zip(new, self.word_scores(new), strict=True))
        return [self.intercept + sum(map(known.__getitem__, s)) for s in sets]


def _soft_logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: float, rounds: int = 250) -> tuple[np.ndarray, float]:
    """L1 logistic regression on a sparse matrix whose entry (row, col) is scale[col]."""
    n, m = len(y), len(scale)
    values = scale[cols]
    times = lambda w: np.bincount(rows, weights=values * w[cols], minlength=n).astype(np.float64)
    back = lambda e: np.bincount(cols, weights=values * e[rows], minlength=m).astype(np.float64)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    u, c, t, v = w.copy(), b, 1.0, np.ones(m) / np.sqrt(max(m, 1))
    for _ in range(15):
        v = back(times(v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(times(v)) ** 2 / n + 1) + 1e-9)
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-np.clip(times(u) + c, -30, 30))) - y) / n
        w1 = u - step * back(e)
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * weight, 0)
        b1 = c - step * e.sum()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


#: A training text: its distinct words, its min-hashes, its label.
Sample = tuple[list[bytes], tuple[int, ...], int]


def samples(texts: list[bytes], labels: list[int]) -> list[Sample]:
    """The min-hashes are three of the 5-word shingles, none where a text has no words."""
    out = []
    for t, y, shingles in zip(texts, labels, shingle_sets(texts), strict=True):
        with np.errstate(over="ignore"):
            keys = tuple(int((shingles * (_MULTIPLY[k] | U64(1))).min().view(np.int64)) for k in range(3)) if len(shingles) else ()
        out.append((sorted(words_of(t)), keys, y))
    return out


def without_copies(found: list[Sample]) -> list[Sample]:
    """Texts of which no two of a class share one of three min-hashes, taken in order.

    Copies and near copies would count their chance n-grams again and again.
    """
    seen: set[tuple[int, int, int]] = set()
    out = []
    for words, hashes, y in found:
        keys = {(y, k, h) for k, h in enumerate(hashes)}
        if not keys & seen:
            out.append((words, hashes, y))
            seen |= keys
    return out


def _telling(seen: np.ndarray, n0: float, n1: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratios from the numbers of (clean, toxic) texts that have a feature, and which pass the G test."""
    p, q = (seen[1] + SMOOTH) / (n1 + 2 * SMOOTH), (seen[0] + SMOOTH) / (n0 + 2 * SMOOTH)
    ratio = np.log(p / q)
    both = (seen[0] + seen[1] + 2 * SMOOTH) / (n0 + n1 + 4 * SMOOTH)
    g = 2 * (seen[1] * np.log(p / both) + seen[0] * np.log(q / both) + (n1 - seen[1]) * np.log((1 - p) / (1 - both)) + (n0 - seen[0]) * np.log((1 - q) / (1 - both)))
    return ratio, (g > LEAST_G) & (seen.sum(axis=0) >= 3)


def fit(texts: list[bytes], labels: list[int]) -> NgramModel:
    return fit_samples(samples(texts, labels))


def fit_samples(found: list[Sample]) -> NgramModel:
    """Count, select features whose counts differ between the classes (G test), scale, and fit.

    The n-grams are counted twice: by bucket of a sieve, so that few are left, and those by their whole hash.
    """
    found = without_copies(found)
    y = np.array([label for _, _, label in found], dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    plain = NgramModel(float(np.log(share / (1 - share))), np.zeros(0, U64), np.zeros(0))
    if not len(y) or y.min() == y.max():
        return plain
    n1, n0 = y.sum(), len(y) - y.sum()
    bucket = lambda h: (h >> U64(64 - SIEVE)).astype(np.int64)
    seen = np.zeros((2, 1 << SIEVE), dtype=np.float32)
    for words, _, label in found:
        seen[label, np.unique(bucket(grams(words)[0]))] += 1
    # a bucket holds a telling n-gram among others, so it needs a part of its G only
    some = (seen[1] >= 2) | (seen[0] >= 8)
    passing = np.zeros(1 << SIEVE, dtype=bool)
    passing[some] = _telling(seen[:, some].astype(np.float64), n0, n1)[1]
    kept = []
    for words, _, _ in found:
        h = grams(words)[0]
        kept.append(np.unique(h[passing[bucket(h)]]))
    rows = np.repeat(np.arange(len(found)), [len(h) for h in kept])
    keys, cols = np.unique(np.concatenate(kept), return_inverse=True)
    seen = np.stack([np.bincount(cols, weights=(y[rows] == c).astype(np.float64), minlength=len(keys)) for c in (0, 1)])
    ratio, good = _telling(seen, n0, n1)
    if not good.any():
        return plain
    place = np.cumsum(good) - 1
    keep = good[cols]
    w, b = _soft_logistic(rows[keep], place[cols[keep]], ratio[good], y, PENALTY)
    used = w != 0
    return NgramModel(b, keys[good][used], (w * ratio[good])[used])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            found = samples(texts_of(part.column(1)), part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([b" ".join(words) for words, _, _ in found], pa.binary()), pa.array([list(keys) for _, keys, _ in found], pa.list_(pa.int64())), part.column(2)],
                names=["doc_id", "words", "keys", "label"],
            )
    give_back()


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> NgramModel:
    """Fit on the driver, on the distinct words of a bounded sample of labelled texts."""
    given = labels.where(F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD))
    given = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    by = [F.xxhash64("doc_id"), "doc_id"]
    picked = given.where("label = 1").orderBy(*by).limit(per_class).unionByName(given.where("label = 0").orderBy(*by).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    got = chosen.mapInArrow(_sampled, "doc_id long, words binary, keys array<long>, label int").toArrow().sort_by("doc_id")
    return fit_samples([(words.split(), tuple(keys), y) for words, keys, y in zip(*(got.column(c).to_pylist() for c in ("words", "keys", "label")), strict=True)])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                margin = np.clip(np.array(model.margins(texts_of(part.column(1)), known)), -30, 30)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(1 / (1 + np.exp(-margin)))})
        known.clear()
        give_back()

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held = crc_fold(F.col("doc_id"), FOLDS) == HELD
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
