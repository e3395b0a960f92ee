"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

A token's probability is that of its leaf, given the two tokens to the left and the two to the right. A word that
makes up ``1 / OWN_SHARE`` of the corpus or more is a leaf of its own; the others are dealt into ``RARE`` leaves by
hash, and such a word's probability is that of its leaf times the word's share of the leaf, by whole-corpus counts.
The softmax over leaves has two levels: over classes of leaves of similar rank, then over the leaves of the class.

The network (embeddings, a weight a place and unit, tanh, two softmax levels) is trained in numpy over every text of
the corpus: each partition goes over all its texts from common weights, masking one token in ``MASKED`` and
predicting it from both sides; the weights are averaged by tokens in a tree of bounded groups, ``ROUNDS`` times, each
with other tokens masked. The first weights give each leaf its share of the corpus whatever stands around it.
A document's score is the sum of the log-probabilities of all its tokens.

Bounds: at most ``OWN_SHARE`` words can have that share, so the weights are bounded; counts of at most ``KNOWN_SHARE``
words are broadcast, and all other words meet their whole-corpus counts in a join. Neither depends on the size of the
corpus, and every word is scored by its own count.

Defined results: null, empty and blank texts have 0 tokens, sum and mean 0; a text of any length is trained on and
scored whole; repeated rows and rows of one or no doc_id stay, each with its own score; tokens outside the text are
one marker; words of equal count are ranked by hash; an empty table gives no rows; extra columns are ignored. The
training follows the partitions of the table, so another partitioning gives slightly other weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import U64, give_back, mix, stage, starts_of, sums_by, texts_of, unstage

#: The least share of all tokens, as 1 in so many, of a word with a leaf, and of one whose count is broadcast.
OWN_SHARE, KNOWN_SHARE = 1 << 16, 1 << 20
#: Leaves of the other words, units, places of the window.
RARE, UNITS, WINDOW = 256, 32, (-2, -1, 1, 2)
#: One token in so many is masked; rounds; masked tokens of a step; least steps of a partition; seed; learning rate.
MASKED, ROUNDS, STEP, LEAST_STEPS, SEED, RATE = 8, 1, 4096, 100, 7, 0.1
#: Distinct words counted before they are sent on, tokens scored at once, words kept, texts taken at once.
COUNTED, TOKENS, KEPT, ROWS = 300_000, 16_384, 200_000, 64
#: Rows of a matrix that stays near the processor.
NEAR = 2048
#: Bytes of a slice of the weights, and slices that are added up in one task.
SLICE, GROUP = 1 << 18, 16


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_hash(word: bytes) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()
    out = lambda: pa.RecordBatch.from_pydict({"word": pa.array(map(word_hash, found), pa.int64()), "n": pa.array(found.values(), pa.int64())})
    for batch in batches:
        for t in texts_of(batch.column(0)):
            found.update(tokens(t))
            if len(found) > COUNTED:
                yield out()
                found.clear()
    if found:
        yield out()
    found.clear()
    give_back()


@dataclass
class Vocabulary:
    """The leaves by rank (words with their counts, then rare leaves), and the known counts of other words."""

    hashes: np.ndarray
    counts: np.ndarray
    rare_counts: np.ndarray
    rare_words: np.ndarray
    #: Sorted hashes of words without a leaf whose counts are broadcast, and these.
    known: np.ndarray
    known_counts: np.ndarray

    def __post_init__(self) -> None:
        self.own = len(self.hashes)
        self.leaves = self.own + RARE
        self.mark = self.leaves
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.log_mass = np.log(np.maximum(self.rare_counts + self.rare_words, 1.0))

    def leaf_counts(self) -> np.ndarray:
        return np.concatenate([self.counts, self.rare_counts + self.rare_words]) + 0.5

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words by hash: the leaf, the log of the share of it, and whether log(count + 1) is still to be added."""
        leaf = self.own + hashes % RARE
        share = -self.log_mass[hashes % RARE]
        open_ = np.ones(len(hashes), dtype=bool)
        for keys, use in ((self.sorted, "leaf"), (self.known, "count")):
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[at] == hashes
            if use == "leaf":
                leaf[hit], share[hit] = self.order[at[hit]], 0.0
            else:
                share[hit] += np.log(self.known_counts[at[hit]] + 1)
            open_ &= ~hit
        return leaf.astype(np.int32), share, open_


class _Hashes(dict):
    """Words to their hashes, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = out = word_hash(word)
        return out


def prepare(texts: list[bytes], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, and the number of tokens of each text."""
    found = [tokens(t) for t in texts]
    sizes = np.array([len(x) for x in found], dtype=np.int64)
    return np.fromiter(map(hashes.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(sizes.sum())), sizes


def placed(words: Vocabulary, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``Vocabulary.place`` of many tokens, each distinct word once."""
    distinct, back = np.unique(found, return_inverse=True)
    return tuple(x[back] for x in words.place(distinct))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: the count of every word of the corpus, staged."""
    counts = docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stage(counts, "word-counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The driver gets the words of large share, and one row per rare leaf."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    got = counts.where(F.col("n") * KNOWN_SHARE >= total).toArrow()
    hashes, n = got.column("word").to_numpy().astype(np.int64), got.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((hashes, -n))
    hashes, n = hashes[order], n[order]
    own = n * OWN_SHARE >= total
    all_counts, all_words = np.zeros(RARE), np.zeros(RARE)
    for r in counts.groupBy(F.pmod("word", F.lit(RARE)).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        all_counts[r["b"]], all_words[r["b"]] = r["n"], r["words"]
    np.subtract.at(all_counts, hashes[own] % RARE, n[own])
    np.subtract.at(all_words, hashes[own] % RARE, 1)
    known, known_counts = hashes[~own], n[~own]
    order = np.argsort(known)
    return Vocabulary(hashes[own], n[own].astype(np.float64), all_counts, all_words, known[order], known_counts[order].astype(np.float64))


def contexts(ids: np.ndarray, sizes: np.ndarray, mark: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The leaves of the window of each token (of those ``wanted``), a column per place; the marker outside a text."""
    gap = max(abs(w) for w in WINDOW)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) + 1, sizes) * gap
    padded = np.full(len(ids) + (len(sizes) + 2) * gap, mark, dtype=np.int32)
    padded[place] = ids
    if wanted is not None:
        place = place[wanted]
    return np.stack([padded[place + w] for w in WINDOW], axis=1)


@dataclass
class Network:
    """embeddings: leaf or marker x unit; places: place x unit; classes: unit x class; inner: class x unit x leaf of the class."""

    embeddings: np.ndarray
    places: np.ndarray
    hidden: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = SEED) -> Network:
        """Each of the leaves has its share of ``counts`` whatever stands around it."""
        rng, n = np.random.default_rng(seed), len(counts)
        k = max(1, int(np.ceil(n**0.5)))
        width = -(-n // k)
        mass = np.zeros(k * width)
        mass[:n] = counts
        mass = mass.reshape(k, width)
        whole = mass.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            outer, inner = np.log(whole[:, 0] / whole.sum()), np.log(mass / np.maximum(whole, 1e-9))
        return cls(*(x.astype(np.float32) for x in (
            rng.normal(0, 0.3, (n + 1, UNITS)), 1 + rng.normal(0, 0.5, (len(WINDOW), UNITS)), np.zeros(UNITS),
            rng.normal(0, 0.1, (UNITS, k)), np.maximum(outer, -60), rng.normal(0, 0.1, (k, UNITS, width)), np.maximum(inner, -60),
        )))

    def params(self) -> list[np.ndarray]:
        return [self.embeddings, self.places, self.hidden, self.classes, self.class_bias, self.inner, self.inner_bias]

    def copy(self) -> Network:
        return Network(*(p.copy() for p in self.params()))

    def tables(self) -> list[np.ndarray]:
        """The embeddings as they stand at each place."""
        return [self.embeddings * p for p in self.places]

    def by_class(self, leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
        """An order by class, (class, start, end) in it, and the place of each leaf in its class, in that order."""
        own, slot = np.divmod(leaves, self.inner.shape[2])
        order = np.argsort(own.astype(np.int32), kind="stable")
        own = own[order]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        return order, list(zip(own[at].tolist(), at.tolist(), [*at[1:].tolist(), len(own)], strict=True)), slot[order]

    def log_probabilities(self, windows: np.ndarray, leaves: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        tables = self.tables() if tables is None else tables
        n, width = len(leaves), self.inner.shape[2]
        hidden, out = np.empty((n, UNITS), np.float32), np.empty(n, np.float32)
        for i in range(0, n, NEAR):
            w = windows[i : i + NEAR]
            h = tables[0][w[:, 0]] + self.hidden
            for p in range(1, len(WINDOW)):
                h += tables[p][w[:, p]]
            np.tanh(h, out=hidden[i : i + NEAR])
            out[i : i + NEAR] = _log_share(hidden[i : i + NEAR] @ self.classes + self.class_bias, leaves[i : i + NEAR] // width)
        order, parts, slot = self.by_class(leaves)
        hidden, inner = hidden[order], np.empty(n, np.float32)
        for c, i, j in parts:
            inner[i:j] = _log_share(hidden[i:j] @ self.inner[c] + self.inner_bias[c], slot[i:j])
        out[order] += inner
        return out


def _log_share(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row at one place."""
    at = z[np.arange(len(z)), own]
    with np.errstate(over="ignore"):
        total = np.exp(z) @ np.ones(z.shape[1], np.float32)
    if not np.isfinite(total).all():
        top = z.max(axis=1)
        return at - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
    return at - np.log(total)


def _errors(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The gradient of the cross entropy of each row, in place."""
    np.exp(np.minimum(z, 80, out=z), out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    z[np.arange(len(z)), own] -= 1
    return z


class Learner:
    """Adagrad on the cross entropy of masked tokens; embeddings and classes that a step does not meet stay as they are."""

    def __init__(self, net: Network):
        self.net, self.steps = net, 0
        self.squares = [np.full(len(net.embeddings), 1e-12, np.float32), *(np.full(p.shape, 1e-12, np.float32) for p in net.params()[1:])]

    def _move(self, k: int, grad: np.ndarray, at: int | None = None) -> None:
        p, s = self.net.params()[k], self.squares[k]
        if at is not None:
            p, s = p[at], s[at]
        s += grad * grad
        p -= RATE * grad / np.sqrt(s)

    def learn(self, windows: np.ndarray, leaves: np.ndarray) -> None:
        """One step; gradients are sums, which Adagrad takes like means."""
        net, n, width = self.net, len(leaves), self.net.inner.shape[2]
        met = [net.embeddings[windows[:, p]] for p in range(len(WINDOW))]
        h = np.tanh(sum((m * a for m, a in zip(met, net.places, strict=True)), net.hidden))
        back, grad, bias = np.empty_like(h), np.zeros_like(net.classes), np.zeros_like(net.class_bias)
        for i in range(0, n, NEAR):
            own = h[i : i + NEAR]
            z = _errors(own @ net.classes + net.class_bias, leaves[i : i + NEAR] // width)
            back[i : i + NEAR] = z @ net.classes.T
            grad += own.T @ z
            bias += z.sum(axis=0)
        self._move(3, grad)
        self._move(4, bias)
        order, parts, slot = net.by_class(leaves)
        sorted_h, sorted_back = h[order], np.empty_like(h)
        for c, i, j in parts:
            own = sorted_h[i:j]
            z = _errors(own @ net.inner[c] + net.inner_bias[c], slot[i:j])
            sorted_back[i:j] = z @ net.inner[c].T
            self._move(5, own.T @ z, c)
            self._move(6, z.sum(axis=0), c)
        back[order] += sorted_back
        back *= 1 - h * h
        self._move(2, back.sum(axis=0))
        self._move(1, np.stack([(back * m).sum(axis=0) for m in met]))
        ids = windows.T.ravel()
        grad = np.concatenate([back * a for a in net.places])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        grad, ids = np.add.reduceat(grad[order], at, axis=0), ids[at]
        self.squares[0][ids] += (grad * grad).mean(axis=1)
        net.embeddings[ids] -= RATE * grad / np.sqrt(self.squares[0][ids])[:, None]
        self.steps += 1


class Pass:
    """One pass over texts: gathers masked tokens to steps, and goes over held texts again if there were too few."""

    def __init__(self, net: Network, mark: int, phase: int):
        self.learner, self.mark, self.phase = Learner(net), mark, phase
        self.seen, self.held, self.kept = 0, [], 0
        self.windows: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        self.waiting = 0

    def _mask(self, ids: np.ndarray, sizes: np.ndarray, at: int, phase: int) -> None:
        wanted = np.flatnonzero(mix(np.arange(at, at + len(ids), dtype=U64)) % U64(MASKED) == U64(phase % MASKED))
        self.windows.append(contexts(ids, sizes, self.mark, wanted))
        self.leaves.append(ids[wanted])
        self.waiting += len(wanted)
        if self.waiting >= STEP:
            self.flush(STEP)

    def flush(self, least: int = 1) -> None:
        """Steps on what waits, while there are ``least`` tokens."""
        if not self.waiting:
            return
        w, y = np.concatenate(self.windows), np.concatenate(self.leaves)
        i = 0
        while len(y) - i >= least:
            self.learner.learn(w[i : i + STEP], y[i : i + STEP])
            i = min(i + STEP, len(y))
        self.windows, self.leaves, self.waiting = [w[i:]], [y[i:]], len(y) - i

    def take(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self._mask(ids, sizes, self.seen, self.phase)
        if self.kept < LEAST_STEPS * STEP:
            self.held.append((ids, sizes, self.seen))
            self.kept += len(ids)
        self.seen += len(ids)

    def end(self) -> None:
        self.flush()
        phase = self.phase
        while self.seen and self.learner.steps < LEAST_STEPS:
            phase += 1
            for ids, sizes, at in self.held:
                if self.learner.steps < LEAST_STEPS:
                    self._mask(ids, sizes, at, phase)
            self.flush()


def _passed(shared, phase: int):
    """Goes over all texts of a partition from the shared weights: (slot, part, tokens, slice of the weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value
        own, hashes = Pass(net.copy(), words.mark, phase), _Hashes()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                found, sizes = prepare(texts_of(batch.column(0).slice(i, ROWS)), hashes)
                own.take(placed(words, found)[0], sizes)
        own.end()
        if own.seen:
            flat = np.concatenate([p.ravel() for p in own.learner.net.params()]).astype("<f4").tobytes()
            for k in range(0, len(flat), SLICE):
                yield pa.RecordBatch.from_pydict({"slot": pa.array([k // SLICE], pa.int64()), "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([own.seen], pa.int64()), "weights": pa.array([flat[k : k + SLICE]], pa.binary())})
        del own, hashes
        give_back()

    return run


def _averaged(key, table):  # Spark tells grouped functions apart by their hints
    """The mean by tokens of one slice, added up in the order of the partitions."""
    total, out = 0, 0.0
    for i in np.argsort(table.column("part").to_numpy(), kind="stable").tolist():
        n = table.column("n")[i].as_py()
        total, out = total + n, out + n * np.frombuffer(table.column("weights")[i].as_py(), "<f4").astype(np.float64)
    return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([total], pa.int64()), "weights": pa.array([(out / max(total, 1)).astype("<f4").tobytes()], pa.binary())})


def learn(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Train over all texts; the driver gets one set of weights a round."""
    spark = docs.sparkSession
    net = Network.start(words.leaf_counts())
    kind = "slot long, part long, n long, weights binary"
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((words, net))
        parts = stage(docs.select("text").mapInArrow(_passed(shared, k), kind), "weights")
        left = (parts.agg(F.max("part")).first()[0] or 0) + 1
        means = parts
        while left > 1:
            group = F.floor(F.col("part") / GROUP).cast("long").alias("group")
            means = means.groupBy("slot", group).applyInArrow(_averaged, kind)
            left = -(-left // GROUP)
        found = means.toArrow()
        unstage(parts)
        if not found.num_rows:
            return net
        order = np.argsort(found.column("slot").to_numpy()).tolist()
        flat, at, out = np.frombuffer(b"".join(found.column("weights")[i].as_py() for i in order), "<f4"), 0, []
        for p in net.params():
            out.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        net = Network(*out)
    return net


def _known(shared):
    """Documents to the sum of what is known of their tokens, and the hashes of the words whose counts are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value
        hashes, place, tables = _Hashes(), TaskContext.get().partitionId() << 40, net.tables()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                found, sizes = prepare(texts_of(part.column(1)), hashes)
                leaves, share, rare = placed(words, found)
                windows = contexts(leaves, sizes, words.mark)
                logs = np.concatenate([share[:0], *(net.log_probabilities(windows[j : j + TOKENS], leaves[j : j + TOKENS], tables) + share[j : j + TOKENS] for j in range(0, len(leaves), TOKENS))])
                ends = np.concatenate([[0], np.cumsum(rare)])[starts_of(sizes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(place, place + part.num_rows)), part.column(0), pa.array(sizes), pa.array(sums_by(logs, sizes)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[rare]))],
                    names=["place", "doc_id", "n_tokens", "known", "rare"],
                )
                place += part.num_rows
        del hashes, tables
        give_back()

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_probability, mean_log_probability of every document."""
    counts = word_counts(docs)
    words = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast((words, learn(docs, words)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = stage(rows.mapInArrow(_known(shared), "place long, doc_id long, n_tokens long, known double, rare array<long>"), "known")
    # whole numbers, so that the order in which they are added up does not show
    log = F.round(F.log(F.col("n") + 1) * 1e9).cast("long")
    rare = known.select("place", F.explode("rare").alias("word")).join(counts, "word").groupBy("place").agg(F.sum(log).alias("logs"))
    total = F.col("known") + F.coalesce(F.col("logs"), F.lit(0)) / 1e9
    mean = total / F.greatest("n_tokens", F.lit(1))
    return known.drop("rare").join(rare, "place", "left").select("doc_id", "n_tokens", F.round(total, 4).alias("log_probability"), F.round(mean, 6).alias("mean_log_probability"))
