"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Statistics of the whole text are plain column expressions. On a bounded sample of labelled rows, boosted shallow
trees over the statistics are grown; every path from a root to a node becomes a conjunctive rule; a lasso logistic
regression keeps few rules. The kept rules are compiled into one Spark expression, so scoring needs no Python.

Defined results: a null text is scored as an empty one, which has one empty word and one empty line; a text of any length is scored
whole; a label row that is null or repeated for a document counts as the largest label given; of several texts of one
labelled id the first by its statistics is learned; with labels of one class only, or none at all, every score is the
smoothed share of label 1 (0.5 without labels). Repeated rows and rows without id stay, each with its score, and equal
texts have equal scores. Extra columns are ignored or, in ``keep_good``, kept; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import crc_fold, small_batches, stage

#: Labelled rows that the model is fitted on at most, chosen by a hash of the id.
MAX_LABELLED = 20_000
#: Rows of the rule matrix that are numbers at once; it is held as truth values.
BLOCK = 2048
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.3
#: Rows of a leaf at least; fewer where less than LEAF * BINS rows are labelled, so that a rare kind of text has leaves.
LEAF = 8
FOLDS, HELD = 3, 1

_SPACE = r"[\x20\x09-\x0D]+"


def _left(text: Column, keep: str) -> Column:
    """How many characters of the class ``keep`` the text has; runs of others go at once."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """The statistics by name; a share of nothing is 0."""
    t = F.coalesce(text, F.lit(""))
    words, lines = F.split(F.btrim(t, F.lit(" \t\n\v\f\r")), _SPACE), F.split(t, "\n")
    chars, n_words, n_lines = F.length(t).cast("double"), F.size(words).cast("double"), F.size(lines).cast("double")
    per = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return {
        "log_words": F.log1p(n_words),
        "word_length": per(chars, n_words),
        "distinct_words": per(F.size(F.array_distinct(words)).cast("double"), n_words),
        "distinct_lines": per(F.size(F.array_distinct(lines)).cast("double"), n_lines),
        "words_per_line": per(n_words, n_lines),
        "upper": per(_left(t, r"\p{Lu}"), chars),
        "digits": per(_left(t, "0-9"), chars),
        "symbols": per(_left(t, r"#$%&*@~^=+<>{}\[\]\\/_"), n_words),
        "bars": per(_left(t, "|"), n_words),
        "bangs": per(_left(t, "!?"), n_words),
        "stops": per(_left(t, ".,;:"), n_words),
    }


NAMES = ("log_words", "word_length", "distinct_words", "distinct_lines", "words_per_line", "upper", "digits", "symbols", "bars", "bangs", "stops")
#: A rule is a conjunction of (statistic, is it above the threshold, threshold).
Rule = tuple[tuple[str, bool, float], ...]


def _grow(x: np.ndarray, codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple[tuple, np.ndarray, float]]:
    """One tree on gradients: every node below the root as (path of (feature, above, threshold), members, step)."""
    nodes, todo, leaf = [], [((), np.arange(len(x)), 0)], min(LEAF, max(2, len(x) // BINS))
    while todo:
        path, rows, depth = todo.pop()
        if path:
            nodes.append((path, rows, -g[rows].sum() / (h[rows].sum() + 1.0)))
        if depth == DEPTH or len(rows) < 2 * leaf:
            continue
        best = (1e-6, -1, 0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            if not len(edges[f]):
                continue
            k = len(edges[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(codes[rows, f], weights=w, minlength=k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(ns < leaf) | (len(rows) - ns < leaf)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
        if best[1] < 0:
            continue
        _, f, at = best
        low = codes[rows, f] <= at
        for above, part in ((False, rows[low]), (True, rows[~low])):
            todo.append(((*path, (f, above, float(edges[f][at]))), part, depth + 1))
    return nodes


def rules_of(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = NAMES) -> list[Rule]:
    """The distinct paths of boosted trees as rules; thresholds stand midway between two values, near inner quantiles."""
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        at = np.unique(np.searchsorted(values, np.quantile(x[:, f], np.arange(1, BINS) / BINS), side="right") - 1)
        at = at[at < len(values) - 1]
        edges.append(np.unique(np.round((values[at] + values[at + 1]) / 2, 6)))
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, found = np.full(len(x), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        nodes = _grow(x, codes, edges, p - y, p * (1 - p) + 1e-6)
        if not nodes:
            break
        for path, rows, step in nodes:
            found.setdefault(tuple(sorted((names[f], above, t) for f, above, t in path)), None)
            margin[rows] += RATE * step / DEPTH
    return list(found)


def holds(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), dtype=bool)
    for name, above, t in rule:
        out &= (values[name] > t) if above else (values[name] <= t)
    return out


def lasso(z: np.ndarray, y: np.ndarray, weight: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty by accelerated proximal steps; the intercept is free."""
    n, m = z.shape
    kind = np.float32 if z.dtype == bool else z.dtype
    y = y.astype(kind)
    blocks = lambda: ((slice(i, i + BLOCK), z[i : i + BLOCK].astype(kind)) for i in range(0, n, BLOCK))
    w, b = np.zeros(m, kind), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    u, c, t = w.copy(), b, 1.0
    v = np.ones(m, kind) / np.sqrt(max(m, 1)).astype(kind)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v = sum((part.T @ (part @ v) for _, part in blocks()), np.zeros(m, kind))
        v /= np.linalg.norm(v) + 1e-12
    step = float(1 / (0.25 * (sum(np.linalg.norm(part @ v) ** 2 for _, part in blocks()) / n + 1.0) + 1e-9))
    for _ in range(rounds):
        e, back = np.zeros(n, kind), np.zeros(m, kind)
        for at, part in blocks():
            e[at] = (1 / (1 + np.exp(-np.clip(part @ u + c, -30, 30))) - y[at]) / n
            back += part.T @ e[at]
        w1 = u - step * back
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * weight, 0)
        b1 = c - step * float(e.sum())
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, values: dict[str, Column]) -> Column:
        """The compiled score, between 0 and 1."""
        margin = F.lit(self.intercept)
        for rule, w in self.rules:
            test = F.lit(True)
            for name, above, t in rule:
                test = test & ((values[name] > t) if above else (values[name] <= t))
            margin = margin + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def predict(self, x: np.ndarray, names: tuple[str, ...] = NAMES) -> np.ndarray:
        values = {n: x[:, i] for i, n in enumerate(names)}
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, values) for r, w in self.rules), np.zeros(len(x))))))


def fit_ensemble(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = NAMES) -> RuleEnsemble:
    """Rules, then lasso weights; the penalty is chosen on every fifth row."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    test = np.arange(len(y)) % 5 == 4
    rules = rules_of(x, y, names)
    values = {n: x[:, i] for i, n in enumerate(names)}
    z = np.stack([holds(r, values) for r in rules], axis=1) if rules else np.zeros((len(y), 0), dtype=bool)
    best, chosen = np.inf, 0.001
    if 0 < y[~test].mean() < 1 and test.any():
        fitted, judged = z[~test], z[test]
        for weight in (0.01, 0.003, 0.001, 0.0003):
            w, b = lasso(fitted, y[~test], weight, 150)
            p = np.clip(1 / (1 + np.exp(-(judged @ w + b))), 1e-6, 1 - 1e-6)
            loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
            if loss < best * 0.99:
                best, chosen = loss, weight
        del fitted, judged
    w, b = lasso(z, y, chosen)
    return RuleEnsemble(b, tuple((r, float(c)) for r, c in zip(rules, w.tolist(), strict=True) if abs(c) > 1e-4))


def with_statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in statistics(F.col("text")).items()])


def pick(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most ``max_labelled`` labelled ids outside the held-out fold, so few that they can be broadcast."""
    given = labels.where(F.col("quality").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD))
    given = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("label"))
    return F.broadcast(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))


def learn(stats: DataFrame, picked: DataFrame) -> RuleEnsemble:
    """Fit on the picked rows; only their statistics reach the driver."""
    rows = stats.join(picked, "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", *NAMES)).alias("s")).orderBy("doc_id").select("s.*").toArrow()
    x = np.stack([rows.column(n).to_numpy() for n in NAMES], axis=1) if rows.num_rows else np.zeros((0, len(NAMES)))
    return fit_ensemble(x.astype(np.float64), rows.column("label").to_numpy().astype(np.float64))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; the texts are read once."""
    stats = stage(with_statistics(docs), "quality-statistics")
    score = learn(stats, pick(labels)).score({n: F.col(n) for n in NAMES})
    held = crc_fold(F.col("doc_id"), FOLDS) == HELD
    return stats.select("doc_id", held.alias("held_out"), score.alias("score")).select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``least``, with all their columns.

    The statistics are made once a row, in a projection of their own, and the rules read them by name.
    """
    small_batches(docs.sparkSession)
    picked = pick(labels)
    few = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(picked.select(F.col("doc_id").alias("picked_id")), F.col("doc_id").cast("long") == F.col("picked_id"), "left_semi")
    model = learn(with_statistics(few), picked)
    document = F.struct(*[F.col(c) for c in docs.columns]).alias("document")
    # a filter is not pushed below a projection that holds a random number; there each rule would count anew
    rows = docs.select(document, F.array(*statistics(F.col("text")).values()).alias("statistics"), F.rand(0).alias("mark"))
    score = model.score({n: F.col("statistics")[i] for i, n in enumerate(NAMES)})
    return rows.where((score >= least) & (F.col("mark") >= 0)).select("document.*")
