"""Quality classifier: a sparse ensemble of rules compiled into Spark columns.

Statistics of a text (shares of letters, symbols, repeats, line shapes) come
from one vectorised pass.  Small boosted trees over the statistics of labelled
rows propose rules: every path from a root is a conjunction of comparisons.
A lasso logistic regression over the rules keeps few of them, and those become
one Spark SQL expression, so scoring is a projection of the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import bytetext as B
from panelspark.llm.common import fold_of, table
from panelspark.llm.exchange import runs

#: Labelled rows a model is fitted on, at most: those with the smallest hash.
MAX_ROWS = 20_000
STATISTICS = (
    "n_words", "n_lines", "mean_word", "mean_line", "upper", "digit", "symbol", "final_mark", "space", "wide",
    "short_word", "long_word", "distinct_word", "top_word", "repeated_gram", "repeated_line", "symbol_word", "upper_word", "sentence_word",
)

_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[0x41:0x5B] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[0x30:0x3A] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[ord(c) for c in ".,;:?"]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[0x21:0x7F] = True
_IS_SYMBOL[0x30:0x3A] = _IS_SYMBOL[0x41:0x5B] = _IS_SYMBOL[0x61:0x7B] = False
_IS_SYMBOL &= ~_IS_MARK
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[0x41:0x5B] = _IS_LETTER[0x61:0x7B] = True
_IS_LETTER[0x80:] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets]).astype(np.float64)


def _repeats(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and the count of its commonest."""
    both = B.mix(h ^ B.mix(owner.astype(np.uint64), 51), 52)
    order = np.lexsort((both, owner))
    first = runs(both[order])
    length = np.diff(np.append(first, len(order)))
    text = owner[order[first]]
    top = np.zeros(n)
    np.maximum.at(top, text, length)
    return np.bincount(text, minlength=n).astype(np.float64), top


def statistics(t: B.Texts) -> dict[str, np.ndarray]:
    n = len(t)
    w = B.words(t)
    over = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    n_words, n_bytes = np.diff(w.offsets).astype(np.float64), np.diff(t.offsets).astype(np.float64)
    letters = _per_text(_IS_LETTER[t.data], t.offsets)
    length = (w.end - w.start).astype(np.float64)
    feeds = t.data == 0x0A
    n_lines = _per_text(feeds, t.offsets) + 1
    owner = w.owner()
    distinct, top = _repeats(w.hash, owner, n)
    at, (grams,) = B.windows(w, 4, (3,))
    n_grams = np.maximum(n_words - 3, 0)
    distinct_grams, _ = _repeats(grams, owner[at], n)
    breaks = np.concatenate([t.offsets[:-1], np.flatnonzero(feeds) + 1])
    line_start = np.sort(breaks)
    line_end = np.sort(np.concatenate([t.offsets[1:], np.flatnonzero(feeds)]))
    line_owner = np.sort(np.concatenate([np.arange(n), np.searchsorted(t.offsets, np.flatnonzero(feeds), "right") - 1]))
    lines = B.span_hash(B.prefix_hash(B._BYTE_VALUE[t.data]), line_start, line_end, 8)
    full = line_end > line_start
    n_full = np.bincount(line_owner[full], minlength=n).astype(np.float64)
    distinct_lines, _ = _repeats(lines[full], line_owner[full], n)
    last = t.data[np.maximum(w.end - 1, 0)] if len(w) else np.zeros(0, np.uint8)
    first = t.data[w.start] if len(w) else np.zeros(0, np.uint8)
    words = lambda flags: over(_per_text(flags, w.offsets), n_words)
    return {
        "n_words": n_words, "n_lines": n_lines, "mean_word": words(length), "mean_line": n_words / n_lines,
        "upper": over(_per_text(_IS_UPPER[t.data], t.offsets), letters), "digit": over(_per_text(_IS_DIGIT[t.data], t.offsets), n_bytes),
        "symbol": over(_per_text(_IS_SYMBOL[t.data], t.offsets), n_bytes), "final_mark": over(_per_text(_IS_MARK[t.data], t.offsets), n_words),
        "space": over(_per_text(B._SEPARATOR[t.data], t.offsets), n_bytes), "wide": over(_per_text(t.data >= 0x80, t.offsets), n_bytes),
        "short_word": words(length <= 3), "long_word": words(length >= 12), "distinct_word": over(distinct, n_words), "top_word": over(top, n_words),
        "repeated_gram": over(n_grams - distinct_grams, n_grams), "repeated_line": over(n_full - distinct_lines, n_full),
        "symbol_word": words(_IS_SYMBOL[last]), "upper_word": words(_IS_UPPER[first]), "sentence_word": words(last == 0x2E),
    }


def with_statistics(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` plus the struct ``_stats`` of doubles."""
    kinds = [docs.schema[c] for c in keep]
    stats = T.StructType([T.StructField(c, T.DoubleType()) for c in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(t) for t in B.texts(batch["_ps_text"])]
            values = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0)) for c in STATISTICS]
            column = pa.StructArray.from_arrays(values, names=list(STATISTICS))
            rest = batch.drop_columns(["_ps_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, column], names=[*rest.schema.names, "_stats"])

    plain = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_column).alias("_ps_text"))
    return plain.mapInArrow(run, T.StructType([*kinds, T.StructField("_stats", stats)]))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold)."""

    parts: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, limit in self.parts:
            out &= (x[name] > limit) if above else (x[name] <= limit)
        return out

    def sql(self) -> str:
        return " AND ".join(f"_stats.{name} {'>' if above else '<='} {limit!r}D" for name, above, limit in self.parts)


def grow(bins: np.ndarray, limits: list[np.ndarray], target: np.ndarray, weight: np.ndarray, names: tuple[str, ...], depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """Paths of one regression tree, and its values for all rows."""
    rules: list[Rule] = []
    value = np.zeros(len(bins))

    def split(rows: np.ndarray, parts: tuple, level: int) -> None:
        g, h = target[rows].sum(), weight[rows].sum()
        value[rows] = g / (h + 1)
        if level == depth or len(rows) < 2 * least:
            return
        best, choice = 1e-6, None
        for j in range(bins.shape[1]):
            size = len(limits[j]) + 1
            gs = np.cumsum(np.bincount(bins[rows, j], target[rows], size))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, j], weight[rows], size))[:-1]
            ns = np.cumsum(np.bincount(bins[rows, j], minlength=size))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > best:
                best, choice = gain[k], (j, k)
        if choice is None:
            return
        j, k = choice
        right = bins[rows, j] > k
        for above, part in ((False, rows[~right]), (True, rows[right])):
            path = (*parts, (names[j], above, float(limits[j][k])))
            rules.append(Rule(path))
            split(part, path, level + 1)

    split(np.arange(len(bins)), (), 0)
    return rules, value


def propose_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 20, seed: int = 0) -> list[Rule]:
    names = tuple(x)
    limits = [np.unique(np.quantile(x[c], np.linspace(0, 1, 33)[1:-1])) for c in names]
    bins = np.stack([np.searchsorted(cuts, x[c], "left") for c, cuts in zip(names, limits, strict=True)], axis=1)
    score = np.zeros(len(y))
    out: dict[Rule, None] = {}
    rng = np.random.default_rng(seed)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        use = rng.random(len(y)) < 0.7
        grown, value = grow(bins, limits, np.where(use, y - p, 0), np.where(use, p * (1 - p), 0), names, depth, least)
        score += rate * value
        out |= dict.fromkeys(grown)
    return list(out)


def fit_lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights and intercept, by accelerated proximal gradient on centred columns."""
    mean, scale = r.mean(axis=0), np.maximum(r.std(axis=0), 1e-3)
    z = (r - mean) / scale
    w = v = np.zeros(z.shape[1])
    b = bv = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    top = z.T @ (z @ np.ones(z.shape[1]) / len(y))
    u = top / (np.linalg.norm(top) + 1e-12)
    for _ in range(20):
        u = z.T @ (z @ u) / len(y)
        lip = np.linalg.norm(u)
        u /= lip + 1e-12
    step, t = 1 / (0.25 * (lip + 1) * 1.1), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ v + bv))) - y
        new = v - step * (z.T @ error / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = bv - step * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bv = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w / scale, float(b - (w / scale) @ mean)


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The probability of label 1, over the struct _stats."""
        terms = [f"CASE WHEN {r.sql()} THEN {w!r}D ELSE 0D END" for r, w in zip(self.rules, self.weights, strict=True)]
        return F.expr(f"1D / (1D + exp(-({' + '.join([f'({self.intercept!r}D)', *terms])})))")


def fit(x: dict[str, np.ndarray], y: np.ndarray, penalties: tuple[float, ...] = (0.01, 0.003, 0.001), seed: int = 0) -> RuleEnsemble:
    """Rules, and the penalty of least log loss on a quarter of the rows kept aside."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble([], [], float(np.log(p / (1 - p))))
    rules = propose_rules(x, y, seed=seed)
    r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    aside = np.random.default_rng(seed).random(len(y)) < 0.25
    best = (np.inf, penalties[0])
    for penalty in penalties if 0 < aside.sum() < len(y) else ():
        w, b = fit_lasso(r[~aside], y[~aside], penalty)
        p = np.clip(1 / (1 + np.exp(-(r[aside] @ w + b))), 1e-9, 1 - 1e-9)
        best = min(best, (float(-np.mean(np.where(y[aside] == 1, np.log(p), np.log(1 - p)))), penalty))
    w, b = fit_lasso(r, y, best[1])
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([rules[i] for i in kept], [float(w[i]) for i in kept], b)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, folds: int = 5, held_out: int = 0) -> RuleEnsemble:
    """Fits on labelled rows outside the held-out fold, on at most max_rows of them."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held_out)).select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
    # at most max_rows rows of two numbers: small enough to go to every task by its bound
    sample = rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    few = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).drop("_id")
    got = with_statistics(few, ["doc_id", "_y"]).select("doc_id", "_y", "_stats.*").orderBy("doc_id", "_y", *STATISTICS).limit(max_rows).toArrow()
    return fit({c: got[c].to_numpy() for c in STATISTICS}, got["_y"].to_numpy())


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics of every row.

    A null or empty text has statistics of zero and a score like any other; a
    row with a null id is scored, with a null held_out.  Repeated rows score
    alike, and an empty table gives no rows.
    """
    s = with_statistics(docs, ["doc_id"]).withColumn("score", model.column())
    return s.select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("_stats").alias("statistics"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
