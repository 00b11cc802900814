"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade > k | text) = sigmoid(w . x - theta_k), one weight vector for all of the
rising thresholds.  Features are the distinct words and word beginnings of a
text, hashed.  The fit is a proximal gradient with an L1 penalty, so few
features keep a weight; the result is the expected grade over the highest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import bytetext as B
from panelspark.llm.common import cut, forget, table
from panelspark.llm.decontaminate import normal_words
from panelspark.llm.exchange import runs

#: Labelled rows a model is fitted on, at most: those with the smallest hash.
MAX_ROWS = 20_000
#: Features that may get a weight: those most unlike between the grades (65,536 at most).
MAX_FEATURES = 2048
FEATURE_BITS = 22
#: Expected severity from which a document counts as toxic.
THRESHOLD = 0.15
PREFIX_BYTES = 5


def features(t: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text and the text each belongs to, in order."""
    w = normal_words(t)
    owner = w.owner()
    starts = B.span_hash(B.prefix_hash(B._BYTE_VALUE[w.data]), w.start, np.minimum(w.end, w.start + PREFIX_BYTES), 61)
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    both = (np.concatenate([owner, owner]).astype(np.uint64) << np.uint64(FEATURE_BITS)) | np.concatenate([w.hash & mask, starts & mask])
    both = np.sort(both)
    both = both[runs(both)]
    return (both & mask).astype(np.uint32), (both >> np.uint64(FEATURE_BITS)).astype(np.int64)


@dataclass
class CumulativeLink:
    """Sorted feature numbers, their weights, and one threshold per grade but the lowest."""

    feature: np.ndarray
    weight: np.ndarray
    theta: np.ndarray

    def grades(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.theta[None, :], -60, 60)))

    def eta(self, t: B.Texts) -> np.ndarray:
        number, owner = features(t)
        at = np.searchsorted(self.feature, number)
        at[at == len(self.feature)] = 0
        hit = self.feature[at] == number if len(self.feature) else np.zeros(len(number), bool)
        return np.bincount(owner[hit], self.weight[at[hit]], len(t))


def fit_ordinal(indptr: np.ndarray, columns: np.ndarray, n_features: int, grade: np.ndarray, n_grades: int, penalty: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for rows given as lists of active columns (indptr, columns)."""
    n = len(grade)
    row = np.repeat(np.arange(n), np.diff(indptr))
    times = lambda w: np.bincount(row, w[columns], n)
    back = lambda r: np.bincount(columns, r[row], n_features)
    share = np.array([(grade > k).mean() for k in range(n_grades - 1)])
    theta = -np.log((share + 1e-4) / (1 - share + 1e-4))
    u = np.ones(n_features)
    for _ in range(15):  # largest eigenvalue, for the step
        u = back(times(u)) / n
        norm = np.linalg.norm(u) + 1e-12
        u /= norm
    step = 1 / (0.5 * (norm + 1))
    w = v = np.zeros(n_features)
    old, t = theta.copy(), 1.0
    for _ in range(steps):
        # P(grade = g) = s(eta - theta[g-1]) - s(eta - theta[g]), with s = 1 below and 0 above
        s = 1 / (1 + np.exp(-np.clip(times(v)[:, None] - theta[None, :], -60, 60)))
        edge = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        slope = edge * (1 - edge)
        at = np.arange(n)
        p = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-12)
        d_low, d_high = slope[at, grade] / p, slope[at, grade + 1] / p
        d_eta = -(d_low - d_high)
        d_theta = np.array([(np.where(grade == k + 1, d_low, 0) - np.where(grade == k, d_high, 0)).mean() for k in range(n_grades - 1)])
        new = v - step * back(d_eta) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        moved = np.maximum.accumulate(theta - step * d_theta)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, theta = new + (t - 1) / nt * (new - w), np.maximum.accumulate(moved + (t - 1) / nt * (moved - old))
        w, old, t = new, moved, nt
    return w, old


def base_rates(grade: int, n_grades: int) -> CumulativeLink:
    """The model where all rows have one grade: no features."""
    return CumulativeLink(np.zeros(0, np.uint32), np.zeros(0), np.where(np.arange(n_grades - 1) < grade, -10.0, 10.0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in B.texts(batch["text"]):
            number, owner = features(t)
            cut_at = np.searchsorted(owner, np.arange(len(t) + 1))
            packed = [number[a:b].tobytes() for a, b in zip(cut_at[:-1], cut_at[1:], strict=True)]
            part = batch.slice(t.first, len(t))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["_y"], pa.array(packed, pa.binary())], names=["doc_id", "_y", "features"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a batch hold each feature, and the sum of their grades."""
    for batch in batches:
        packed = batch["features"].to_pylist()
        number = np.frombuffer(b"".join(packed), np.uint32)
        grade = np.repeat(batch["_y"].to_numpy(), [len(x) // 4 for x in packed])
        distinct, inverse = np.unique(number, return_inverse=True)
        n, s = np.bincount(inverse, minlength=len(distinct)), np.bincount(inverse, grade, len(distinct))
        yield pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(s)], names=["feature", "n", "s"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> CumulativeLink:
    """Fits on at most max_rows labelled rows; grades are the whole numbers 0, 1, ... of the label column.

    The features kept are those whose mean grade is furthest from the rest's, in
    standard errors.  Only they come to the driver: max_rows rows of at most
    max_features numbers of two bytes.  Labels that are null or negative and
    rows with a null id aren't learnt from; labelled ids that repeat count once
    for each pair of rows, within max_rows.
    """
    spark = docs.sparkSession
    rows = labels.filter(F.col(label).isNotNull() & (F.col(label) >= 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    sample = rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)  # bounded, so it may go to every task
    few = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select(F.col("doc_id").cast("long"), "_y", "text")
    few = few.mapInArrow(_packed, "doc_id long, _y int, features binary")
    few = cut(few.orderBy(F.xxhash64("doc_id"), "doc_id", "_y", "features").limit(max_rows))
    grades = few.agg(F.count("*").alias("n"), F.avg("_y").alias("mean"), F.var_pop("_y").alias("var"), F.min("_y").alias("low"), F.max("_y").alias("high")).first()
    if not grades["n"] or grades["low"] == grades["high"]:
        top = grades["high"] or 0
        return base_rates(top, max(2, top + 1))
    spread = max(grades["var"], 1e-9)
    tally = few.mapInArrow(_tally, "feature long, n long, s double").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n >= 3")
    z = F.abs(F.col("s") - grades["mean"] * F.col("n")) / F.sqrt(F.col("n") * spread)
    best = tally.select("feature", z.alias("z")).filter("z > 0").orderBy(F.desc("z"), "feature").limit(max_features).collect()
    number = np.sort(np.array([r["feature"] for r in best], np.uint32))
    sent = spark.sparkContext.broadcast(number)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.flatnonzero(np.isin(sent.value, np.frombuffer(x, np.uint32), kind="sort")).astype(np.uint16).tobytes() for x in batch["features"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_y"], pa.array(kept, pa.binary())], names=["doc_id", "_y", "kept"])

    got = few.mapInArrow(pick, "doc_id long, _y int, kept binary").orderBy("doc_id", "_y", "kept").limit(max_rows).toArrow()
    forget(few)
    lists = [np.frombuffer(x.as_buffer(), np.uint16) for x in got["kept"]]
    grade = got["_y"].to_numpy().astype(np.int64)
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    w, theta = fit_ordinal(indptr, np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), len(number), grade, int(grade.max()) + 1)
    some = np.flatnonzero(np.abs(w) > 1e-6)
    return CumulativeLink(number[some], w[some], theta)


def severity(docs: DataFrame, model: CumulativeLink, text_column: str = "text") -> DataFrame:
    """docs plus expected_severity (0 to 1: the expected grade over the highest) and grade (the likeliest).

    A null or empty text has no features and gets the grades' base rates.  Other
    columns pass through (columns of the two names are replaced); repeated rows
    score alike; an empty table stays empty.
    """
    plain = docs.drop("expected_severity", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            eta = np.concatenate([np.zeros(0), *(model.eta(t) for t in B.texts(batch[text_column]))])
            above = model.grades(eta)
            p = np.diff(np.concatenate([np.zeros((len(eta), 1)), 1 - above, np.ones((len(eta), 1))], axis=1), axis=1)
            columns = [*batch.columns, pa.array(above.sum(axis=1) / above.shape[1]), pa.array(p.argmax(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "expected_severity", "grade"])

    schema = T.StructType([*plain.schema.fields, T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType())])
    return plain.mapInArrow(run, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = severity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "expected_severity", "grade", (F.col("expected_severity") >= THRESHOLD).cast("int").alias("toxic"))
