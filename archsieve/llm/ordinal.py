"""Quality classifier: a cumulative-link model of graded ratings.

A text has one latent score, the sum of the weights of its hashed words and of a few binned shape
features, divided by nothing: weights are shared by all grades. Ordered thresholds cut the score into
grades, P(grade <= k) = sigmoid(threshold_k - score). A text's expected grade and the probability
of at least ``accept`` decide selection.

Grades of labels: 0 toxic, 1 poor, 2 good (see ``graded``). The fit reads at most ``FIT_ROWS`` labelled
documents, chosen by a hash of their id, and runs in memory on the driver; scoring reads whole texts
in parallel. Several labels of one document: the lowest grade. Null labels are no labels. Null and
empty texts have no words and are judged by their shape alone. With fewer than two grades in the labels
there is nothing to learn: score fields are null and every document is selected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archsieve.llm.common import texts, tidy

#: Most labelled documents that the fit reads.
FIT_ROWS = 8_000
BUCKETS = 1 << 18
#: A bucket needs so many documents of the fit for a weight.
LEAST_DOCS = 4
STEPS, RATE, RIDGE = 150, 0.1, 2e-4
#: Most words that a task keeps with their buckets before starting anew.
KEPT_WORDS = 100_000
PUNCTUATION = ".,;:!?\"'()"
SYMBOLS = "#*$%&|<>"


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def shape(text: str, words: list[str], distinct: int) -> list[str]:
    """Names of binned shape features."""
    n, size = max(len(words), 1), max(len(text), 1)
    level = lambda x: min(int(x * 20), 10)
    return [
        f"\x00symbols{level(sum(map(text.count, SYMBOLS)) / n)}",
        f"\x00cries{level(text.count('!') / n)}",
        f"\x00distinct{int(10 * distinct / n)}",
        f"\x00length{min(len(words).bit_length(), 5)}",
        f"\x00lines{level(text.count(chr(10)) / n)}",
        f"\x00long{min(size // n // 4, 5)}",
    ]


class Features:
    """Text -> distinct buckets."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> list[int]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        words = text.lower().split()
        distinct = set(words)
        known = self.known
        for w in distinct:
            if w not in known:
                known[w] = zlib.crc32(w.strip(PUNCTUATION).encode()) % BUCKETS
        out = {known[w] for w in distinct}
        out.update(zlib.crc32(s.encode()) % BUCKETS for s in shape(text, words, len(distinct)))
        return list(out)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): one row a labelled document."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).when(F.col("quality") > 0, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame) -> Model | None:
    """The model of at most FIT_ROWS graded documents. An id that repeats gives one of its texts, the same in every run."""
    sample = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text", F.xxhash64("text").alias("h"))  # at most FIT_ROWS rows are sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part, bodies in texts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([sorted(features(t)) for t in bodies], pa.list_(pa.int32()))], names=["doc_id", "grade", "h", "f"])

    every = rows.mapInArrow(tidy(run), T.StructType([docs.schema["doc_id"], T.StructField("grade", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("f", T.ArrayType(T.IntegerType()))]))
    got = every.groupBy("doc_id", "grade").agg(F.min_by("f", "h").alias("f")).toArrow()
    y = got["grade"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    order = np.argsort(got["doc_id"].to_pandas().to_numpy(), kind="stable")
    lists = got["f"].combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    flat = lists.flatten().to_numpy()
    starts = ends - lists.value_lengths().to_numpy()
    at = np.concatenate([np.arange(starts[i], ends[i]) for i in order])
    return train(flat[at], (ends - starts)[order], y[order])


def train(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> Model:
    """Full-batch Adam on the negative log-likelihood. flat: the buckets of all rows, sizes: how many each row has."""
    top = int(y.max())
    seen = np.bincount(flat, minlength=BUCKETS)
    use = seen[flat] >= LEAST_DOCS
    row = np.repeat(np.arange(len(y)), sizes)[use]
    columns, local = np.unique(flat[use], return_inverse=True)
    share = np.array([(y <= k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    thresholds = np.log(share / (1 - share))
    gaps = np.log(np.diff(thresholds, prepend=thresholds[0] - 1).clip(1e-2))  # thresholds are a first one and positive gaps
    p = np.concatenate([np.zeros(len(columns)), thresholds[:1], gaps[1:]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n, k = len(y), len(columns)
    for step in range(1, STEPS + 1):
        t = p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))])
        bounds = np.concatenate([[-np.inf], t, [np.inf]])
        s = np.bincount(row, p[local], minlength=n)
        with np.errstate(over="ignore"):
            upper, lower = 1 / (1 + np.exp(-(bounds[y + 1] - s))), 1 / (1 + np.exp(-(bounds[y] - s)))
        mass = (upper - lower).clip(1e-9)
        g = np.zeros_like(p)
        g[:k] = np.bincount(local, (1 - upper - lower)[row], minlength=k) / n + RIDGE * p[:k]
        by = np.bincount(y, -upper * (1 - upper) / mass, minlength=top + 1)[:top] + np.bincount(y, lower * (1 - lower) / mass, minlength=top + 1)[1 : top + 1]
        g[k] = by.sum() / n
        g[k + 1 :] = np.cumsum(by[::-1])[::-1][1:] * np.exp(p[k + 1 :]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[columns] = p[:k]
    return Model(weights, p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))]))


def grade(docs: DataFrame, model: Model | None, accept: int = 2, least: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with expected_grade, tail_probability (of ``accept`` at least) and selected."""
    if model is None:
        return docs.select(*keep, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("selected"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    rows = docs.select("text", *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, thresholds = Features(), held.value.weights, held.value.thresholds
        for batch in batches:
            for part, bodies in texts(batch):
                score = np.array([weights[features(t)].sum(dtype=np.float64) for t in bodies])
                tails = 1 / (1 + np.exp((thresholds[None, :] - score[:, None]).clip(-500, 500)))
                tail = tails[:, accept - 1] if accept <= len(thresholds) else np.zeros(len(score))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], names=[*keep, "expected_grade", "tail_probability", "selected"])

    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    return rows.mapInArrow(tidy(run), T.StructType([*fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("selected", T.BooleanType())]))
