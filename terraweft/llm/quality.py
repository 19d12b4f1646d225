"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (FTRL-Proximal).

A text is cut into runs of word characters and runs of punctuation. Each run and each pair of neighbouring runs, and
eighths of the runs that are upper case and of the pairs that repeat a run, are hashed into 2**BITS buckets; the
distinct buckets of a text form its unit vector. The model
is a dense weight vector of that fixed size (2 MB), so that it may be broadcast at any size of the corpus.

Defined results: a null or empty text has no features and scores the bias; rows without a label, with a label other
than 0 and 1 or with both labels are not learned from; with no label at all every score is 0.5; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweft.llm.common import bounded_sample

BITS = 18
#: Learning reads at most so many labelled rows (those with the smallest seeded hash of doc_id).
LEARN_ROWS = 12_000
THRESHOLD = 0.3
_RUN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a text."""
    runs = _RUN.findall(text.encode("utf-8", "surrogatepass")) if text else []
    if not runs:
        return np.empty(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, runs), np.uint64, len(runs))
    pairs = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[1:]
    upper = np.fromiter(map(bytes.isupper, runs), bool, len(runs))
    same = hashed[:-1] == hashed[1:]
    shape = np.array([8 * upper.mean(), 100 + 8 * same.mean() if len(runs) > 1 else 100, 200 + min(7, np.log2(len(runs)))]).astype(np.uint64)
    every = np.concatenate([hashed, pairs, shape * np.uint64(0xC2B2AE3D27D4EB4F)])
    return np.unique((every >> np.uint64(64 - BITS)).astype(np.int64))


@dataclass
class Ftrl:
    """FTRL-Proximal for logistic loss with L1 and L2 penalties; the last weight is the bias."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.001

    def __post_init__(self) -> None:
        self.z = np.zeros(2**BITS + 1)
        self.n = np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, buckets: np.ndarray, label: int, importance: float = 1.0) -> None:
        at = np.append(buckets, 2**BITS)
        x = np.full(len(at), 1 / np.sqrt(max(1, len(buckets))))
        x[-1] = 1.0
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x * importance
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def score(weights: np.ndarray, buckets: np.ndarray) -> float:
    """A sparse dot product through the logistic function."""
    dot = weights[-1] + weights[buckets].sum() / np.sqrt(max(1, len(buckets)))
    return float(1 / (1 + np.exp(-np.clip(dot, -35, 35))))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, epochs: int = 4) -> np.ndarray:
    """The weight vector, learned by one task from a bounded sample of the rows that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("low")).where("low = quality").select("doc_id", "quality")
    chosen = bounded_sample(known, "doc_id", rows, "learn")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "quality": b.quality, "buckets": [features(t).astype(np.int32).tobytes() for t in b.text]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat([pd.DataFrame({"doc_id": [], "quality": [], "buckets": []}), *batches])
        every = every.sort_values(["doc_id", "buckets"], kind="stable").sample(frac=1.0, random_state=7) if len(every) else every
        model = Ftrl()
        pairs = [(np.frombuffer(b, np.int32).astype(np.int64), int(q)) for b, q in zip(every.buckets, every.quality, strict=True)]
        for _ in range(epochs):
            for buckets, label in pairs:
                model.learn(buckets, label)
        yield pd.DataFrame({"weights": [model.weights().astype(np.float64).tobytes()]})

    found = texts.mapInPandas(vectors, "doc_id long, quality int, buckets binary").repartition(1).mapInPandas(fit, "weights binary").collect()
    return np.frombuffer(found[0][0]) if found else np.zeros(2**BITS + 1)


def with_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with a column score (replaced if docs has one)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = sent.value
        for t in texts:
            yield pd.Series([score(w, features(x)) for x in t], dtype="float64")

    return docs.withColumn("score", scored("text"))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score threshold or more, with docs' columns; learn_from has the labelled texts."""
    held = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return with_scores(held, train(learn_from, labels)).where(F.col("score") >= threshold).select("_row.*")
