"""Toxicity by non-negative positive-unlabelled learning with a class-prior-corrected risk.

The training data are confirmed toxic texts (positives) and unlabelled texts: a bounded sample of each,
chosen by a hash of the text's id. Near copies in the sample count once. Words and word beginnings become features: a
vocabulary bounded by MAX_FEATURES is taken from the sample, of those that positives hold significantly
more often than unlabelled texts (a likelihood ratio test), strongest first. A numpy linear model
minimises the non-negative PU risk

    prior * R(positives, +1) + max(0, R(unlabelled, -1) - prior * R(positives, -1))

with the logistic loss; where the second term falls below zero, its gradient is reversed. The prior is the
share of toxic rows among the training labels (a parameter otherwise). Every whole text is then scored on
the executors with the small model.

Labels come only from rows outside the held-out fold; labels, lang, source and ids are never features.
Null or empty texts score the model's bias; very long texts are read whole. Without any positive label every score is 0. Repeated rows
score alike; several labels of one id count as toxic if any is. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lengthlab.llm.common import materialise, read, slices, text_or_empty

#: Sample bounds and model settings; all are parameters of `train`.
MAX_POSITIVES = 4_000
MAX_UNLABELLED = 12_000
MAX_FEATURES = 2_000
#: Likelihood ratio (2 ln) that a feature needs, and positives that hold it at least.
SIGNIFICANT = 18.0
MIN_POSITIVES = 4
#: Lengths of word beginnings.
BEGINNINGS = (5, 6, 7)
FOLDS = 5

WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    """The distinct words, and beginnings of longer words (marked by a hyphen)."""
    words = set(WORD.findall(text.lower()))
    for n in BEGINNINGS:
        words |= {w[:n] + "-" for w in words if len(w) > n and w[-1] != "-"}
    return words


def signature(features: set[str]) -> list[int]:
    """The four least hashes of the longer words; near copies share most of them."""
    return heapq.nsmallest(4, (zlib.crc32(w.encode()) for w in features if w[-1] != "-" and len(w) > 6))


def once(signatures: list[tuple[int, list[int]]]) -> list[int]:
    """The ids whose signature has no pair of hashes in common with an earlier one."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, least in signatures:
        pairs = {(a, b) for k, a in enumerate(least) for b in least[k + 1 :]}
        if not pairs & seen:
            kept.append(i)
        seen |= pairs
    return kept


@dataclass
class Model:
    """Log-odds: bias plus the weight of each known feature that the text holds."""

    bias: float = -40.0
    weights: dict[str, float] = field(default_factory=dict)

    def logit(self, text: str) -> float:
        known = self.weights
        return self.bias + sum([known[w] for w in features_of(text) if w in known])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Risk:
    """The non-negative PU risk of a linear model over binary features; the last parameter is the bias."""

    def __init__(self, positives: list[list[int]], unlabelled: list[list[int]], n_features: int, prior: float):
        self.positives, self.unlabelled = self._flat(positives), self._flat(unlabelled)
        self.n_p, self.n_u = len(positives), max(1, len(unlabelled))
        self.k, self.prior = n_features, prior

    @staticmethod
    def _flat(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(texts)), list(map(len, texts))), np.array([i for t in texts for i in t], np.int64)

    def _logits(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (p_row, p_col), (u_row, u_col) = self.positives, self.unlabelled
        return np.bincount(p_row, theta[p_col], self.n_p) + theta[-1], np.bincount(u_row, theta[u_col], self.n_u) + theta[-1]

    def parts(self, theta: np.ndarray) -> tuple[float, float]:
        """prior * R(positives, +1), and R(unlabelled, -1) - prior * R(positives, -1), which may be negative."""
        zp, zu = self._logits(theta)
        as_negative = np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()
        return self.prior * np.logaddexp(0, -zp).mean(), as_negative

    def value(self, theta: np.ndarray) -> float:
        positive, negative = self.parts(theta)
        return positive + max(0.0, negative)

    def gradients(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradients of both parts."""
        zp, zu = self._logits(theta)

        def back(of: tuple[np.ndarray, np.ndarray], slope: np.ndarray) -> np.ndarray:
            return np.append(np.bincount(of[1], slope[of[0]], self.k), slope.sum())

        positive = back(self.positives, -self.prior * _sigmoid(-zp) / self.n_p)
        negative = back(self.unlabelled, _sigmoid(zu) / self.n_u) - back(self.positives, self.prior * _sigmoid(zp) / self.n_p)
        return positive, negative

    def direction(self, theta: np.ndarray) -> np.ndarray:
        """The gradient of the risk; where the second part is negative its own gradient is reversed instead of dropped."""
        positive, negative = self.gradients(theta)
        return positive + negative if self.parts(theta)[1] >= 0 else positive - negative


def train(
    words: list[str],
    positives: list[list[int]],
    unlabelled: list[list[int]],
    prior: float,
    steps: int = 400,
    rate: float = 0.1,
    decay: float = 3e-5,
) -> Model:
    """Full-batch Adam on the non-negative PU risk. A text is the list of its features' places in `words`."""
    if not positives or not 0 < prior < 1:
        return Model()
    k = len(words)
    risk = Risk(positives, unlabelled, k, prior)
    theta = np.zeros(k + 1)
    theta[k] = np.log(prior / (1 - prior))
    mean, square = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        gradient = risk.direction(theta)
        gradient[:k] += decay * theta[:k]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(float(theta[k]), {w: float(theta[i]) for i, w in enumerate(words)})


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for the fold that gives no labels."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string")) % FOLDS == 0, F.lit(False))


def _drawn(ids: DataFrame, total: int, most: int, seed: str) -> DataFrame:
    """At most `most` distinct ids by a hash; of about `total` ids only a third more than `most` go to the task that picks."""
    among = 1 << 40
    below = among if total <= 2 * most else int((1.3 * most + 100) / total * among)
    near = ids.where(F.pmod(F.xxhash64("id", F.lit(seed), F.lit("threshold")), F.lit(among)) < below).distinct()
    return near.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
    max_features: int = MAX_FEATURES,
) -> Model:
    """Trains on bounded samples of the rows outside the held-out fold."""
    usable = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(label_col).isNotNull())
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = usable.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    if not known[1]:
        return Model()
    if prior is None:
        prior = min(0.9, known[1] / known[0])
    keyed = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    chosen = _drawn(usable.where("label = 1").select("id"), known[1], max_positives, "positive")
    # One text per id, however often its row is repeated, so the sample keeps its bound and stays dealt out.
    text_of = lambda ids: keyed.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))
    positives = text_of(chosen)
    others = keyed.where(F.col("id").isNotNull() & ~held_out("id")).select("id")
    total = others.agg(F.approx_count_distinct("id", 0.02)).first()[0]
    unlabelled = text_of(_drawn(others, total, max_unlabelled, "unlabelled"))
    sample = _featured(positives, True).unionByName(_featured(unlabelled, False))
    sample = materialise(sample.withColumn("sid", F.monotonically_increasing_id()), "sample")
    # Bounded by the sample: four numbers per text, then the chosen features, then their places per text.
    signatures = sample.where("positive").select("sid", "least").orderBy("sid").collect()
    distinct = once([tuple(r) for r in signatures])
    signatures = sample.where("not positive").select("sid", "least").orderBy("sid").collect()
    distinct += once([tuple(r) for r in signatures])
    ids = sample.sparkSession.createDataFrame([(i,) for i in distinct], "sid long")
    sample = sample.join(F.broadcast(ids), "sid")
    words = _significant(sample, max_features)
    index = {w: i for i, w in enumerate(words)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[index[w] for w in text if w in index] for text in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), pa.array(found, pa.list_(pa.int32()))], names=["positive", "at"]
            )

    rows = sample.select("positive", "features").mapInArrow(places, "positive boolean, at array<int>").collect()
    return train(words, [r.at for r in rows if r.positive], [r.at for r in rows if not r.positive], prior)


def _featured(texts: DataFrame, positive: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                found = [features_of(t) for t in batch.column("text").to_pylist()]
                arrays = [pa.array([sorted(f) for f in found], pa.list_(pa.string()))]
                arrays += [pa.array([signature(f) for f in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["features", "least"])

    found = texts.select("text").mapInArrow(run, "features array<string>, least array<long>")
    return found.withColumn("positive", F.lit(positive))


def _significant(sample: DataFrame, most: int) -> list[str]:
    """Features that positives hold significantly more often than unlabelled texts, most telling first."""
    sizes = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    n_p, n_u = F.lit(max(1, sizes[0])), F.lit(max(1, sizes[1]))
    counts = sample.select("positive", F.explode("features").alias("word")).groupBy("word")
    counts = counts.agg(F.count_if("positive").alias("n"), F.count_if(~F.col("positive")).alias("m"))
    n, m = F.col("n"), F.col("m")

    def fit(k: Column, size: Column, share: Column) -> Column:
        share = F.greatest(F.lit(1e-9), F.least(share, F.lit(1 - 1e-9)))
        return k * F.log(share) + (size - k) * F.log1p(-share)

    both = (n + m) / (n_p + n_u)
    ratio = 2 * (fit(n, n_p, n / n_p) + fit(m, n_u, m / n_u) - fit(n, n_p, both) - fit(m, n_u, both))
    p, u = n / n_p, (m + 0.5) / (n_u + 1)
    chosen = counts.where((n >= MIN_POSITIVES) & (p > u) & (ratio >= SIGNIFICANT))
    return [r.word for r in chosen.orderBy(F.desc(p * F.log(p / u)), "word").limit(most).collect()]


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                logit = np.array([own.logit(t) for t in batch.column("text").to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                arrays = [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(score),
                    pa.array((score >= 0.5).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text")
    )
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs, fit(docs, read(spark, sf_dir, "labels")))
