"""Quality classifier: supervised subword embeddings.

Hashed words, word pairs and character n-grams own learned vectors; a document is the average of its
vectors, and a softmax over two outputs reads its quality. Vectors and output weights are trained together
by stochastic gradient descent in numpy on a bounded sample of labelled rows (`per_class` rows a label,
chosen by a hash of the id). Scoring is one pass over whole texts, without a shuffle.

Cases: a null or empty text has no features and scores by the bias alone; null labels and null ids are not
learned from; repeated label rows of a document count as its largest label; with no or one known label the
score is the known share of label 1 (0.5 with none). Scores do not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .features import FeatureSpec


@dataclass(frozen=True)
class EmbeddingConfig:
    features: FeatureSpec = FeatureSpec(bits=17, orders=(3, 4), words=True, pairs=True)
    dim: int = 8
    epochs: int = 6
    rate: float = 0.3
    per_class: int = 2000      # bound of the training sample, by label
    seed: int = 11


@dataclass
class EmbeddingModel:
    features: FeatureSpec
    vectors: np.ndarray        # bucket -> vector
    weights: np.ndarray        # output -> vector
    bias: np.ndarray           # output

    def bucket_logits(self) -> np.ndarray:
        """Log-odds that each bucket contributes: averaging commutes with the linear output layer."""
        return self.vectors @ (self.weights[1] - self.weights[0])

    def score(self, texts: list[str], logits: np.ndarray | None = None) -> np.ndarray:
        logits = self.bucket_logits() if logits is None else logits
        z = self.features.sums(texts, logits)[:, 0] + (self.bias[1] - self.bias[0])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train_embeddings(samples: list[tuple[int, np.ndarray, np.ndarray]], counts: dict[int, int],
                     config: EmbeddingConfig = EmbeddingConfig()) -> EmbeddingModel:
    """SGD, one document a step, over (label, buckets, weights); `counts` has the labels' true frequencies."""
    rng = np.random.default_rng(config.seed)
    size = 1 << config.features.bits
    vectors = rng.uniform(-1 / config.dim, 1 / config.dim, (size, config.dim)).astype(np.float32)
    weights = rng.normal(0, 0.5, (2, config.dim)).astype(np.float32)
    bias = np.zeros(2)
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    labels = {y for y, _, _ in samples}
    if len(labels) < 2:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return EmbeddingModel(config.features, vectors * 0, weights * 0, np.array([0.0, np.log(share / (1 - share))]))
    # each label weighs the same in training; afterwards the bias takes the true frequencies
    drawn = {y: sum(1 for s in samples if s[0] == y) for y in labels}
    steps, done = config.epochs * len(samples), 0
    for _ in range(config.epochs):
        for i in rng.permutation(len(samples)):
            y, ids, w = samples[i]
            rate = config.rate * (1 - done / steps) * len(samples) / (2 * drawn[y])
            done += 1
            if len(ids) == 0:
                continue
            own = vectors[ids]
            hidden = w @ own
            z = weights @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            step = (p @ weights) * (rate / float(w @ w))
            weights -= (rate * np.outer(p, hidden)).astype(np.float32)
            bias -= 0.1 * rate * p
            vectors[ids] = own - np.outer(w, np.clip(step, -50, 50)).astype(np.float32)
    bias[1] += np.log((n1 or 1) / (n0 or 1)) / 2
    return EmbeddingModel(config.features, vectors, weights, bias)


def training_vectors(docs: DataFrame, features: FeatureSpec, label: str, text_col: str) -> list:
    """(label, buckets, weights) of a bounded sample of rows; the texts themselves stay on the executors."""

    def run(batch):
        got = features.vectors(common.texts_of(batch.column(0)))
        return [[a.tobytes() for a, _ in got], [b.tobytes() for _, b in got]]

    rows = common.add_columns(docs.select(text_col, label), run, [text_col], "ids binary, w binary", keep=[label])
    return [(r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)) for r in rows.collect()]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", config: EmbeddingConfig = EmbeddingConfig()) -> EmbeddingModel:
    """Learn from the labelled rows outside the held-out fold."""
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
             .where(common.trainable(F.col("_id")) & F.col("_y").isin(0, 1))
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    drawn, counts = common.stratified_sample(known, "_y", "_id", config.per_class, config.seed)
    # the sample is bounded by 2 * per_class ids, so it may be broadcast
    part = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), "_id")
    samples = sorted(training_vectors(part, config.features, "_y", "_text"),
                     key=lambda s: (s[0], len(s[1]), s[1].tobytes()))
    return train_embeddings(samples, counts, config)


def score_quality(docs: DataFrame, model: EmbeddingModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The input columns plus score and predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.bucket_logits()))

    def run(batch):
        m, logits = shared.value
        s = m.score(common.texts_of(batch.column(0)), logits)
        return [s, (s >= threshold).astype(np.int32)]

    return common.add_columns(docs, run, [text_col], "score double, predicted int")
