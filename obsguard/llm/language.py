"""Language identification by error-correcting output codes.

Every language has a binary codeword; one linear classifier per code bit, over hashed character n-grams
and words, says on which side of the bit's split a text lies. Decoding weighs each bit's logistic loss by
how well that bit did in training and takes the codeword with the least loss; a text whose two nearest
codewords are almost equally near is flagged as ambiguous.

Cases: a null text or one without any letter is `und` with score 0; with no labelled language every text is
`und`; with one, every text with a letter gets it. Null languages and null ids are not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .features import FeatureSpec
from .quality import training_vectors

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageConfig:
    features: FeatureSpec = FeatureSpec(bits=16, orders=(2, 3), words=True, pairs=False, lower=True)
    per_language: int = 800    # bound of the training sample, by language
    epochs: int = 5
    rate: float = 0.5
    margin: float = 0.1        # two codewords nearer to each other than this are ambiguous
    max_exhaustive: int = 5    # up to so many languages get the exhaustive code
    seed: int = 17


def codewords(n: int, config: LanguageConfig = LanguageConfig()) -> np.ndarray:
    """n codewords of -1/+1 bits. Few languages: all 2**(n-1) - 1 splits; more: the random code, out of
    64 drawn, whose nearest two codewords are farthest apart."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= config.max_exhaustive:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng = np.random.default_rng(config.seed)
    length, best, best_distance = int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (n, length))
        apart = (length - code @ code.T) / 2
        np.fill_diagonal(apart, length)
        useful = (np.abs(code.sum(axis=0)) < n).all()
        if useful and apart.min() > best_distance:
            best, best_distance = code, apart.min()
    return best


@dataclass
class LanguageModel:
    features: FeatureSpec
    languages: list
    code: np.ndarray           # language x bit
    weights: np.ndarray        # bucket x bit
    bias: np.ndarray
    trust: np.ndarray          # weight of each bit's loss
    margin: float

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, ambiguous) for rows of bit margins."""
        z = np.clip(margins[:, None, :] * self.code[None, :, :], -30, 30)
        loss = (np.log1p(np.exp(-z)) * self.trust).sum(axis=2)
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share = near / near.sum(axis=1, keepdims=True)
        order = np.argsort(-share, axis=1, kind="stable")
        top = np.take_along_axis(share, order[:, :1], axis=1)[:, 0]
        if share.shape[1] > 1:
            second = np.take_along_axis(share, order[:, 1:2], axis=1)[:, 0]
        else:
            second = np.zeros_like(top)
        return order[:, 0], top, top - second < self.margin

    def predict(self, texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray]:
        plain = ["" if t is None else t for t in texts]
        lettered = np.array([any(map(str.isalpha, t)) for t in plain], dtype=bool)
        if not self.languages:
            lettered[:] = False
        names, scores, unsure = [UNDETERMINED] * len(plain), np.zeros(len(plain)), np.zeros(len(plain), dtype=bool)
        if lettered.any():
            at = np.flatnonzero(lettered)
            if self.code.shape[1]:
                margins = self.features.sums([plain[i] for i in at], self.weights) + self.bias
                best, share, near = self.decode(margins)
            else:
                best, share, near = np.zeros(len(at), int), np.ones(len(at)), np.zeros(len(at), dtype=bool)
            scores[at], unsure[at] = share, near
            for i, b in zip(at, best, strict=True):
                names[i] = self.languages[b]
        return names, scores, unsure


def train_codes(samples: list, languages: list, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """All bit classifiers at once: logistic SGD, one document a step, over (language, buckets, weights)."""
    code = codewords(len(languages), config)
    bits = code.shape[1]
    weights, bias = np.zeros((1 << config.features.bits, bits), np.float32), np.zeros(bits)
    trust = np.ones(bits)
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(config.seed)
    right, seen, done, steps = np.zeros(bits), 0, 0, max(1, config.epochs * len(samples))
    for epoch in range(config.epochs if bits else 0):
        for i in rng.permutation(len(samples)):
            lang, ids, w = samples[i]
            y = code[number[lang]]
            rate = config.rate * (1 - done / steps)
            done += 1
            if len(ids) == 0:
                continue
            own = weights[ids]
            z = w @ own + bias
            if epoch == config.epochs - 1:
                right += z * y > 0       # judged before this document's own step
                seen += 1
            g = y / (1 + np.exp(np.clip(y * z, -30, 30)))
            weights[ids] = own + np.outer(w, g * (rate / float(w @ w))).astype(np.float32)
            bias += 0.05 * rate * g
    if seen:
        accuracy = np.clip(right / seen, 0.55, 0.999)
        trust = np.log(accuracy / (1 - accuracy))
        trust = trust / trust.mean()
    return LanguageModel(config.features, languages, code, weights, bias, trust, config.margin)


def fit_languages(docs: DataFrame, lang: str = "lang", id_col: str = "doc_id", text_col: str = "text",
                  config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Learn from rows outside the held-out fold whose language is known."""
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang).alias("_y"))
            .where(common.trainable(F.col("_id")) & F.col("_y").isNotNull()))
    drawn, counts = common.stratified_sample(rows, "_y", "_id", config.per_language, config.seed)
    samples = sorted(training_vectors(drawn, config.features, "_y", "_text"),
                     key=lambda s: (s[0], len(s[1]), s[1].tobytes())) if counts else []
    return train_codes(samples, sorted(counts), config)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input columns plus lang_pred, score (0 to 1) and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        return shared.value.predict(batch.column(0).to_pylist())

    return common.add_columns(docs, run, [text_col], "lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents whose language is not `und`, with their own columns only."""
    names = docs.columns
    spare = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*spare)
    told = identify(plain, model, spare[names.index(text_col)])
    return told.where(F.col("lang_pred") != UNDETERMINED).select(*spare).toDF(*names)
