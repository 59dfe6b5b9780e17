"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding undoes disguises: compatibility forms, case, look-alike letters of other scripts, zero-width
characters, and digits or signs standing for letters inside a word. The lexicon holds whole words and
word beginnings with weights learned from the labelled rows outside the held-out fold (candidates by their
odds of standing in a toxic document, weighed together by a penalised logistic regression); exception phrases are longer words or word pairs that contain an entry but stand in
clean documents, and take their entry's weight back. A document's evidence, its summed weights divided by a
slowly growing function of its length, goes through the logistic curve that the weights were fitted with
(labels weigh as drawn, so up to `per_class` rows each they weigh the same).

Cases: null and empty texts have no evidence and score the curve's base; null labels and ids are not
learned from; with no toxic row known, every text scores 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# --- fixed values: look-alike letters and the Latin letter each stands for -------------------------
LOOKALIKES = {
    # Cyrillic
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    # Greek
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x",
    # Latin and Armenian look-alikes
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ѡ": "w",
}
# --- fixed values: digits and signs written for letters ---------------------------------------------
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
ZERO_WIDTH = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))

_LOOK = str.maketrans(LOOKALIKES) | ZERO_WIDTH
_TOKEN = re.compile(r"[^\W_]+(?:[@$!*_]+[^\W_]+)*", re.UNICODE)
_MIXED = re.compile(r"[^\s]*[0-9@$!][^\s]*")
_DIGITS = str.maketrans(DIGIT_LETTERS)


def _unmask(match: re.Match) -> str:
    """Letters for digits and signs inside a word that has letters too; trailing '!' stays punctuation."""
    word = match.group()
    body = word.rstrip("!")
    tail = word[len(body):]
    if not any(map(str.isalpha, body)):
        return word
    return body.translate(_DIGITS) + tail


def fold(text: str) -> str:
    """The folded text: words of small letters separated by single blanks, one blank at either end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LOOK)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
    if _MIXED.search(text):
        text = _MIXED.sub(_unmask, text)
    return " " + " ".join(_TOKEN.findall(text)) + " "


@dataclass(frozen=True)
class LexiconConfig:
    per_class: int = 5_000    # bound of the training sample, by label
    stems: tuple = (4, 5, 6, 7, 8)   # word beginnings that may become entries
    min_docs: int = 4          # places in toxic documents of the sample that an entry needs
    min_odds: float = 8.0      # how many times likelier in toxic documents
    max_entries: int = 1_000   # likeliest first
    max_exceptions: int = 20_000
    sure_share: float = 0.01   # an entry in this share of the toxic documents stays without further proof
    penalty: float = 1.5       # documents' worth of evidence that any other entry must add
    ridge: float = 0.01
    steps: int = 400
    seed: int = 23


def length_factor(text: str) -> float:
    """What a match weighs in a text of this length: one over the logarithm of its length."""
    return 1.0 / math.log(math.e + len(text) / 600.0)


@dataclass
class ToxicLexicon:
    entries: dict                                     # pattern with its blanks -> weight
    exceptions: dict = field(default_factory=dict)    # phrase with its blanks -> weight taken back
    base: float = -4.0
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for p in {*self.entries, *self.exceptions}:
                a.add_word(p, (p, len(p), self.entries.get(p, 0.0), self.exceptions.get(p)))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def matches(self, text: str) -> list[tuple[str, float]]:
        """Entries found in a text, without those inside an exception phrase; one match per place, the heaviest."""
        a = self.automaton()
        if not len(a):
            return []
        folded = fold(text)
        at: dict[int, tuple[str, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (p, n, weight, back) in a.iter(folded):
            start = end - n + 1
            if back is not None:
                spared.append((start, end))
            elif weight > at.get(start, ("", 0.0))[1]:
                at[start] = (p, weight)
        if spared:
            for start in list(at):
                stop = start + len(at[start][0]) - 1
                if any(s <= start and stop <= e for s, e in spared):
                    del at[start]
        return list(at.values())

    def evidence(self, text: str) -> float:
        found = self.matches(text)
        return sum(w for _, w in found) * length_factor(text) if found else 0.0

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.entries:
            return np.zeros(len(texts))
        x = np.array([self.evidence(t) for t in texts], dtype=float)
        return 1.0 / (1.0 + np.exp(-np.clip(self.base + x, -40, 40)))


def _document_terms(text: str, stems: tuple) -> dict:
    """Every word and word beginning of a text, with the word before its first occurrence."""
    terms: dict[str, str] = {}
    before = ""
    for w in fold(text).split():
        if len(w) > 1:
            terms.setdefault(f" {w} ", before)
        for n in stems:
            if len(w) > n:
                terms.setdefault(" " + w[:n], before)
        before = w
    return terms


def term_counts(sample: DataFrame, config: LexiconConfig) -> DataFrame:
    """(term, toxic, clean): places of a term in documents of each label.

    A document counts once for a term, and documents where the term follows the same word count as one
    place: the words of a toxic document do not become entries because the document has many copies.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            terms, places, toxic = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _document_terms(text or "", config.stems)
                terms.extend(found)
                places.extend(found.values())
                toxic.extend([y] * len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array(places, pa.string()), pa.array(toxic, pa.int32())],
                ["term", "place", "y"])

    return (sample.select("_text", "_y").mapInArrow(run, "term string, place string, y int")
            .groupBy("term", "y", F.xxhash64("place").alias("place")).agg(F.count(F.lit(1)).alias("docs"))
            .groupBy("term").agg(F.sum(F.col("y")).cast("long").alias("toxic"),
                                 F.sum(1 - F.col("y")).cast("long").alias("clean"),
                                 F.sum(F.col("docs") * (1 - F.col("y"))).alias("clean_docs")))


def _choose(counts: DataFrame, drawn: dict, config: LexiconConfig) -> tuple[dict, set]:
    """Candidate entries with their log-odds, and those of them that are beyond doubt by the places they mark.

    An entry has enough places in toxic documents and few clean ones; a word beginning replaces the words
    that it covers.
    """
    odds = ((F.col("toxic") + 0.5) / F.lit(drawn[1] + 1.0)) / ((F.col("clean_docs") + 0.5) / F.lit(drawn[0] + 1.0))
    rows = (counts.where(F.col("toxic") >= config.min_docs).withColumn("odds", odds)
            .where(F.col("odds") >= config.min_odds)
            .orderBy(F.col("odds").desc(), "term").limit(config.max_entries).collect())
    found = {r["term"]: r for r in rows}
    candidates: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t), t)):
        if not any(term[:n + 1] in candidates for n in config.stems if n + 1 < len(term)):
            candidates[term] = float(np.log(found[term]["odds"]))
    sure = max(2 * config.min_docs, config.sure_share * drawn[1])
    return candidates, {t for t in candidates if found[t]["toxic"] >= sure}


def _exceptions(sample: DataFrame, entries: dict, config: LexiconConfig) -> dict:
    """Words, and words with either neighbour, that hold an entry yet stand in clean documents mostly."""
    lexicon = ToxicLexicon(entries)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            phrases, toxic = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold(text or "").split()
                found = set()
                for i, w in enumerate(words):
                    if not lexicon.matches(w):
                        continue
                    found.add(f" {w} ")
                    if i:
                        found.add(f" {words[i - 1]} {w} ")
                    if i + 1 < len(words):
                        found.add(f" {w} {words[i + 1]} ")
                phrases.extend(found)
                toxic.extend([y] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int32())],
                                             ["term", "y"])

    rows = (sample.select("_text", "_y").mapInArrow(run, "term string, y int")
            .groupBy("term").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
            .where((F.col("clean") >= 2) & (F.col("clean") > 4 * F.col("toxic")))
            .orderBy(F.col("clean").desc(), "term").limit(config.max_exceptions).collect())
    return {r["term"]: 1.0 for r in rows if r["term"] not in entries}


def fit_lexicon(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
                text_col: str = "text", config: LexiconConfig = LexiconConfig()) -> ToxicLexicon:
    """Learn entries, exceptions and the curve from a bounded sample of the rows outside the held-out fold."""
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
             .where(common.trainable(F.col("_id")) & F.col("_y").isin(0, 1))
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    ids, counts = common.stratified_sample(known, "_y", "_id", config.per_class, config.seed)
    if not counts.get(1) or not counts.get(0):
        return ToxicLexicon({})
    # bounded by 2 * per_class ids; the sampled texts are kept once for the three passes over them
    sample = common.saved(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                          .join(F.broadcast(ids), "_id").select("_text", "_y"), "toxicity-sample")
    drawn = {0: 0, 1: 0} | {r[0]: int(r[1]) for r in sample.groupBy("_y").agg(F.count(F.lit(1))).collect()}
    if not drawn[0] or not drawn[1]:
        return ToxicLexicon({})
    entries, sure = _choose(term_counts(sample, config), drawn, config)
    if not entries:
        return ToxicLexicon({})
    lexicon = ToxicLexicon(entries, _exceptions(sample, entries, config))
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def found(batch):
        got = [shared.value.matches(t) for t in common.texts_of(batch.column(0))]
        return [[[p for p, _ in g] for g in got], [length_factor(t) for t in common.texts_of(batch.column(0))]]

    rows = common.add_columns(sample, found, ["_text"], "found array<string>, factor double", keep=["_y"]).collect()
    marks = [(r["_y"], r["found"], r["factor"]) for r in rows]
    picked, _ = _weigh(marks, sorted(entries), config.penalty, 0.0, config.steps)
    kept = sorted(sure | {t for t, w in picked.items() if w > 0})
    weights, lexicon.base = _weigh(marks, kept, 0.0, config.ridge, 5 * config.steps)   # again without the penalty's shrinking
    lexicon.entries = {t: w for t, w in weights.items() if w > 0}
    return lexicon


def _weigh(rows: list, terms: list, penalty: float, ridge: float, steps: int) -> tuple[dict, float]:
    """Non-negative logistic regression of the label on the entries found, by accelerated proximal steps.

    With an L1 penalty, an entry whose toxic documents are explained by other entries gets weight 0."""
    column = {t: j for j, t in enumerate(terms)}
    rows = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    x = np.zeros((len(rows), len(terms)), dtype=np.float32)
    for i, (_, found, factor) in enumerate(rows):
        for t in found:
            if t in column:
                x[i, column[t]] += factor
    y = np.array([r[0] for r in rows], dtype=np.float32)
    w, base = np.zeros(len(terms), dtype=np.float32), np.float32(-2.0)
    momentum, at = w.copy(), 1.0
    if len(terms):
        step = 4.0 / (max(1.0, float((x * x).sum(axis=1).max()) * max(1.0, float((x > 0).sum(axis=0).max()))) + 4 * ridge)
    else:
        step = 0.0
    penalty = penalty * min(1.0, float(y.sum()) / 100)   # few toxic rows cannot bear the whole of it
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ momentum + base, -30, 30)))
        fresh = np.maximum(momentum + step * (x.T @ (y - p) - penalty - ridge * momentum), 0)
        base += np.clip(4.0 / len(rows) * (y - p).sum(), -0.2, 0.2)
        nxt = (1 + np.sqrt(1 + 4 * at * at)) / 2
        momentum, w, at = fresh + ((at - 1) / nxt) * (fresh - w), fresh, nxt
    return {t: float(w[j]) for t, j in column.items()}, float(base)


def score_toxicity(docs: DataFrame, lexicon: ToxicLexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input columns plus score and predicted (1 if score >= threshold). One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch):
        s = shared.value.score(common.texts_of(batch.column(0)))
        return [s, (s >= threshold).astype(np.int32)]

    return common.add_columns(docs, run, [text_col], "score double, predicted int")
