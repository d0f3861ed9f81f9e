"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores each sentence from its words and their beginnings, and the document's score is the
noisy-or of its sentences: the probability that at least one is toxic, if each is so on its own. The model is
trained from document labels only, through the noisy-or, and then tells which sentences offend.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from procatlas.llm.store import per_process, stored
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
SCORED = "score double, predicted int, sentences array<struct<start:int,length:int,score:double>>"


def features(word: str) -> list[str]:
    """The word and its beginnings of four to six letters, which inflected forms share."""
    return [word, *("^" + word[:n] for n in range(4, min(6, len(word)) + 1))]


def sentence_words(text: str) -> list[set[str]]:
    """The distinct lowered words of each distinct sentence that has words."""
    sentences = dict.fromkeys(s.strip() for s in _SENTENCE.findall(text))
    return [words for words in (set(_WORD.findall(s.lower())) for s in sentences) if words]


class _Sums(dict):
    """The summed weight of a word's features."""

    def __init__(self, weights: dict[str, float], limit: int = 300_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: str) -> float:
        total = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) >= self.limit:
            self.clear()
        self[word] = total
        return total


@dataclass(frozen=True)
class Model:
    """Weights of word features and the bias of a sentence."""

    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)

    def judge(self, text: str | None, threshold: float = 0.5) -> tuple[float, int, list[dict]]:
        """(score, prediction, sentences of at least ``threshold``); a sentence that repeats counts once.

        A sentence is a dictionary of ``start, length, score``, its place counted in code points.
        """
        weight = per_process("word sums", id(self.weights), lambda: (self.weights, _Sums(self.weights)))[1].__getitem__
        seen, total, found = {}, 0.0, []
        for sentence in _SENTENCE.finditer(text or ""):
            raw = sentence.group()
            same = raw.strip()
            score = seen.get(same)
            if score is None:
                words = set(_WORD.findall(raw.lower()))
                score = 0.0
                if words:
                    odds = self.bias + sum(map(weight, words))
                    total += odds + math.log1p(math.exp(-odds)) if odds > 0 else math.log1p(math.exp(odds))  # -log(1 - score)
                    score = 1.0 / (1.0 + math.exp(-odds)) if odds > -500 else 0.0
                seen[same] = score
            if score >= threshold:
                found.append({"start": sentence.start(), "length": len(raw), "score": score})
        score = -math.expm1(-total)
        return score, int(score >= 0.5), found


def train(texts: list[str], labels: list[int], min_docs: int = 3, max_features: int = 1 << 18, importance: tuple[float, float] = (1.0, 1.0), epochs: int = 40,
          rate: float = 0.5, l1: float = 3e-5, seed: int = 3) -> Model:
    """Fit by AdaGrad on the negative log likelihood of the document labels; small weights shrink to nothing.

    Only features of at least ``min_docs`` documents are learned, the ``max_features`` most frequent. ``importance`` is how
    much a document of label 0 and of label 1 counts.
    """
    counts: Counter[str] = Counter()
    for text in texts:
        counts.update({f for word in set().union(*sentence_words(text)) for f in features(word)})
    known = sorted((f for f, n in counts.items() if n >= min_docs), key=lambda f: (-counts[f], f))[:max_features]
    del counts
    place = {f: i for i, f in enumerate(known)}
    # the texts are cut once more rather than kept as words, which would take many times their size
    docs = [[np.array([place[f] for w in sorted(s) for f in features(w) if f in place], dtype=np.int32) for s in sentence_words(text)] for text in texts]
    kept = [i for i, d in enumerate(docs) if d]
    if not kept or len({labels[i] for i in kept}) < 2:
        return Model(bias=20.0 if kept and labels[kept[0]] else -20.0)
    n, rng = len(known), np.random.default_rng(seed)
    weight, bias = np.zeros(n), -4.0
    g_weight, g_bias = np.full(n, 1e-2), 1e-2
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(kept), max(1, len(kept) // 64)):
            sentences = [s for i in batch for s in docs[i]]
            sizes = np.array([len(s) for s in sentences])
            of_doc = np.repeat(np.arange(len(batch)), [len(docs[i]) for i in batch])
            tokens = np.concatenate(sentences)
            of_sentence = np.repeat(np.arange(len(sentences)), sizes)
            odds = bias + np.bincount(of_sentence, weight[tokens], len(sentences))
            loss = np.bincount(of_doc, np.logaddexp(0.0, odds), len(batch))
            toxic = np.array([labels[i] for i in batch], dtype=bool)
            survives = np.exp(-np.maximum(loss, 1e-9))
            slope = np.where(toxic, -importance[1] * survives / np.maximum(1.0 - survives, 1e-9), importance[0])
            grad = slope[of_doc] / (1.0 + np.exp(-np.clip(odds, -500, 500))) / len(batch)
            step = np.bincount(tokens, grad[of_sentence], n)
            g_weight += step**2
            g_bias += grad.sum() ** 2
            scale = rate / np.sqrt(g_weight)
            weight -= scale * step
            weight = np.sign(weight) * np.maximum(np.abs(weight) - scale * l1, 0.0)
            bias -= rate * grad.sum() / np.sqrt(g_bias)
    used = np.flatnonzero(np.abs(weight) > 1e-3)
    return Model(float(bias), {known[i]: float(weight[i]) for i in used})


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", per_label: int = 2000, most_chars: int = 24_000, **settings) -> Model:
    """Train from a bounded sample of labelled documents.

    Of the documents of either label with at most ``most_chars`` characters, so that the sample has a bound in bytes too, the
    ``per_label`` with the smallest hashes are taken. Each counts for as many labelled documents as it stands for, so that
    scores fit the labels' real shares. Null labels and texts teach nothing; an id that repeats teaches once.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    fits = docs.filter(F.length(F.col(text)) <= most_chars).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(fits.select("doc_id").distinct().join(known, "doc_id"), "toxic-labels")
    shares = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    first = [rows.filter(F.col("label") == k).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    drawn = first[0].unionByName(first[1])
    # the drawn ids are at most two times per_label
    sample = fits.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).orderBy("doc_id").collect()
    weight = [shares.get(k, 0) / max(1, min(shares.get(k, 0), per_label)) for k in (0, 1)]
    return train([r["text"] for r in sample], [r["label"] for r in sample], importance=(max(1.0, weight[0]), max(1.0, weight[1])), **settings)


def score_toxicity(model: Model, text: Column, threshold: float = 0.5) -> Column:
    """A struct column ``score, predicted, sentences``.

    ``score`` is the noisy-or over the whole text's distinct sentences, ``predicted`` 1 from 0.5 on, and ``sentences``
    the places and scores of those that reach ``threshold``. Null and empty texts and texts without words score 0. Texts
    that repeat get the same answer.
    """

    @F.pandas_udf(SCORED)
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.judge(t, threshold) for t in texts], columns=["score", "predicted", "sentences"])

    return scored(text)


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows with all their columns, inside ``row``, beside ``score, predicted, sentences``."""
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return whole.select("row", score_toxicity(model, F.col("text"), threshold).alias("scored")).select("row", "scored.*")
