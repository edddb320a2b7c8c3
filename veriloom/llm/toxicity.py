"""Toxicity by weak supervision.

Many voters (word lexicons and word-start patterns) vote on a bounded sample of documents, or abstain. A generative label
model, fitted by expectation-maximisation, has as parameters the share of toxic documents, each voter's accuracy (how it
votes given the label), and the voters' correlations: a tree joins each voter to the one that it repeats most beyond what
the label explains, and it votes given the label and that voter's vote, so repeated evidence doesn't count twice. The
model's posterior labels, not the given ones, train a linear classifier over the words and word starts that voters use.

Given labels choose the words of the voters' lists, among which voters are dealt without them; the label model and the
classifier never see a given label.

A text's score is the logistic of a sum over its distinct words, so scoring is one look-up a word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.labelled import sample
from veriloom.session import ready, tidy

WORD = re.compile(r"[^\W\d_]+")
#: Bounds: documents that voters and classifier are fitted on, words of all lexicons, word starts of all patterns.
SAMPLE, LEXICON, STARTS = 4000, 400, 120
#: Lexicons and patterns are dealt into so many voters each.
LISTS, START_LENGTHS = 8, (4, 5, 6)
#: Entries of a worker's word cache.
CACHE = 500_000


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _marks(word: str) -> list[str]:
    """A word, and its starts as patterns."""
    return [word, *(f"{word[:k]}*" for k in START_LENGTHS if len(word) > k)]


def _ranked(toxic: Counter, clean: Counter, n1: int, n0: int, least: int) -> list[str]:
    """Marks by how much likelier they are in toxic rows, smoothed; the best first, ties by name."""
    odds = {m: np.log((c + 0.5) / (n1 + 1)) - np.log((clean[m] + 0.5) / (n0 + 1)) for m, c in toxic.items() if c >= least}
    return sorted((m for m, o in odds.items() if o > 3), key=lambda m: (-odds[m] * np.log1p(toxic[m]), m))


#: Weight, in documents, of a voter's own distribution in its distribution given another's vote.
SMOOTHING = 4.0


@dataclass
class LabelModel:
    """P(label), and P(vote | label, vote of the parent) of each voter; the root of the tree has no parent (-1)."""

    prior: float = 0.1
    parents: list[int] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3, 3)))
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label 1) of each row of votes (1 for, -1 against, 0 abstains)."""
        z = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        v = votes + 1
        for j, parent in enumerate(self.parents):
            given = v[:, parent] if parent >= 0 else np.zeros(len(v), np.int64)
            z += np.log(self.table[j, 1, given, v[:, j]]) - np.log(self.table[j, 0, given, v[:, j]])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _maximise(self, onehot: np.ndarray, p: np.ndarray) -> None:
        n, m = len(p), onehot.shape[1] // 3
        self.prior = float(np.clip(p.mean(), 0.01, 0.99))
        # how often two voters vote how, in documents of each label
        pairs = np.stack([(onehot * w[:, None]).T @ onehot for w in (1 - p, p)]).reshape(2, m, 3, m, 3).transpose(0, 1, 3, 2, 4)
        single = np.stack([pairs[:, j, j].diagonal(axis1=1, axis2=2) for j in range(m)]) + 0.5
        weight = single.sum(2)
        self.accuracy = single / weight[:, :, None]
        joint = pairs + 1e-9
        joint /= joint.sum((3, 4), keepdims=True)
        alone = self.accuracy.transpose(1, 0, 2)
        information = (joint * np.log(joint / (alone[:, :, None, :, None] * alone[:, None, :, None, :]))).sum((3, 4))
        shared = (information * np.array([1 - self.prior, self.prior])[:, None, None]).sum(0)
        self.parents = self._tree(shared)
        self.table = np.repeat(self.accuracy[:, :, None, :], 3, axis=2)
        for j, k in enumerate(self.parents):
            if k >= 0:
                counts = pairs[:, k, j]
                self.table[j] = (counts + SMOOTHING * self.accuracy[j][:, None, :]) / (counts.sum(2, keepdims=True) + SMOOTHING)

    @staticmethod
    def _tree(shared: np.ndarray) -> list[int]:
        """Parents of the spanning tree with the largest sum of shared information."""
        m = len(shared)
        parents, best, link, left = [-1] * m, np.full(m, -np.inf), np.full(m, -1), set(range(m))
        while left:
            j = max(left, key=lambda x: (best[x], -x))
            left.remove(j)
            parents[j] = int(link[j])
            for k in left:
                if shared[j, k] > best[k]:
                    best[k], link[k] = shared[j, k], j
        return parents

    def fit(self, votes: np.ndarray, rounds: int = 30) -> LabelModel:
        """EM from the majority vote."""
        total = votes.sum(1)
        p = np.where(total > 0, 0.95, np.where(total < 0, 0.05, 0.3))
        onehot = (votes[:, :, None] == np.array([-1, 0, 1])).reshape(len(votes), -1).astype(float)
        for _ in range(rounds):
            self._maximise(onehot, p)
            new = self.posterior(votes)
            if np.abs(new - p).max() < 1e-4:
                break
            p = new
        return self


class Toxicity:
    """Voters, label model and linear classifier."""

    def __init__(self):
        self.voters: list[frozenset[str]] = []
        self.label_model = LabelModel()
        self.weights: dict[str, float] = {}
        self.bias = -4.0

    def votes(self, bags: list[set[str]]) -> np.ndarray:
        """One column for each list: 1 if a mark of it occurs; the last two vote against (no mark; few marks for the length)."""
        every = frozenset().union(*self.voters) if self.voters else frozenset()
        out = np.zeros((len(bags), len(self.voters) + 2), dtype=np.int64)
        for i, bag in enumerate(bags):
            found = bag & every
            for j, voter in enumerate(self.voters):
                out[i, j] = bool(found & voter)
            out[i, -2] = 0 if found else -1
            out[i, -1] = -1 if len(found) * 200 < len(bag) else 0
        return out

    def fit(self, texts: list[str], labels: list[int]) -> Toxicity:
        if not texts or len(set(labels)) < 2:
            return self
        bags = [{m for w in words(t) for m in _marks(w)} for t in texts]
        toxic, clean = Counter(), Counter()
        for bag, y in zip(bags, labels, strict=True):
            (toxic if y else clean).update(bag)
        n1 = sum(labels)
        best = _ranked(toxic, clean, n1, len(labels) - n1, max(3, n1 // 60))
        lexicon = [m for m in best if not m.endswith("*")][:LEXICON]
        starts = [m for m in best if m.endswith("*")][:STARTS]
        self.voters = [frozenset(x[k::LISTS]) for x in (lexicon, starts) for k in range(LISTS) if x[k::LISTS]]
        votes = self.votes(bags)
        target = self.label_model.fit(votes).posterior(votes)
        self._regress(bags, target, [*lexicon, *starts])
        return self

    def _regress(self, bags: list[set[str]], target: np.ndarray, vocabulary: list[str], rounds: int = 60) -> None:
        """Logistic regression on the posterior labels, by proximal gradient steps with an L1 term.

        Weights don't fall below 0: evidence against would otherwise add up in long texts and hide what is in them.
        """
        at = {m: j for j, m in enumerate(vocabulary)}
        rows = [np.array(sorted(at[m] for m in bag if m in at), dtype=np.int64) for bag in bags]
        who, cols = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        w, b, n = np.zeros(len(vocabulary)), -2.0, len(rows)
        weight = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
        weight /= weight.mean()
        square = np.full(len(vocabulary), 1e-8)
        for _ in range(rounds):
            z = np.bincount(who, w[cols], n) + b
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
            grad = np.bincount(cols, g[who], len(w)) + 1e-4 * w
            square = 0.9 * square + 0.1 * grad**2
            step = 0.25 / (np.sqrt(square) + 1e-3)
            w -= step * grad
            w = np.maximum(w - step * 2e-4, 0)
            b -= 2.0 * g.sum()
        self.weights = {m: float(w[j]) for m, j in at.items() if w[j]}
        self.bias = float(b)

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(m, 0.0) for m in _marks(word))

    def scorer(self):
        """A function of a text, with a cache of word weights."""
        known: dict[str, float] = {}

        def score(text: str | None) -> float:
            if len(known) > CACHE:
                known.clear()
            z = self.bias
            for word in words(text):
                w = known.get(word)
                if w is None:
                    w = known[word] = self.word_weight(word)
                z += w
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

        return score


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Toxicity:
    """Voters, label model and classifier fitted on at most `most` labelled rows; without both classes all score low."""
    rows = sample(docs, labels, label, train, most, id_col=id_col, text_col=text_col)
    return Toxicity().fit(rows["text"].tolist(), rows["label"].tolist())


def score(docs: DataFrame, model: Toxicity, text_col: str = "text", *, threshold: float = 0.7, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the probability of toxicity and predicted = probability >= threshold.

    Null texts count as empty ones; a text without words gets the bias's score. Texts of any length are taken whole.
    Columns named like an output are replaced, others and repeated rows stay; equal texts get equal scores. An empty
    table stays empty.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for batch in batches:
            yield pd.Series([of(x) for x in batch], dtype="float64")
        del of
        tidy()

    scored = docs.withColumn(out[0], probability(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumn(out[1], (F.col(out[0]) >= threshold).cast("int"))


def held_out(doc_id: object, folds: int = 3) -> bool:
    """Whether the row is never learnt from: crc32 of the id as text is 1 modulo folds."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % folds == 1
